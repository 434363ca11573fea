"""Operator 6, toxic spans by a linear-chain conditional random field.

Token labels come from the labelled documents: a word counts as offending where it
stands in a toxic document and it, or a prefix of it, is significantly bound to toxic
documents, near copies counted once. The field has two states, hashed word features and
learned transitions. Forward-backward marginals give offending offsets, and their
maximum is the document's score. Offending words also see how often such words stand in
their document, since some offend only where they are frequent.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD, bounded_sample, even_share, in_slices, type_of


@dataclass(frozen=True)
class CrfParams:
    #: Bound of the training sample: labelled documents of each class, shared evenly by languages.
    sample_docs: int = 2000
    #: Dimensions of the hashed features, rounds and step of the optimiser, ridge.
    dimensions: int = 1 << 18
    rounds: int = 40
    step: float = 0.5
    ridge: float = 1e-6
    #: Training texts are divided into sequences of so many tokens, none left out; scoring sees whole texts.
    segment: int = 256
    #: Sampled clean documents without offending words that train the field, for each toxic document.
    plain_per_toxic: float = 1.0
    #: A binding counts when its log p-value lies this far below -log(number of candidates).
    certainty: float = 3.0
    threshold: float = 0.5
    cached_words: int = 300_000


def features(word: str, dimensions: int) -> list[int]:
    """Hashed ids: the word, its prefixes and last letters, its length class, a bias."""
    w = word.lower()
    names = ("w" + w, "3" + w[:3], "4" + w[:4], "5" + w[:5], "6" + w[:6], "s" + w[-3:], "l%d" % min(len(w), 12), "b")
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "replace")) % dimensions for x in names]


FEATURES = len(features("x", 1 << 18))
#: Added to the cached score of an offending word, far outside what weights can reach.
MARK = 1e6


def frequency(hits: int, words: int) -> tuple[float, float]:
    """Whether offending words repeat in a document, and the logarithm of their share there."""
    return float(hits > 1), min(4.0, max(-4.0, math.log2(128 * hits / words))) if hits else 0.0


def runs_of_lengths(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length, their starts in a flat array, and how many reach each step."""
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)[order] if len(lengths) else np.zeros(0, np.int64)
    down = lengths[order]
    longest = int(down[0]) if len(down) else 0
    alive = np.searchsorted(-down, -np.arange(longest), side="left")
    return order, starts, alive


def marginals(score: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, with_pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """P(state 1) of every token of the sequences laid end to end in ``score``.

    All sequences advance together, a step at a time; scaled probabilities keep any
    length stable. ``with_pairs`` adds the expected transitions and first states.
    """
    _, starts, alive = runs_of_lengths(lengths)
    odds = np.exp(np.clip(score, -30, 30))
    f1 = np.empty(len(score))
    t, s = np.exp(move), np.exp(start)
    for k, n in enumerate(alive):
        at = starts[:n] + k
        if k == 0:
            n0, n1 = np.full(n, s[0]), s[1] * odds[at]
        else:
            p1 = f1[at - 1]
            p0 = 1 - p1
            n0, n1 = p0 * t[0, 0] + p1 * t[1, 0], (p0 * t[0, 1] + p1 * t[1, 1]) * odds[at]
        f1[at] = n1 / (n0 + n1)
    out = np.empty(len(score))
    b = np.full(len(starts), 0.5)
    pairs = np.zeros((2, 2)) if with_pairs else None
    for k in range(len(alive) - 1, -1, -1):
        n = alive[k]
        at = starts[:n] + k
        more = alive[k + 1] if k + 1 < len(alive) else 0
        if more:
            nxt = at[:more] + 1
            e1 = odds[nxt] * b[:more]
            e0 = 1 - b[:more]
            if with_pairs:
                p1, p0 = f1[at[:more]], 1 - f1[at[:more]]
                w = np.stack([p0 * t[0, 0] * e0, p0 * t[0, 1] * e1, p1 * t[1, 0] * e0, p1 * t[1, 1] * e1])
                pairs += (w / w.sum(axis=0)).sum(axis=1).reshape(2, 2)
            c0, c1 = t[0, 0] * e0 + t[0, 1] * e1, t[1, 0] * e0 + t[1, 1] * e1
            b[:more] = c1 / (c0 + c1)
        p = f1[at] * b[:n]
        out[at] = p / (p + (1 - f1[at]) * (1 - b[:n]))
    first = None
    if with_pairs:
        has = starts[: alive[0]] if len(alive) else starts[:0]
        first = np.array([len(has) - out[has].sum(), out[has].sum()])
    return out, pairs, first


class Crf:
    def __init__(self, weights: np.ndarray, start: np.ndarray, move: np.ndarray, params: CrfParams, keys: frozenset[str] = frozenset(), often: np.ndarray = np.zeros(2)):
        self.weights, self.start, self.move, self.params, self.keys, self.often = weights, start, move, params, keys, often
        self._known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def scores(self, words: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > self.params.cached_words:
            known.clear()
        out = np.fromiter((known.get(w, np.nan) for w in words), dtype=np.float64, count=len(words))
        for k in np.flatnonzero(np.isnan(out)):
            w = words[k]
            if w not in known:
                known[w] = float(self.weights[features(w, self.params.dimensions)].sum()) + (MARK if any(t in self.keys for t in token_keys(w)) else 0.0)
            out[k] = known[w]
        hit = out > MARK / 2
        if hits := int(hit.sum()):
            out[hit] += float(self.often @ frequency(hits, len(words))) - MARK
        return out

    def score(self, texts: list[str | None]) -> list[tuple[float, float, np.ndarray]]:
        """(maximum, sum, all) of the marginals of each text; no words give zeros."""
        each = [self.scores(WORD.findall(t)) if t else np.zeros(0) for t in texts]
        lengths = np.array([len(e) for e in each], dtype=np.int64)
        p, _, _ = marginals(np.concatenate(each) if each else np.zeros(0), lengths, self.start, self.move)
        parts = np.split(p, np.cumsum(lengths)[:-1]) if len(each) else []
        return [(float(x.max()), float(x.sum()), x) if len(x) else (0.0, 0.0, x) for x in parts]


def spans(text: str, p: np.ndarray, threshold: float) -> list[dict]:
    """Runs of offending tokens as character offsets into the text."""
    out: list[dict] = []
    last = -2
    for k, m in enumerate(WORD.finditer(text)):
        if p[k] >= threshold:
            if k == last + 1:
                out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], float(p[k]))
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[k])})
            last = k
    return out


# --- training on the driver, on a bounded sample ----------------------------------------------------


SKETCH = 8


def copy_weights(words: list[list[str]], toxic: np.ndarray) -> np.ndarray:
    """One over the number of a document's near copies, itself among them.

    Near copies have the same label and share three quarters of the larger sketch of
    smallest 4-word hashes. Copies of copies don't count, so a passage that many
    documents hold doesn't join them.
    """
    numbers: dict[int, int] = {}
    holders: list[list[int]] = []
    sketches: list[list[int]] = []
    for k, w in enumerate(words):
        least = sorted({xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).lower().encode("utf-8", "replace")) for i in range(max(1, len(w) - 3))})[:SKETCH]
        own = [numbers.setdefault(h, len(numbers)) for h in least]
        for h in own:
            if h == len(holders):
                holders.append([])
            holders[h].append(k)
        sketches.append(own)
    lists = [np.array(h, dtype=np.int64) for h in holders]
    size = np.array([len(s) for s in sketches], dtype=np.int64)
    out = np.ones(len(words))
    for k, own in enumerate(sketches):
        shared = np.bincount(np.concatenate([lists[h] for h in own]), minlength=len(words))
        out[k] = 1 / ((4 * shared >= 3 * np.maximum(size, size[k])) & (toxic == toxic[k])).sum()
    return out


def token_keys(word: str) -> list[str]:
    w = word.lower()
    return ["=" + w, *(w[:n] for n in (3, 4, 5, 6) if len(w) >= n)]


def bound_keys(words: list[list[str]], toxic: np.ndarray, weight: np.ndarray, params: CrfParams, least_share: float, tables: int) -> set[str]:
    """Words and prefixes bound to toxic documents, by a Bonferroni-corrected likelihood ratio.

    Of keys that lie in each other the one with the largest ratio stays, else the longest:
    a short prefix would mark innocent words too.
    """
    bad: dict[str, float] = defaultdict(float)
    good: dict[str, float] = defaultdict(float)
    for k in np.flatnonzero(toxic):
        for key in {x for w in set(words[k]) for x in token_keys(w)}:
            bad[key] += weight[k]
    for k in np.flatnonzero(~toxic):
        for key in {x for w in set(words[k]) for x in token_keys(w)}:
            if key in bad:
                good[key] += weight[k]
    if not bad or not (~toxic).any():
        return set()
    bad = {k: a for k, a in bad.items() if a >= 2.5}  # rarer ones can't reach significance
    prior = weight[toxic].sum() / weight.sum()
    need, out = math.log(max(1, len(bad))) + math.log(tables) + params.certainty, {}
    for key, a in bad.items():
        c = good.get(key, 0.0)
        q = a / (a + c)
        if q > max(prior, least_share):
            gain = a * math.log(q / prior) + (c * math.log((1 - q) / (1 - prior)) if c else 0.0)
            if gain > need:
                out[key] = gain
    kept: set[str] = set()
    covered: set[str] = set()  # prefixes of what was kept
    for key in sorted(out, key=lambda k: (-round(out[k], 6), -len(k), k)):
        inner = token_keys(key[1:])[1:] if key[0] == "=" else [key[:n] for n in range(3, len(key))]
        if key not in covered and not kept & set(inner):
            kept.add(key)
            covered |= set(inner)
    return kept


def offending_keys(words: list[list[str]], toxic: np.ndarray, params: CrfParams, languages: list[str | None] | None = None) -> set[str]:
    """Keys that nearly only toxic documents hold, over all languages, and keys bound to them within one.

    Over all languages a small share would only tell languages apart; within one any
    significant binding counts.
    """
    weight = copy_weights(words, toxic)
    out = bound_keys(words, toxic, weight, params, 0.97, 1)
    if languages is not None:
        names = sorted({x or "" for x in languages})
        for name in names:
            own = np.array([(x or "") == name for x in languages])
            at = np.flatnonzero(own)
            if toxic[at].any():
                out |= bound_keys([words[k] for k in at], toxic[at], weight[at], params, 0.0, len(names))
    return out


def fit(texts: list[str], toxic: list[bool], params: CrfParams = CrfParams(), languages: list[str | None] | None = None) -> Crf:
    """Full-batch AdaGrad on the log-likelihood of the labelled tokens."""
    blank = Crf(np.zeros(params.dimensions), np.zeros(2), np.zeros((2, 2)), params)
    blank.weights[features("b", params.dimensions)[-1]] = -20.0
    pool: dict[str, str] = {}  # one object a word, however often it occurs
    words = [[pool.setdefault(w, w) for w in WORD.findall(t)] for t in texts]
    flags = np.array(toxic, dtype=bool)
    if not flags.any() or flags.all():
        return blank
    keys = offending_keys(words, flags, params, languages)
    if not keys:
        return blank
    vocabulary: dict[str, int] = {}
    ids: list[np.ndarray] = []
    labels: list[np.ndarray] = []
    marks: list[np.ndarray] = []  # offending words, of clean documents too
    share: list[tuple[float, float]] = []  # of each sequence's document
    offending: dict[str, bool] = {}
    spare = int(params.plain_per_toxic * flags.sum())  # clean documents that hold a key all train the field
    for w, bad in zip(words, flags):
        mark = np.zeros(len(w))
        for k, x in enumerate(w):
            if x not in offending:
                offending[x] = any(t in keys for t in token_keys(x))
            mark[k] = offending[x]
        y = mark if bad else np.zeros(len(w))
        if not bad:
            spare -= 1
            if spare < 0 and not mark.any():
                continue
        elif not y.any():
            continue  # toxic for a reason that the labels don't show: teaches nothing
        rate = frequency(int(mark.sum()), len(w))
        x = np.fromiter((vocabulary.setdefault(v, len(vocabulary)) for v in w), dtype=np.int64, count=len(w))
        for at in range(0, len(x), params.segment):
            ids.append(x[at : at + params.segment])
            labels.append(y[at : at + params.segment])
            marks.append(mark[at : at + params.segment])
            share.append(rate)
    flat, y = np.concatenate(ids), np.concatenate(labels)
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    table = np.array([features(v, params.dimensions) for v in vocabulary], dtype=np.int64)
    seen_first = np.array([(y[starts] == 0).sum(), (y[starts] == 1).sum()], dtype=float)
    inner = np.ones(len(y), dtype=bool)
    inner[starts] = False
    after = np.flatnonzero(inner)
    seen_pairs = np.bincount((2 * y[after - 1] + y[after]).astype(int), minlength=4).reshape(2, 2).astype(float)
    w, start, move = np.zeros(params.dimensions), np.zeros(2), np.zeros((2, 2))
    gw, gs, gm = np.full(params.dimensions, 1e-3), np.full(2, 1e-3), np.full((2, 2), 1e-3)
    rates = np.repeat(np.array(share), lengths, axis=0) * np.concatenate(marks)[:, None]
    often, go = np.zeros(2), np.full(2, 1e-3)
    n = math.sqrt(len(y))
    for _ in range(params.rounds):
        p, pairs, first = marginals(w[table].sum(axis=1)[flat] + rates @ often, lengths, start, move, with_pairs=True)
        by_word = np.bincount(flat, weights=y - p, minlength=len(table))
        g = np.bincount(table.ravel(), weights=np.repeat(by_word, FEATURES), minlength=params.dimensions) / n - params.ridge * w
        do = (y - p) @ rates / n
        ds, dm = (seen_first - first) / n, (seen_pairs - pairs) / n
        gw += g * g
        go += do * do
        gs += ds * ds
        gm += dm * dm
        w += params.step * g / np.sqrt(gw)
        often += params.step * do / np.sqrt(go)
        start += params.step * ds / np.sqrt(gs)
        move += params.step * dm / np.sqrt(gm)
    return Crf(w, start, move, params, frozenset(keys), often)


def train(docs: DataFrame, labels: DataFrame, params: CrfParams = CrfParams(), doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", lang: str = "lang") -> Crf:
    """Fit on at most ``sample_docs`` labelled documents of each class, evenly over languages.

    A document labelled twice counts as toxic if any label says so; labels without
    document, null labels and null texts teach nothing. Without both classes the model
    finds nothing toxic. A table without the column ``lang`` is one language. Of documents
    that share an id each text teaches once.
    """
    of = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    known = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("__pw_id"), of.alias("__pw_lang"))
    once = labels.select(F.col(doc_id).alias("__pw_id"), (F.col(toxic).cast("int") > 0).alias("__pw_toxic")).where("__pw_id is not null and __pw_toxic is not null").join(known, "__pw_id").groupBy("__pw_id").agg(F.max("__pw_toxic").alias("__pw_toxic"), F.min("__pw_lang").alias("__pw_lang"))
    once = once.withColumn("__pw_class", F.concat_ws("|", F.col("__pw_toxic").cast("string"), F.coalesce("__pw_lang", F.lit(""))))
    groups = once.groupBy("__pw_toxic", "__pw_class").count().orderBy(F.desc("count"), "__pw_class").limit(4096).collect()
    # Labels are sampled before texts are joined: the join's small side has a fixed bound.
    parts = [bounded_sample(once.where(F.col("__pw_toxic") == F.lit(flag)), "__pw_class", ["__pw_id"], even_share([r["count"] for r in groups if r["__pw_toxic"] == flag], params.sample_docs)) for flag in (False, True)]
    few = parts[0].unionByName(parts[1]).select("__pw_id", "__pw_toxic", "__pw_lang")
    rows = docs.select(F.col(doc_id).alias("__pw_id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(few), "__pw_id").select("__pw_id", "text", "__pw_toxic", "__pw_lang").collect()
    rows = sorted({(r["__pw_id"], r["text"], r["__pw_toxic"], r["__pw_lang"] or "") for r in rows})
    return fit([r[1] for r in rows], [r[2] for r in rows], params, [r[3] for r in rows])


def score_documents(docs: DataFrame, model: Crf, doc_id: str = "doc_id", text: str = "text", toxic_only: bool = False) -> DataFrame:
    """(doc_id, score, expected_tokens, toxic, spans) a row.

    Null and empty texts score 0; null ids keep their row. Repeated rows are scored alike,
    each in its own row. A score of exactly the threshold is toxic. Texts are scored whole,
    however long. An empty table gives no row. Only id and text are read, so other columns
    cannot clash; the id keeps its type. ``toxic_only`` leaves the others out of the result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in in_slices(batches, 4000):
            texts = batch.column(1).to_pylist()
            found = crf.score(texts)
            bad = [s >= crf.params.threshold for s, _, _ in found]
            where = [spans(t, p, crf.params.threshold) if b else [] for t, (_, _, p), b in zip(texts, found, bad)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), pa.array(bad, pa.bool_()), pa.array(where, kind)], names=["doc_id", "score", "expected_tokens", "toxic", "spans"])
            yield out.filter(pa.array(bad, pa.bool_())) if toxic_only else out

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {type_of(docs, doc_id)}, score double, expected_tokens double, toxic boolean, spans array<struct<start:int,end:int,p:double>>")


def drop_toxic(docs: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns unchanged; null texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        crf = shared.value
        for texts in parts:
            listed = [t if isinstance(t, str) else None for t in texts]
            ok: list[bool] = []
            for at in range(0, len(listed), 4000):
                ok += [s < crf.params.threshold for s, _, _ in crf.score(listed[at : at + 4000])]
            yield pd.Series(ok, dtype=bool)

    return docs.where(clean(F.col(text).cast("string")))

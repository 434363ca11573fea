"""Operator 8, SimHash near-duplicates by the generalised pigeonhole.

Words vote on 128 bits. The first 64 are searched exactly within ``probe_radius``:
correlated bits are grouped into partitions, partition ``i`` gets its own threshold
``t_i`` with ``sum(t_i) = radius - m + 1``, and two codes within the radius must then
agree up to ``t_i`` bits in at least one partition. Dynamic programming on candidate
counts, taken from histograms over all codes, allocates the thresholds and picks the
number of partitions. Every code probes the keys it may share; pairs that meet are
verified on all 128 bits and on their word counts, and joined into groups.

The search is exact for the stated predicate, at any input size. Probe records travel
as packed arrays, so a shuffle row holds many of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, cut, in_slices, text_hash, type_of

BITS = 64
#: A probe record, 24 bytes: the key's highest bit marks a code in its own cell. The node's
#: identity follows from the code, so it doesn't travel.
RECORD = np.dtype([("key", "<u4"), ("n", "<i4"), ("lo", "<u8"), ("hi", "<u8")])
OWN = np.uint32(1 << 31)


def node_of(lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit identity of a code and its word count."""

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    with np.errstate(over="ignore"):
        return mix(lo.astype("<u8") ^ mix(hi.astype("<u8") ^ mix(n.astype("<u8") + np.uint64(0x9E3779B97F4A7C15)))).view("<i8")


@dataclass(frozen=True)
class SimHashParams:
    #: Bits that may differ among the 64 that are searched, and among all 128.
    probe_radius: int = 12
    full_radius: int = 22
    #: Word counts of near copies differ by at most this share of the larger.
    length_slack: float = 0.2
    #: Modelled cost of moving one probe record and of verifying one candidate, in seconds.
    record_cost: float = 4e-7
    candidate_cost: float = 4e-9
    #: Probe records that one bucket of the shuffle should hold.
    bucket_records: int = 200_000


class Voter:
    """SimHash of a text: each distinct lower-case word votes once on each bit."""

    def __init__(self, cached_words: int = 200_000):
        self.rows: dict[str, int] = {}
        self.votes = np.zeros((1024, 128), dtype=np.int8)
        self.cached_words = cached_words

    def _row(self, word: str) -> int:
        at = len(self.rows)
        if at == len(self.votes):
            self.votes = np.concatenate([self.votes, np.zeros_like(self.votes)])
        bits = np.unpackbits(np.frombuffer(xxhash.xxh3_128_digest(word.encode("utf-8", "replace")), dtype=np.uint8))
        self.votes[at] = bits.astype(np.int8) * 2 - 1
        self.rows[word] = at
        return at

    def code(self, text: str | None) -> tuple[int, int, int] | None:
        """(first 64 bits, last 64 bits, words), or None for a text without words."""
        found = WORD.findall((text or "").lower())
        if not found:
            return None
        if len(self.rows) > self.cached_words:
            self.rows.clear()
        distinct = set(found)
        get = self.rows.get
        rows = np.fromiter((get(w, -1) for w in distinct), dtype=np.int64, count=len(distinct))
        if (rows < 0).any():
            rows = np.fromiter((at if (at := get(w, -1)) >= 0 else self._row(w) for w in distinct), dtype=np.int64, count=len(distinct))
        bits = np.packbits(self.votes[rows].sum(axis=0, dtype=np.int32) > 0).view("<i8")
        return int(bits[0]), int(bits[1]), len(found)


def codes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, lo, hi, n, node): th is a hash of the text, which tells rows that share an id apart.

    Rows with a null id, and rows whose text is null or has no word, have no code and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = Voter()
        for batch in in_slices(batches, 2000):
            found = [voter.code(t) for t in batch.column(2).to_pylist()]
            keep = pa.array([f is not None for f in found], pa.bool_())
            a = np.array([f for f in found if f is not None], dtype=np.int64).reshape(-1, 3).T.copy().T
            node = node_of(a[:, 0].view("<u8"), a[:, 1].view("<u8"), a[:, 2])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(a[:, 2].astype(np.int32)), pa.array(node)], names=["doc_id", "th", "lo", "hi", "n", "node"])

    narrow = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), text_hash(text).alias("th"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {type_of(docs, doc_id)}, th long, lo long, hi long, n int, node long")


# --- the plan: partitions and thresholds ----------------------------------------------------------


def bit_matrix(lo: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(lo, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlation(uniq: DataFrame) -> np.ndarray:
    """|correlation| of the 64 bits over all codes; what reaches the driver has constant size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            b = bit_matrix(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view("<u8")).astype(np.float32)
            total += b.T @ b
            n += len(b)
        if n:
            i, j = np.triu_indices(BITS)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j]), pa.array(np.full(len(i), n, dtype=np.int64))], names=["i", "j", "s", "n"])

    rows = uniq.select("lo").mapInArrow(run, "i int, j int, s double, n long").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    out = np.eye(BITS)
    if not rows:
        return out
    n = rows[0].n
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r.i, r.j] = both[r.j, r.i] = r.s / n
    p = np.diag(both)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both - np.outer(p, p)) / np.outer(sd, sd))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m near-equal partitions; each grows by the free bit most correlated with it."""
    free, parts = set(range(BITS)), []
    for k in range(m):
        want = BITS // m + (k < BITS % m)
        rest = sorted(free)
        block = corr[np.ix_(rest, rest)]
        part = [rest[int(np.argmax(block.sum(axis=1)))]]
        while len(part) < want:
            rest = sorted(free - set(part))
            part.append(rest[int(np.argmax(corr[np.ix_(rest, part)].sum(axis=1)))])
        parts.append(sorted(part))
        free -= set(part)
    return parts


def values(lo: np.ndarray, part: list[int]) -> np.ndarray:
    """The partition's bits of each code as one integer."""
    out = np.zeros(len(lo), dtype=np.int64)
    for k, b in enumerate(part):
        out |= ((lo >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def histograms(uniq: DataFrame, layouts: dict[int, list[list[int]]]) -> dict[tuple[int, int], np.ndarray]:
    """Codes by partition value, over all codes; at most 2**width counts a partition."""
    flat = [(m, k, part) for m, parts in layouts.items() for k, part in enumerate(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << len(part), dtype=np.int64) for _, _, part in flat]
        for batch in batches:
            lo = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view("<u8")
            for t, (_, _, part) in zip(total, flat):
                t += np.bincount(values(lo, part), minlength=len(t))
        for which, t in enumerate(total):
            v = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), which, dtype=np.int32)), pa.array(v.astype(np.int32)), pa.array(t[v])], names=["which", "v", "c"])

    out = {(m, k): np.zeros(1 << len(part), dtype=np.float64) for m, k, part in flat}
    for r in uniq.select("lo").mapInArrow(run, "which int, v int, c long").groupBy("which", "v").agg(F.sum("c").alias("c")).collect():
        m, k, _ = flat[r.which]
        out[m, k][r.v] = r.c
    return out


def ring_counts(hist: np.ndarray, width: int, most: int) -> np.ndarray:
    """Pairs of codes at partition distance 0..most, from the histogram (Krawtchouk sums of its transform)."""
    h = hist.copy()
    step = 1
    while step < len(h):
        h = h.reshape(-1, 2, step)
        h = np.stack([h[:, 0] + h[:, 1], h[:, 0] - h[:, 1]], axis=1).reshape(-1)
        step *= 2
    power = h * h / len(h)
    weight = np.bitwise_count(np.arange(len(h), dtype=np.uint32)).astype(np.int64)
    spectrum = np.bincount(weight, weights=power, minlength=width + 1)
    from math import comb

    out = []
    for d in range(most + 1):
        kraw = [sum((-1) ** j * comb(w, j) * comb(width - w, d - j) for j in range(d + 1) if j <= w and d - j <= width - w) for w in range(width + 1)]
        both = float(np.dot(spectrum, kraw))
        out.append(max(0.0, (both - hist.sum()) / 2 if d == 0 else both / 2))
    return np.array(out)


@dataclass(frozen=True)
class Plan:
    parts: list[list[int]]
    thresholds: list[int]
    cost: float
    records: float
    candidates: float
    #: Keys of cells too full for one task, and into how many parts each is cut.
    hot_keys: tuple[int, ...] = ()
    hot_parts: tuple[int, ...] = ()


def allocate(hists: list[np.ndarray], parts: list[list[int]], n: float, params: SimHashParams) -> Plan:
    """Thresholds in -1..3 a partition with sum radius-m+1 and the least modelled cost."""
    from math import comb

    m, most = len(parts), 3
    need = params.probe_radius - m + 1
    table: dict[int, tuple[float, list[int], float, float]] = {0: (0.0, [], 0.0, 0.0)}
    for hist, part in zip(hists, parts):
        rings = np.cumsum(ring_counts(hist, len(part), most))
        options = [(-1, 0.0, 0.0)]
        for t in range(min(most, len(part)) + 1):
            copies = 1 + sum(comb(len(part), d) for d in range(1, t + 1)) / 2
            options.append((t, n * copies, rings[t]))
        step: dict[int, tuple[float, list[int], float, float]] = {}
        for total, (cost, chosen, rec, cand) in table.items():
            for t, r, c in options:
                new = cost + r * params.record_cost + c * params.candidate_cost
                if total + t not in step or new < step[total + t][0]:
                    step[total + t] = (new, [*chosen, t], rec + r, cand + c)
        table = step
    # A larger sum is allowed too: it only finds pairs by more than one way.
    best = min((v for k, v in table.items() if k >= need), key=lambda v: v[0])
    return Plan(parts, best[1], best[0], best[2], best[3])


def make_plan(uniq: DataFrame, params: SimHashParams = SimHashParams()) -> Plan:
    """The cheapest number of partitions, judged on all codes: from 5, or fewer below a radius of 4, to radius + 1.

    A partition has at most 20 bits, so 4 are the fewest. The histograms also tell which
    cells are too full for one task.
    """
    corr = correlation(uniq)
    layouts = {m: group_bits(corr, m) for m in range(min(5, max(4, params.probe_radius + 1)), max(4, params.probe_radius + 1) + 1)}
    hists = histograms(uniq, layouts)
    n = float(hists[min(layouts), 0].sum())
    best = min((allocate([hists[m, k] for k in range(m)], parts, n, params) for m, parts in layouts.items()), key=lambda p: p.cost)
    return with_hot_cells(best, [hists[len(best.parts), k] for k in range(len(best.parts))], params)


def masks_of(width: int, threshold: int) -> list[int]:
    """All patterns of at most ``threshold`` bits."""
    return [0, *(sum(1 << b for b in c) for d in range(1, threshold + 1) for c in combinations(range(width), d))]


def with_hot_cells(plan: Plan, hists: list[np.ndarray], params: SimHashParams) -> Plan:
    """The plan, knowing the cells that hold more than two buckets' records, and their records in parts."""
    keys, parts, more = [], [], 0.0
    for k, (part, t, hist) in enumerate(zip(plan.parts, plan.thresholds, hists)):
        if t < 0:
            continue
        v = np.arange(len(hist))
        held = hist.copy()
        for mask in masks_of(len(part), t)[1:]:
            w = v ^ mask
            held += np.where(v > w, hist[w], 0)  # the smaller value probes
        for at in np.flatnonzero(held > 2 * params.bucket_records):
            keys.append((k << 20) | int(at))
            parts.append(int(-(-held[at] // params.bucket_records)))
            more += held[at] * (parts[-1] - 2)
    return replace(plan, records=plan.records + more, hot_keys=tuple(keys), hot_parts=tuple(parts))


# --- probing and verification -----------------------------------------------------------------------


def probe_records(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, plan: Plan) -> np.ndarray:
    """One record for each key a code may share; a neighbour's key is probed by the smaller value only."""
    out = []
    for k, (part, t) in enumerate(zip(plan.parts, plan.thresholds)):
        if t < 0:
            continue
        v = values(lo, part)
        for mask in masks_of(len(part), t):
            w = v ^ mask
            at = slice(None) if mask == 0 else np.flatnonzero(w > v)
            r = np.empty(len(v) if mask == 0 else len(at), dtype=RECORD)
            r["key"] = (k << 20) | w[at] | (int(OWN) if mask == 0 else 0)
            r["lo"], r["hi"], r["n"] = lo[at], hi[at], n[at]
            out.append(r)
    return np.concatenate(out) if out else np.empty(0, dtype=RECORD)


def alike(a: np.ndarray, b: np.ndarray, params: SimHashParams) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of records a (column) and b (row) that satisfy the predicate."""
    near = np.bitwise_count(a["lo"][:, None] ^ b["lo"][None, :])
    i, j = np.nonzero(near <= params.probe_radius)
    full = near[i, j] + np.bitwise_count(a["hi"][i] ^ b["hi"][j])
    na, nb = a["n"][i], b["n"][j]
    ok = (full <= params.full_radius) & (np.abs(na - nb) <= params.length_slack * np.maximum(na, nb))
    return i[ok], j[ok]


def min_labels(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Smallest connected index of 0..size-1 under the edges (a, b)."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def in_blocks(a: np.ndarray, b: np.ndarray, params: SimHashParams, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a and b that are alike, a bounded block at a time."""
    wide = max(1, min(len(b), 1 << 15))
    tall = max(1, block // wide)
    for x in range(0, len(a), tall):
        for y in range(0, len(b), wide):
            i, j = alike(a[x : x + tall], b[y : y + wide], params)
            yield i + x, j + y


def cell_pairs(r: np.ndarray, own: int, params: SimHashParams, large: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Alike pairs that connect one cell's records as all alike pairs with one of the first ``own`` do.

    In a large cell, all that is alike to a pivot forms a star and isn't compared with
    each other again; by the triangle inequality only records within two radii of the
    pivot can be alike to a member of the star. So a group of near copies costs about
    its size and not its square. Where stars are small all pairs are compared.
    """
    todo, misses = np.arange(len(r)), 0
    while len(todo) > large and misses < 4:
        p = todo[:1]
        near = np.bitwise_count(r["lo"][todo] ^ r["lo"][p[0]])
        _, j = alike(r[p], r[todo], params)
        inside = np.zeros(len(todo), dtype=bool)
        inside[j] = True
        inside[0] = True
        yield np.full(len(j), p[0]), todo[j]
        if 16 * len(j) < len(todo):  # too small a star: the pivot alone is done
            misses += 1
            todo = todo[1:]
            continue
        star, away = todo[inside], near[inside]
        for d in range(2 * params.probe_radius + 1):
            rest = todo[~inside & (near == d)]
            reach = star[away >= d - params.probe_radius]
            if len(rest) and len(reach):
                for i, k in in_blocks(r[rest], r[reach], params):
                    yield rest[i], reach[k]
        todo = todo[~inside]
    first = todo[todo < own]
    for x in range(0, len(first), 4096):
        some = first[x : x + 4096]
        later = todo[int(np.searchsorted(todo, some[0])) :]
        for i, k in in_blocks(r[some], r[later], params):
            yield some[i], later[k]


def link(records: np.ndarray, params: SimHashParams, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that join what is alike within one bucket, all its keys together."""
    cell, mine = records["key"] & ~OWN, records["key"] >= OWN
    order = np.lexsort((~mine, cell))
    records, cell, mine = records[order], cell[order], mine[order]
    node, place = np.unique(node_of(records["lo"], records["hi"], records["n"]), return_inverse=True)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(records) else []
    ends = [*starts[1:], len(records)]
    pairs_a, pairs_b, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for s, e in zip(starts, ends):
        own = int(mine[s:e].sum())
        if not own or e - s < 2:
            continue
        for i, j in cell_pairs(records[s:e], own, params):
            i, j = place[i + s], place[j + s]
            differ = i != j
            if differ.any():
                pairs_a.append(i[differ])
                pairs_b.append(j[differ])
                held += int(differ.sum())
            if held > most:
                label = min_labels(np.concatenate(pairs_a), np.concatenate(pairs_b), len(node))
                at = np.flatnonzero(label != np.arange(len(node)))
                pairs_a, pairs_b, held = [at], [label[at]], len(at)
    label = min_labels(np.concatenate(pairs_a), np.concatenate(pairs_b), len(node))
    at = np.flatnonzero(label != np.arange(len(node)))
    return node[at], node[label[at]]


def spread(r: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(records, salts): a hot cell's records go, by part, to every pair of parts that theirs is in."""
    salt = np.zeros(len(r), dtype=np.uint64)
    if not plan.hot_keys:
        return r, salt
    keys, count = np.array(plan.hot_keys, dtype=np.int64), np.array(plan.hot_parts, dtype=np.int64)
    order = np.argsort(keys)
    keys, count = keys[order], count[order]
    own = (r["key"] & ~OWN).astype(np.int64)
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    hot = np.flatnonzero(keys[at] == own)
    if not len(hot):
        return r, salt
    parts = count[at[hot]]
    mine = (node_of(r["lo"][hot], r["hi"][hot], r["n"][hot]).view("<u8") % parts.astype(np.uint64)).astype(np.int64)
    copies = np.repeat(np.arange(len(hot)), parts - 1)
    other = np.arange(len(copies)) - np.repeat(np.cumsum(parts - 1) - (parts - 1), parts - 1)
    other += other >= mine[copies]
    low, high = np.minimum(mine[copies], other), np.maximum(mine[copies], other)
    keep = np.ones(len(r), dtype=bool)
    keep[hot] = False
    return np.concatenate([r[keep], r[hot[copies]]]), np.concatenate([salt[keep], (low * parts[copies] + high + 1).astype(np.uint64)])


def edges(uniq: DataFrame, plan: Plan, params: SimHashParams) -> DataFrame:
    """Star edges (a, b) with the components of the predicate's graph."""
    buckets = max(1, round(plan.records / params.bucket_records))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 20_000):
            lo, hi, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            r, salt = spread(probe_records(lo.view("<u8"), hi.view("<u8"), n, plan), plan)
            mixed = ((((r["key"] & ~OWN).astype(np.uint64) << np.uint64(32)) ^ salt) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            bucket = (mixed % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            r, bucket = r[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            data = [r[s:e].tobytes() for s, e in zip(cuts, [*cuts[1:], len(r)])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(data, pa.binary())], names=["bucket", "data"])

    def verify(_: tuple, table: pa.Table) -> pa.Table:
        blobs = [b for c in table.column("data").chunks for b in c.to_pylist()]
        a, b = link(np.frombuffer(b"".join(blobs), dtype=RECORD), params)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    packed = uniq.select("lo", "hi", "n").mapInArrow(probe, "bucket int, data binary")
    return packed.groupBy("bucket").applyInArrow(verify, "a long, b long")


def components(found: DataFrame) -> DataFrame:
    """(node, label) for each node with an edge; label is its component's smallest node.

    Alternating large-star and small-star steps; each is written to the shared folder,
    so a lost executor costs a re-read and not the chain of steps before it.
    """
    e = cut(found.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = low.select("u", F.col("m").alias("v")).unionByName(low.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        new = cut(small)
        # Settled once no node points at two, and no pointed-at node points on.
        moving = new.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count() or new.alias("x").join(new.alias("y"), F.col("x.v") == F.col("y.u"), "left_semi").limit(1).count()
        e = new
        if not moving:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))


def groups(docs: DataFrame, params: SimHashParams = SimHashParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, kept_doc_id, kept_th, group_size) for each row that has a near copy, the kept one too.

    Rows with equal id and text count as one document; rows that share an id but not the
    text are documents of their own. The kept one is the group's smallest (doc_id, th), so
    ties can't occur. Null ids and texts without a word have no copies. Texts are read
    whole, however long; an empty table gives no row. Only id and text are read, so other
    columns can't clash; the id keeps its type.
    """
    every = cut(codes(docs, doc_id, text).distinct())
    uniq = cut(every.select("node", "lo", "hi", "n").distinct())
    labels = components(edges(uniq, make_plan(uniq, params), params))
    named = every.select("doc_id", "th", "node").join(labels, "node", "left").select("doc_id", "th", F.coalesce("label", "node").alias("label"))
    best = named.groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("kept"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return named.join(best, "label").select("doc_id", "th", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.th").alias("kept_th"), "group_size")


def near_copies(docs: DataFrame, params: SimHashParams = SimHashParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept_doc_id, group_size): each document that goes, and the copy of it that stays.

    As for ``groups``: null ids, texts without a word and empty tables give no row, rows
    repeated with equal id and text count once, and other columns aren't read.
    """
    found = groups(docs, params, doc_id, text)
    return found.where((F.col("doc_id") != F.col("kept_doc_id")) | (F.col("th") != F.col("kept_th"))).select("doc_id", "kept_doc_id", "group_size")


def drop_near_copies(docs: DataFrame, params: SimHashParams = SimHashParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group, all columns unchanged.

    Rows repeated with equal id and text are copies of each other, so one of them stays.
    Other rows without words have no copies and stay; so does every row without id.
    """
    found = groups(docs, params, doc_id, text).select(F.col("doc_id").alias("__pw_id"), F.col("th").alias("__pw_th"), (F.col("doc_id") != F.col("kept_doc_id")).alias("__pw_a"), (F.col("th") != F.col("kept_th")).alias("__pw_b"))
    gone = found.where("__pw_a or __pw_b").select("__pw_id", "__pw_th")
    keyed = docs.withColumn("__pw_d", F.col(doc_id)).withColumn("__pw_t", text_hash(text))
    left = keyed.join(gone, (keyed["__pw_d"] == gone["__pw_id"]) & (keyed["__pw_t"] == gone["__pw_th"]), "left_anti")
    # The join leaves rows placed and sorted by these two columns, which the window asks for.
    nth = F.row_number().over(Window.partitionBy("__pw_d", "__pw_t").orderBy("__pw_d"))
    return left.withColumn("__pw_n", nth).where((F.col("__pw_n") == 1) | F.col("__pw_d").isNull()).drop("__pw_d", "__pw_t", "__pw_n")

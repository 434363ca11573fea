"""Operator 1, language ID by compression.

Every known language owns a zstandard raw-content dictionary. A text, in lower
case, is encoded with each of them; the dictionary that gives the fewest bytes names the language,
and a text whose two best sizes lie too close is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_sample, cut, even_share, in_slices, type_of


@dataclass(frozen=True)
class LangIdParams:
    #: Bound of the labelled sample, in distinct documents of a language; every third is held out.
    sample_docs: int = 720
    #: Bytes of a language's dictionary, shared evenly by the sampled documents that are not held out.
    dictionary_bytes: int = 196_608
    #: A text is encoded in independent blocks, so that each byte of a long one meets the dictionary.
    block_bytes: int = 4096
    level: int = 6
    #: Every block follows so many bytes of the dictionary itself, which cost one match: else the
    #: encoder would store a short block raw, at the same size for all languages.
    carrier_bytes: int = 300
    #: A text is accepted when the second size exceeds the best by a share of the best: the least lead
    #: that rejects half of the held-out errors, without rejecting more than ``most_rejected`` of what
    #: is right. ``min_margin`` is its floor, and holds where nothing was held out.
    min_margin: float = 0.004
    most_rejected: float = 0.005


class CompressionClassifier:
    """Per-language encoders; picklable, because the encoders are made on first use."""

    def __init__(self, dictionaries: dict[str, bytes], params: LangIdParams, margin: float | None = None):
        self.dictionaries, self.params = dictionaries, params
        self.margin = params.min_margin if margin is None else margin
        self._encoders: list[tuple[str, zstd.ZstdCompressor, bytes]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoders": None}

    def encoders(self) -> list[tuple[str, zstd.ZstdCompressor, bytes]]:
        if self._encoders is None:
            self._encoders = []
            for lang in sorted(self.dictionaries):
                known = zstd.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(level=self.params.level)
                half = len(self.dictionaries[lang]) // 2
                carrier = self.dictionaries[lang][half : half + self.params.carrier_bytes]
                self._encoders.append((lang, zstd.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False), carrier))
        return self._encoders

    def sizes(self, text: str | None) -> dict[str, int]:
        data, step = (text or "").lower().encode("utf-8", "replace"), self.params.block_bytes
        blocks = [data[k : k + step] for k in range(0, len(data), step)]
        return {lang: sum(len(e.compress(carrier + b)) for b in blocks) for lang, e, carrier in self.encoders()}

    def classify(self, text: str | None) -> tuple[str | None, int, int, float, bool]:
        """(language, best size, second size, margin, accepted).

        Null, empty and blank texts, and texts seen with no dictionary at all, have no
        language and are rejected, and so are ties. With one dictionary only, everything
        else is accepted.
        """
        if text is None or not text.strip() or not self.dictionaries:
            return None, 0, 0, 0.0, False
        ranked = sorted((n, lang) for lang, n in self.sizes(text).items())
        best, lang = ranked[0]
        second = ranked[1][0] if len(ranked) > 1 else 2 * best
        margin = (second - best) / best
        return lang, best, second, margin, second > best and margin >= self.margin


def dictionary(texts: list[str], size: int) -> bytes:
    """All texts in lower case, each cut to the even share at which together they fill ``size`` bytes."""
    data = [t.lower().encode("utf-8", "replace") for t in texts]
    share = even_share([len(d) for d in data], size)
    return b"\n".join(d[:share] for d in data)


def calibrated(right: list[float], wrong: list[float], params: LangIdParams) -> float:
    """The margin from held-out leads; see ``LangIdParams.min_margin``."""
    if not wrong:
        return params.min_margin
    half = sorted(wrong)[len(wrong) // 2]
    spared = sorted(right)[int(params.most_rejected * len(right))] if right else half
    return max(params.min_margin, min(half, spared))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", params: LangIdParams = LangIdParams()) -> CompressionClassifier:
    """Dictionaries and margin from a bounded sample of the labelled rows (``sample_docs`` a language).

    Rows without language or text teach nothing, repeated rows teach once. All sampled
    documents that are not held out enter their language's dictionary, in the order of a
    hash, each with an even share from a place that its hash names, so that no single long
    document fills it. Held-out documents are classified whole, on the executors. A table
    without labelled text gives a model that rejects everything.
    """
    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where(F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    few = cut(bounded_sample(known, "lang", ["text"], params.sample_docs))
    wide = max(256, 8 * params.dictionary_bytes // params.sample_docs)
    start = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - wide + 1)).cast("int") + 1
    rows = few.where(F.col("__pw_rank") % 3 != 0).select("lang", "__pw_rank", F.substr("text", start, F.lit(wide)).alias("piece")).collect()
    pieces: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["__pw_rank"])):
        pieces.setdefault(row["lang"], []).append(row["piece"])
    model = CompressionClassifier({k: dictionary(v, params.dictionary_bytes) for k, v in pieces.items()}, params)
    held = identify(few.where(F.col("__pw_rank") % 3 == 0), model, "__pw_rank", "text", "lang").where("found_lang is not null")
    leads: dict[bool, list[float]] = {True: [], False: []}
    for row in held.select((F.col("given_lang") == F.col("found_lang")).alias("right"), "margin").collect():
        leads[row["right"]].append(row["margin"])
    return CompressionClassifier(model.dictionaries, params, calibrated(leads[True], leads[False], params))


def identify(docs: DataFrame, model: CompressionClassifier, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row a document: given and found language, both sizes, margin, verdict.

    Null, empty and blank texts have no language and are rejected; ties are rejected.
    Texts are encoded whole, however long, in blocks. Repeated rows and null ids each keep
    their row; an empty table gives none. Other columns of ``docs`` are ignored, so that
    their names cannot clash; the id keeps its type.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = shared.value.classify
        for batch in in_slices(batches, 1000):
            found = [classify(t) for t in batch.column(2).to_pylist()]
            a = [list(x) for x in zip(*found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a[0], pa.string()), pa.array(a[1], pa.int64()), pa.array(a[2], pa.int64()), pa.array(a[3], pa.float64()), pa.array(a[4], pa.bool_())], names=["doc_id", "given_lang", "found_lang", "best_bytes", "second_bytes", "margin", "accepted"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("given_lang"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {type_of(docs, doc_id)}, given_lang string, found_lang string, best_bytes long, second_bytes long, margin double, accepted boolean")


def keep_identified(docs: DataFrame, model: CompressionClassifier, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose language is accepted.

    Null, empty and blank texts and ties are rejected; repeated rows go or stay together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classify = shared.value.classify
        for texts in parts:
            yield pd.Series([classify(t)[4] for t in texts], dtype=bool)

    return docs.where(accepted(F.col(text).cast("string")))

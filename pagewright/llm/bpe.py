"""Operator 10, byte-pair encoding and decoding on a contiguous rank array.

A word's parts are kept as a list of boundaries and, beside it, the rank that joining
each part with the next would have. The least rank is found by a scan, the boundary
between its two parts is deleted, and the two neighbouring ranks are refreshed. Long
words, for which the scan would be quadratic, use a heap over linked parts and give the
same tokens.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import in_slices, type_of

NONE = 1 << 31


@dataclass(frozen=True)
class BpeParams:
    #: The vocabulary file: a base64 token and its rank on each line.
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    #: How a text is cut into words before any merge.
    pattern: str = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    #: Bytes up to which a word is scanned; words that a worker remembers.
    short_bytes: int = 96
    cached_words: int = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a word by repeated scans of the rank array."""
    get = ranks.get
    starts = list(range(len(word) + 1))
    join = [get(word[k : k + 2], NONE) for k in range(len(word) - 1)]
    while join:
        least = min(join)
        if least == NONE:
            break
        k = join.index(least)
        del starts[k + 1]
        if k + 1 < len(join):
            join[k + 1] = get(word[starts[k] : starts[k + 2]], NONE)
        del join[k]
        if k:
            join[k - 1] = get(word[starts[k - 1] : starts[k + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(starts, starts[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges, least rank first and leftmost among equals, in O(n log n)."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, stop = heapq.heappop(heap)
        mid = end[k]
        if not alive[k] or mid >= n or end[mid] != stop:
            continue
        alive[mid] = False
        end[k] = stop
        if stop < n:
            before[stop] = k
            if (r := ranks.get(word[k : end[stop]])) is not None:
                heapq.heappush(heap, (r, k, end[stop]))
        if before[k] >= 0 and (r := ranks.get(word[before[k] : stop])) is not None:
            heapq.heappush(heap, (r, before[k], stop))
    return [ranks[word[k : end[k]]] for k in range(n) if alive[k]]


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], params: BpeParams = BpeParams()):
        self.ranks, self.params = ranks, params
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.tokens = {v: k for k, v in ranks.items()}
        self.split = regex.compile(params.pattern).findall
        self.known = _Words(self)

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        if raw in self.ranks:
            return [self.ranks[raw]]
        return merge_short(raw, self.ranks) if len(raw) <= self.params.short_bytes else merge_long(raw, self.ranks)

    def encode(self, text: str) -> np.ndarray:
        if len(self.known) > self.params.cached_words:
            self.known.clear()
        return np.array(list(chain.from_iterable(map(self.known.__getitem__, self.split(text)))), dtype=np.int32)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return b"".join(map(self.tokens.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")


class _Words(dict):
    def __init__(self, owner: Tokenizer):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> list[int]:
        ids = self.owner.word(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


class FastCoder:
    """The tokens of ``Tokenizer`` from a compiled encoder.

    That encoder's splitter overflows its stack on blanks of a million signs and more;
    texts with such runs go to ``Tokenizer``, which gives the same tokens.
    """

    LONG_BLANKS = re.compile(r"\s{100000}")

    def __init__(self, ranks: dict[bytes, int], params: BpeParams = BpeParams()):
        self.ranks, self.params = ranks, params
        self.fast = tiktoken.Encoding("public", pat_str=params.pattern, mergeable_ranks=ranks, special_tokens={})
        self.slow: Tokenizer | None = None

    def encode(self, text: str) -> list[int]:
        if len(text) < 100_000 or not self.LONG_BLANKS.search(text):
            return self.fast.encode_ordinary(text)
        self.slow = self.slow or Tokenizer(self.ranks, self.params)
        return self.slow.encode(text).tolist()


def token_count(spark: SparkSession, text: str, params: BpeParams = BpeParams()) -> Column:
    """Number of tokens of a text column; null texts give null, empty ones 0."""
    shared = spark.sparkContext.broadcast(load_ranks(params.vocabulary))

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = FastCoder(shared.value, params)
        for texts in parts:
            yield pd.Series([len(coder.encode(t)) if isinstance(t, str) else None for t in texts], dtype="Int64")

    return count(F.col(text).cast("string"))


def encode(docs: DataFrame, params: BpeParams = BpeParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) a row; round_trip tells that decoding gives the text back.

    A null text has null ids and counts, an empty one no ids; a null id stays null. Repeated
    rows are encoded each for itself. Equal ranks can't occur; of equal pairs in a word the
    leftmost is merged first. Texts of any length are encoded whole. An empty table gives no
    row. Only id and text are read, so other columns can't clash; the id keeps its type.
    Lone surrogates, which UTF-8 cannot hold, become question marks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(params.vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Tokenizer(shared.value, params)
        for batch in in_slices(batches, 250):
            texts = batch.column(1).to_pylist()
            ids = [None if t is None else bpe.encode(t) for t in texts]
            same = [None if t is None else bpe.decode(x) == t for t, x in zip(texts, ids)]
            counts = pa.array([None if x is None else len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), counts, pa.array(same, pa.bool_())], names=["doc_id", "token_ids", "n_tokens", "round_trip"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {type_of(docs, doc_id)}, token_ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, params: BpeParams = BpeParams(), doc_id: str = "doc_id", token_ids: str = "token_ids") -> DataFrame:
    """(doc_id, text) from arrays of ids; null ids give a null text, an unknown id fails."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(params.vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Tokenizer(shared.value, params)
        for batch in in_slices(batches, 500):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(token_ids).cast("array<int>").alias("token_ids")).mapInArrow(run, f"doc_id {type_of(encoded, doc_id)}, text string")

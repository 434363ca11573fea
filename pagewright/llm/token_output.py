"""Operator 4, token ids as Re-Pair grammars in binary shards.

Texts are encoded with a public vocabulary and collected into shards. In each shard the
most frequent pairs of neighbouring ids are replaced by nonterminals, round after round,
until no pair occurs twice.
A shard stores its rules, how many ids each rule expands to, and the final symbols;
expansion lengths find any id range without decoding what comes before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_slices, type_of
from .bpe import BpeParams, FastCoder, load_ranks


@dataclass(frozen=True)
class TokenOutputParams:
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    #: Ids that close a shard.
    shard_tokens: int = 1 << 20
    #: Re-Pair: how often a pair must occur. Two is the whole grammar.
    least_count: int = 2


def repair(ids: np.ndarray, doc_starts: np.ndarray, base: int, params: TokenOutputParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, document starts among them, rules as (left, right), expansion lengths).

    Pairs never span documents. Every round replaces all pairs that occur often enough;
    where two overlap the more frequent one goes, so at least the most frequent pair is
    replaced wherever it stands. It ends when no pair is left that qualifies.
    """
    symbols, starts = ids.astype(np.int64), doc_starts.astype(np.int64)
    rules, lengths = [np.empty((0, 2), np.int64)], np.ones(base, np.int64)
    closed = np.zeros(len(symbols), dtype=bool)  # nothing follows in the document
    closed[starts[(starts > 0) & (starts <= len(symbols))] - 1] = True
    closed[-1:] = True
    live = np.ones(len(symbols), dtype=bool)  # a pair once too rare never becomes more frequent
    while True:
        at = np.flatnonzero(live & ~closed)
        bits = len(lengths).bit_length()
        key = (symbols[at] << bits) | symbols[at + 1]
        # In a run of one symbol every second pair overlaps the one before.
        k = np.arange(len(at))
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (np.diff(at) != 1) | (key[1:] != key[:-1])
        apart = (k - np.maximum.accumulate(np.where(fresh, k, 0))) % 2 == 0
        at, key = at[apart], key[apart]
        place = len(key).bit_length()
        if 2 * bits + place < 64:  # the place rides in the low bits: sorting numbers is faster than sorting their order
            packed = np.sort((key << place) | np.arange(len(key)))
            order, ordered = packed & ((1 << place) - 1), packed >> place
        else:
            order = np.argsort(key)
            ordered = key[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.empty(0, np.int64)
        count = np.diff(first, append=len(ordered))
        if not (count >= params.least_count).any():
            break
        which = np.empty(len(at), dtype=np.int64)
        which[order] = np.repeat(np.arange(len(first)), count)
        many = count[which] >= params.least_count
        live[at[~many]] = False
        at, which = at[many], which[many]
        rank = np.empty(len(first), dtype=np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(first))
        r, touch = rank[which], np.diff(at) == 1
        wins = np.ones(len(at), dtype=bool)
        wins[1:] &= ~(touch & (r[1:] > r[:-1]))
        wins[:-1] &= ~(touch & (r[:-1] > r[1:]))
        won = np.bincount(which[wins], minlength=len(first))
        good = (won >= params.least_count) & (2 * won >= count)  # the others wait for their neighbours
        wins &= good[which]
        at, which = at[wins], which[wins]
        used = np.flatnonzero(good)
        name = np.zeros(len(first), dtype=np.int64)
        name[used] = len(lengths) + np.arange(len(used))
        pair = np.stack([ordered[first[used]] >> bits, ordered[first[used]] & ((1 << bits) - 1)], axis=1)
        rules.append(pair)
        lengths = np.concatenate([lengths, lengths[pair].sum(axis=1)])
        symbols[at] = name[which]
        closed[at] = closed[at + 1]
        live[at] = True
        live[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        symbols, closed, live = symbols[keep], closed[keep], live[keep]
        starts = starts - np.searchsorted(at + 1, starts, side="left")
    return symbols.astype(np.uint32), starts, np.concatenate(rules).astype(np.uint32), lengths[base:]


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """Ids of a run of symbols: the newest rules are opened first, all occurrences at once."""
    out = symbols.astype(np.int64)
    while len(out) and (deep := out >= base).any():
        size = np.where(deep, 2, 1)
        end = np.cumsum(size)
        new = np.empty(end[-1], dtype=np.int64)
        new[end[~deep] - 1] = out[~deep]
        pair = rules[out[deep] - base]
        new[end[deep] - 2], new[end[deep] - 1] = pair[:, 0], pair[:, 1]
        out = new
    return out


@dataclass
class Shard:
    """A stored shard, ready for random access."""

    base: int
    doc_ids: list
    doc_symbols: np.ndarray
    symbols: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, row) -> "Shard":
        return cls(row["base"], list(row["doc_ids"]), np.array(row["doc_symbols"], dtype=np.int64), np.frombuffer(row["symbols"], dtype="<u4"), np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2), np.frombuffer(row["rule_lengths"], dtype="<u4").astype(np.int64))

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start..stop of the shard's k-th document; only the symbols that cover them are expanded."""
        own = self.symbols[self.doc_symbols[k] : self.doc_symbols[k + 1]]
        size = np.where(own >= self.base, np.concatenate([self.lengths, [0]])[np.maximum(own.astype(np.int64) - self.base, -1)], 1)
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.empty(0, dtype=np.int64)
        a, b = int(np.searchsorted(end, start, side="right")), int(np.searchsorted(end, stop, side="left"))
        skipped = int(end[a] - size[a])
        return expand(own[a : b + 1], self.rules, self.base)[start - skipped : stop - skipped]


def shards(docs: DataFrame, params: TokenOutputParams = TokenOutputParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a shard; see the module. ``doc_symbols`` has one more entry than documents.

    Every task shards what it reads: nothing is shuffled, and a task that runs again gives
    the same shards. Null and empty texts are documents without ids, null ids stay null.
    Repeated rows are stored each for itself. An empty table gives no shard. A document is
    never divided: a long one may fill a shard alone, beyond ``shard_tokens``. Of pairs as
    frequent as each other the one with the smaller ids is replaced first. Only id and text
    are read, so other columns can't clash; the id keeps its type.
    """
    ranks = load_ranks(params.vocabulary)
    base = max(ranks.values()) + 1
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    names = ["shard_id", "base", "n_docs", "n_tokens", "doc_ids", "doc_tokens", "doc_symbols", "rules", "rule_lengths", "symbols"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), None, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = FastCoder(shared.value, BpeParams(params.vocabulary, params.pattern))
        part, made = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[np.ndarray] = []
        total, id_kind = 0, pa.int64()

        def close() -> pa.RecordBatch:
            nonlocal ids, held, total, made
            counts = np.array([len(h) for h in held], dtype=np.int64)
            starts = np.concatenate([[0], np.cumsum(counts)])
            symbols, begin, rules, lengths = repair(np.concatenate(held), starts, base, params)
            row = [f"{part:06d}-{made:06d}", base, len(ids), total, ids, counts, begin, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u4").tobytes()]
            made += 1
            ids, held, total = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k or pa.list_(id_kind)) for v, k in zip(row, kinds)], names=names)

        for batch in in_slices(batches, 500):
            id_kind = batch.column(0).type
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.array(coder.encode(t), dtype=np.uint32) if t else np.empty(0, np.uint32)
                ids.append(d)
                held.append(found)
                total += len(found)
                if total >= params.shard_tokens:
                    yield close()
        if ids:
            yield close()

    ddl = f"shard_id string, base int, n_docs long, n_tokens long, doc_ids array<{type_of(docs, doc_id)}>, doc_tokens array<long>, doc_symbols array<long>, rules binary, rule_lengths binary, symbols binary"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, ddl)

"""Operator 3, best-fit decreasing packing with a segment tree.

Documents fill training sequences of a fixed capacity. In each shard they come longest
first, and each goes to the open bin that it leaves the least room in. A segment tree
over the remaining capacities finds that bin in logarithmic time.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, type_of
from .bpe import BpeParams, token_count


@dataclass(frozen=True)
class PackParams:
    #: Tokens a bin holds, and the vocabulary that counts them where no length is given.
    capacity: int = 2048
    tokens: BpeParams = BpeParams()
    #: Pieces that one shard should hold: bins never span shards, and a shard is one task.
    shard_pieces: int = 50_000


class CapacityTree:
    """Open bins by remaining room; ``take(n)`` gives the one with the least room >= n."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity).bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def put(self, room: int, which: int) -> None:
        self.bins.setdefault(room, []).append(which)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of the tightest fit, the bin opened last among equals; it leaves the tree."""
        node, count = need + self.size, self.count
        if not count[node]:
            # Climb to the first right sibling that holds a bin, then descend leftmost.
            while node > 1 and not (node & 1 == 0 and count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.bins[room].pop()


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset in the bin) of each length, all within 1..capacity, in the order given."""
    tree, opened, bins, offsets = CapacityTree(capacity), 0, [], []
    for n in lengths:
        found = tree.take(n)
        if found is None:
            room, which = capacity, opened
            opened += 1
        else:
            room, which = found
        bins.append(which)
        offsets.append(capacity - room)
        if room > n:
            tree.put(room - n, which)
    return bins, offsets


def pack(docs: DataFrame, params: PackParams = PackParams(), doc_id: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """(doc_id, piece, start, n_tokens, shard, bin, bin_offset), one row for each piece of a document.

    Lengths are token counts of the text, or the column ``length`` where one is named. A
    document longer than a bin is cut into full bins and a rest, so nothing of it is lost.
    Null and empty texts, and null or non-positive lengths, count as one token. Equal
    lengths go by id, then piece, null ids last; repeated rows are packed each for itself.
    An empty table gives no row. Only id and text (or length) are read, so other columns
    can't clash; the id keeps its type.

    Texts are counted once, where they are read; only ids and lengths go on, and only they
    are shuffled. The number of shards follows the number of pieces.
    """
    size = F.col(length).cast("long") if length else token_count(docs.sparkSession, text, params.tokens)
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), size.alias("total")).withColumn("total", F.greatest(F.lit(1).cast("long"), F.coalesce("total", F.lit(1).cast("long")))))
    cap = params.capacity
    pieces = sized.select("doc_id", "total", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(cap).cast("long"))).alias("piece", "start"))
    pieces = pieces.select("doc_id", "piece", "start", F.least(F.lit(cap).cast("long"), F.col("total") - F.col("start")).alias("n_tokens"))
    return place(pieces, shards_for(sized, params), params)


def shards_for(sized: DataFrame, params: PackParams) -> int:
    count = sized.agg(F.sum(F.ceil(F.col("total") / F.lit(params.capacity))).alias("n")).first().n or 0
    return max(1, -(-int(count) // params.shard_pieces))


def place(pieces: DataFrame, shards: int, params: PackParams) -> DataFrame:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        out = table.take(order)
        bins, offsets = best_fit(out.column("n_tokens").to_pylist(), params.capacity)
        return pa.table({"doc_id": out.column("doc_id"), "piece": out.column("piece"), "start": out.column("start"), "n_tokens": out.column("n_tokens"), "shard": out.column("shard"), "bin": pa.array(bins, pa.int64()), "bin_offset": pa.array(offsets, pa.int64())})

    spread = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int").alias("shard")
    return pieces.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "n_tokens", spread).groupBy("shard").applyInArrow(run, f"doc_id {type_of(pieces, 'doc_id')}, piece int, start long, n_tokens long, shard int, bin long, bin_offset long")

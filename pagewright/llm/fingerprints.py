"""Operator 2, document fingerprints from content-defined chunks.

A gear hash rolls over the UTF-8 bytes. Normalised chunking asks more of it before a
chunk has its normal size and less after, so cuts fall at like content wherever it
stands. The set of chunk digests, weighted by length, is the fingerprint; how much of
one document's weight another holds is its containment.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, in_slices, type_of

GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=0x9E37) for b in range(256)], dtype=np.uint32)


@dataclass(frozen=True)
class ChunkParams:
    #: Bytes: least, normal and most of a chunk. The gear hash looks back over 32 bytes, so least >= 32.
    least: int = 64
    normal: int = 192
    most: int = 1024
    #: One bit more, and one less, than the normal size asks for.
    hard_bits: int = 8
    easy_bits: int = 6
    #: Share of a document's weight that another must hold to be reported.
    containment: float = 0.5


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: h = 2h + gear, in 32 bits and so over 32 bytes, by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint32(k)
        h = h + shifted
    return h


def cuts(begin: int, end: int, hard: list[int], easy: list[int], p: ChunkParams) -> list[int]:
    """Chunk ends of the bytes begin..end; ``hard`` and ``easy`` hold sorted candidate ends."""
    out, at = [], begin
    while end - at > p.least:
        stop = min(end, at + p.most)
        middle = min(stop, at + p.normal)
        k = bisect_left(hard, at + p.least)
        if k < len(hard) and hard[k] <= middle:
            at = hard[k]
        else:
            k = bisect_left(easy, middle + 1)
            at = easy[k] if k < len(easy) and easy[k] < stop else stop
        out.append(at)
    if not out or out[-1] < end:
        out.append(end)
    return out


def chunk_many(texts: list[bytes], p: ChunkParams) -> list[list[bytes]]:
    """Chunks of each text; all texts are hashed in one go, and no chunk looks across their bounds."""
    data = b"".join(texts)
    if not data:
        return [[] for _ in texts]
    h = gear_hashes(np.frombuffer(data, dtype=np.uint8))
    top = np.uint32(32)
    easy = np.flatnonzero((h >> (top - np.uint32(p.easy_bits))) == 0)
    hard = easy[(h[easy] >> (top - np.uint32(p.hard_bits))) == 0]
    easy, hard = (easy + 1).tolist(), (hard + 1).tolist()
    out, at = [], 0
    for t in texts:
        chunks, last = [], at
        if t:
            for c in cuts(at, at + len(t), hard, easy, p):
                chunks.append(data[last:c])
                last = c
        out.append(chunks)
        at += len(t)
    return out


#: The lowest bits of a digest are its chunk's length, so a set of digests carries its own weights.
LENGTH_BITS = 11


def fingerprint(chunks: list[bytes]) -> list[int]:
    """Sorted digests of a document's chunks; the k-th occurrence of a chunk has a digest of its own.

    A digest is 53 bits of hash and the length in bytes, so the weight of any set of
    digests, and of what two sets share, is the sum of their lowest bits.
    """
    seen: dict[bytes, int] = {}
    out = []
    for c in chunks:
        k = seen[c] = seen.get(c, -1) + 1
        d = xxhash.xxh64_intdigest(c, seed=k) >> LENGTH_BITS << LENGTH_BITS | len(c)
        out.append(d - (1 << 64) if d >= 1 << 63 else d)
    return sorted(out)


def weight_of(digests: str) -> F.Column:
    """Bytes of the chunks in an array of digests."""
    return F.aggregate(digests, F.lit(0).cast("long"), lambda s, d: s + d.bitwiseAND((1 << LENGTH_BITS) - 1))


def fingerprints(docs: DataFrame, params: ChunkParams = ChunkParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, signature, weight, n_chunks, digests): digests are sorted.

    The signature is equal where the whole fingerprint is. Null and empty texts have no
    chunks and are left out, as are rows without id.
    """
    names = ["doc_id", "signature", "weight", "n_chunks", "digests"]
    if not 32 <= params.least <= params.normal <= params.most < 1 << LENGTH_BITS:
        raise ValueError(f"chunks have 32 to {(1 << LENGTH_BITS) - 1} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 500, 4 << 20):
            chunks = chunk_many([t.encode("utf-8", "replace") for t in batch.column(1).to_pylist()], params)
            digests = [fingerprint(c) for c in chunks]
            signature = [xxhash.xxh64_intdigest(np.array(f, dtype=np.int64).tobytes()) for f in digests]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(signature, dtype=np.uint64).view(np.int64)), pa.array([sum(map(len, c)) for c in chunks], pa.int64()), pa.array([len(f) for f in digests], pa.int32()), pa.array(digests, pa.list_(pa.int64()))], names=names)

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and length(text) > 0")
    return narrow.mapInArrow(run, f"doc_id {type_of(docs, doc_id)}, signature long, weight long, n_chunks int, digests array<long>")


def containment(docs: DataFrame, params: ChunkParams = ChunkParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size, weight, n_links, container_id, shared_bytes, containment), one row a document.

    Documents with equal fingerprints form a class, named by its smallest id. ``n_links``
    counts the documents of other classes that hold at least the threshold's share of the
    document's weight; ``container_id`` is the class of one that holds most of it, the
    smallest id among equals, with what it holds. Without links these are null. Rows that
    share an id but not the fingerprint are documents of their own; equal rows count once.
    Null ids and null and empty texts are left out; an empty table gives no row. Texts are
    read whole, however long. Only id and text are read, so other columns can't clash.

    The comparison is exact, and no pair of copies is ever emitted: chunks that only one
    class holds can't be shared, and classes that agree in all others (copies with an edit
    each) are one set; only sets are compared. Of a set's chunks, rarest first, as many
    probe as keep the rest below the threshold, because a container must hold one of those.
    Counts of digests are aggregated before they are shuffled, and all joins are equi joins
    whose hot keys Spark may split.
    """
    need = F.lit(params.containment)
    prints = cut(fingerprints(docs, params, doc_id, text).dropDuplicates(["doc_id", "signature"]))
    classes = prints.groupBy("signature").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.first("weight").alias("weight"), F.first("digests").alias("digests"))
    classes = cut(classes)
    rows = classes.select("signature", "weight", F.explode("digests").alias("d"))
    often = rows.groupBy("d").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Each class's shared chunks, rarest first.
    held = rows.join(often, "d").groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("df", "d"))).alias("h")).select("signature", F.transform("h", lambda x: x["d"]).alias("held"))
    member = cut(held.join(classes.select("signature", "class_id", "class_size", "weight"), "signature").withColumn("shared", weight_of("held")).withColumn("set", F.xxhash64("held")))
    sets = cut(member.groupBy("set").agg(F.first("held").alias("held"), F.first("shared").alias("shared"), F.min("weight").alias("least"), F.min("class_id").alias("first_id"), F.sum("class_size").alias("docs")))
    # A chunk probes while it and the rarer-first rest could still make up the lightest member's threshold.
    lengths = F.transform("held", lambda d: d.bitwiseAND((1 << LENGTH_BITS) - 1))
    left = F.aggregate(lengths, F.struct(F.col("shared").alias("left"), F.lit(0).alias("n")), lambda s, w: F.struct((s["left"] - w).alias("left"), (s["n"] + F.when(s["left"] >= need * F.col("least"), 1).otherwise(0)).alias("n")))["n"]
    probes = sets.where(F.col("shared") >= need * F.col("least")).select(F.col("set").alias("a"), F.explode(F.slice("held", F.lit(1), left)).alias("d"), F.col("least").alias("wa"))
    index = sets.select(F.col("set").alias("b"), F.explode("held").alias("d"), F.col("shared").alias("sb"))
    candidates = probes.join(index, "d").where((F.col("a") != F.col("b")) & (F.col("sb") >= need * F.col("wa"))).select("a", "b").distinct()
    both = candidates.join(sets.select(F.col("set").alias("a"), F.col("held").alias("ha"), F.col("least").alias("wa")), "a").join(sets.select(F.col("set").alias("b"), F.col("held").alias("hb"), F.col("first_id").alias("id"), F.col("docs").alias("n")), "b")
    pairs = both.select("a", "wa", "id", "n", F.array_intersect("ha", "hb").alias("common")).select("a", "wa", "id", "n", weight_of("common").alias("s")).where(F.col("s") >= need * F.col("wa"))
    # What a set shares with others: documents by shared bytes, with the smallest id of each amount.
    steps = pairs.groupBy("a", "s").agg(F.sum("n").alias("n"), F.min("id").alias("id")).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("s", "n", "id")), asc=False).alias("steps"))
    # Members of the own set hold all shared chunks: they come first, but for the own class.
    own = member.join(sets.select("set", "docs"), "set")
    second = own.join(sets.select("set", F.col("first_id").alias("i1")), "set").where("class_id <> i1").groupBy("set", "i1").agg(F.min("class_id").alias("i2"))
    every = own.join(second, "set", "left").join(steps, F.col("set") == F.col("a"), "left")
    enough = lambda s: s >= need * F.col("weight")
    beside = F.when(enough(F.col("shared")), F.col("docs") - F.col("class_size")).otherwise(0)
    fit = F.filter(F.coalesce("steps", F.array().cast(every.schema["steps"].dataType)), lambda x: enough(x["s"]))
    twin = F.when(F.col("class_id") == F.col("i1"), F.col("i2")).otherwise(F.col("i1"))
    top = F.try_element_at(fit, F.lit(1))
    links = every.select("signature", "shared", beside.alias("beside"), twin.alias("twin"), fit.alias("fit"), top.alias("top"))
    with_twin = F.col("beside") > 0
    equal = F.coalesce(F.col("top.s") == F.col("shared"), F.lit(False))
    links = links.select(
        "signature",
        (F.col("beside") + F.aggregate("fit", F.lit(0).cast("long"), lambda t, x: t + x["n"])).alias("n_links"),
        F.when(with_twin, F.when(equal, F.least("twin", "top.id")).otherwise(F.col("twin"))).otherwise(F.col("top.id")).alias("container_id"),
        F.when(with_twin, F.col("shared")).otherwise(F.col("top.s")).alias("shared_bytes"),
    )
    named = classes.select("signature", "class_id", "class_size", "weight").join(links, "signature", "left")
    return prints.select("doc_id", "signature").join(named, "signature").select("doc_id", "class_id", "class_size", "weight", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "container_id", "shared_bytes", (F.col("shared_bytes") / F.col("weight")).alias("containment"))

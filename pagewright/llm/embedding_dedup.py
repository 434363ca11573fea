"""Operator 9, embedding near-duplicates on an inverted multi-index.

Each half of a vector has its own codebook; the product of the two codebooks is a grid
of cells. A query visits cells by the sum of its two squared centroid distances, in the
order a multi-sequence traversal gives, as many as the target recall asks for, and
verifies the cosine of what it meets there. All vectors are queries.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, in_slices
from .simhash import components, min_labels


@dataclass(frozen=True)
class MultiIndexParams:
    #: Cosine from which two vectors are near copies, and the share of such pairs to be found.
    cosine: float = 0.95
    target_recall: float = 0.97
    #: Vectors a cell should hold on average: sets the size of the codebooks.
    vectors_per_cell: int = 256
    most_centroids: int = 4096
    #: Bound of the sample the index is fitted on, in vectors a centroid and at all, and k-means rounds.
    #: It bounds the fit only: every vector is indexed and is a query.
    sample_per_centroid: int = 128
    most_sampled: int = 262_144
    kmeans_rounds: int = 12
    #: Probe records that one bucket of the shuffle should hold.
    bucket_records: int = 40_000


def nearest(x: np.ndarray, c: np.ndarray, block: int = 8192) -> np.ndarray:
    """The closest centroid of each row, in blocks, so that no matrix grows with both."""
    return np.concatenate([np.argmin(distances(x[k : k + block], c), axis=1) for k in range(0, len(x), block)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds if x.shape[1] else 0):
        near = nearest(x, c)
        size = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, weights=x[:, d], minlength=len(c)) for d in range(x.shape[1])], axis=1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c).astype(np.float32)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def traverse(d1: np.ndarray, d2: np.ndarray, visits: int) -> list[tuple[int, int]]:
    """The ``visits`` cells (i, j) with the least d1[i] + d2[j], nearest first (multi-sequence)."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1], d2[o2]
    heap, reached, out = [(float(s1[0] + s2[0]), 0, 0)], [0] * len(s1), []
    while heap and len(out) < visits:
        _, a, b = heapq.heappop(heap)
        out.append((int(o1[a]), int(o2[b])))
        reached[a] = b + 1
        # A cell opens once its neighbours nearer to the corner are done.
        if a + 1 < len(s1) and reached[a + 1] == b:
            heapq.heappush(heap, (float(s1[a + 1] + s2[b]), a + 1, b))
        if b + 1 < len(s2) and (a == 0 or reached[a - 1] > b + 1):
            heapq.heappush(heap, (float(s1[a] + s2[b + 1]), a, b + 1))
    return out


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    visits: int

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = max(1, x.shape[1] // 2)  # of one dimension the second half is empty, and all centroids are equally far
        return distances(x[:, :h], self.first), distances(x[:, h:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return np.argmin(a, axis=1) * len(self.second) + np.argmin(b, axis=1)


def build(sample: np.ndarray, count: int, params: MultiIndexParams) -> MultiIndex:
    """Codebooks from the sample, and the visits that reach the target recall.

    Visits are measured on neighbours placed at exactly the cosine asked for, in random
    directions around sampled vectors: the farthest that must be found.
    """
    k = int(min(params.most_centroids, max(1, math.isqrt(max(1, count // params.vectors_per_cell))), len(sample)))
    h = max(1, sample.shape[1] // 2)
    index = MultiIndex(kmeans(sample[:, :h], k, params.kmeans_rounds), kmeans(sample[:, h:], k, params.kmeans_rounds, seed=8), 1)
    rng = np.random.default_rng(9)
    x = sample[rng.permutation(len(sample))[:1000]].astype(np.float64)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1)[:, None] * x
    away /= np.maximum(np.linalg.norm(away, axis=1), 1e-12)[:, None]
    y = params.cosine * x + math.sqrt(1 - params.cosine**2) * away
    d1, d2 = index.halves(x.astype(np.float32))
    cell = index.cells(y.astype(np.float32))
    rows = np.arange(len(x))
    bound = d1[rows, cell // len(index.second)] + d2[rows, cell % len(index.second)]
    rank = np.array([int(((a[:, None] + b[None, :]) <= t + 1e-6).sum()) for a, b, t in zip(d1, d2, bound)])
    index.visits = int(max(1, np.quantile(rank, params.target_recall, method="higher"))) if len(rank) else 1
    return index


def vectors(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v, node): unit vectors of any dimension; equal ones are one node.

    Rows whose id or vector is null, or whose vector is empty, zero or not finite, are left out.
    """
    raw = table.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<float>").alias("v")).where("vec_id is not null and size(v) > 0")
    raw = raw.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    return raw.withColumn("node", F.xxhash64("v"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows of a column of equally long lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def cell_pairs(v: np.ndarray, own: int, cosine: float, large: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Alike pairs that connect one cell's vectors as all alike pairs with one of the first ``own`` do.

    In a large cell, all that is alike to a pivot forms a star and isn't compared with each
    other again. Angles obey the triangle inequality, so only what lies within twice the
    angle can be alike to a member of the star. Where stars are small all pairs are compared.
    """
    near, todo, misses = cosine - 1e-6, np.arange(len(v)), 0
    twice = 2 * near * near - 1 - 1e-5 if near > 0 else -1.0

    def blocks(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for x in range(0, len(a), 512):
            for y in range(0, len(b), 2048):
                i, j = np.nonzero(v[a[x : x + 512]] @ v[b[y : y + 2048]].T >= near)
                yield a[i + x], b[j + y]

    while len(todo) > large and misses < 4:
        likeness = v[todo] @ v[todo[0]]
        inside = likeness >= near
        inside[0] = True
        yield np.full(int(inside.sum()), todo[0]), todo[inside]
        if 16 * int(inside.sum()) < len(todo):
            misses += 1
            todo = todo[1:]
            continue
        yield from blocks(todo[~inside & (likeness >= twice)], todo[inside])
        todo = todo[~inside]
    first = todo[todo < own]
    for x in range(0, len(first), 512):
        yield from blocks(first[x : x + 512], todo[int(np.searchsorted(todo, first[x])) :])


def _links(uniq: DataFrame, size: int, count: int, params: MultiIndexParams) -> DataFrame:
    """Star edges (a, b) with the components of the alike pairs among ``count`` vectors of one dimension."""
    spark = uniq.sparkSession
    centroids = int(min(params.most_centroids, max(1, math.isqrt(max(1, count // params.vectors_per_cell)))))
    want = min(params.most_sampled, max(2000, params.sample_per_centroid * centroids))
    ticket = F.pmod(F.col("node"), F.lit(1_000_000_007)) / 1_000_000_007.0
    few = uniq.where(ticket <= min(1.0, (1.2 * want + 64) / count)).orderBy("node").limit(want).select("v").toArrow().column(0)
    sample = _matrix(few if len(few) else uniq.limit(1).select("v").toArrow().column(0))
    index = build(sample, count, params)
    shared = spark.sparkContext.broadcast(index)
    kind = np.dtype([("cell", "<i8"), ("own", "<i8"), ("node", "<i8"), ("v", "<f4", (size,))])

    def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, n = np.unique(shared.value.cells(_matrix(batch.column(0))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], names=["cell", "n"])

    # Cells too full for one task are cut in parts, of which every pair meets; there are at most count / bucket_records.
    full = uniq.select("v").mapInArrow(count_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > params.bucket_records).collect()
    hot = {r["cell"]: int(-(-r["n"] // (params.bucket_records // 2))) for r in full}
    more = sum(r["n"] * (index.visits + 1) * (hot[r["cell"]] - 2) for r in full)
    buckets = max(1, round((count * (index.visits + 1) + more) / params.bucket_records))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = shared.value
        wide = len(grid.second)
        for batch in in_slices(batches, 1000):
            node, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            d1, d2 = grid.halves(x)
            own = grid.cells(x)
            cells, rows = [own], [np.arange(len(x))]
            for k in range(len(x)):
                seen = np.array([i * wide + j for i, j in traverse(d1[k], d2[k], grid.visits)], dtype=np.int64)
                seen = seen[seen != own[k]]
                cells.append(seen)
                rows.append(np.full(len(seen), k))
            cell, row = np.concatenate(cells), np.concatenate(rows)
            mine, salt = np.arange(len(cell)) < len(x), np.zeros(len(cell), dtype=np.int64)
            if hot and (parts := np.array([hot.get(c, 1) for c in cell.tolist()])).max() > 1:
                times = np.maximum(parts - 1, 1)
                at = np.repeat(np.arange(len(cell)), times)
                other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                part = (node[row[at]].view("<u8") % parts[at].astype(np.uint64)).astype(np.int64)
                other += other >= part
                cell, row, mine, parts = cell[at], row[at], mine[at], parts[at]
                salt = np.where(parts > 1, np.minimum(part, other) * parts + np.maximum(part, other) + 1, 0)
            r = np.empty(len(cell), dtype=kind)
            r["cell"], r["node"], r["v"], r["own"] = cell, node[row], x[row], mine
            mixed = ((cell.astype(np.uint64) ^ (salt.astype(np.uint64) << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            bucket = (mixed % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            r, bucket = r[order], bucket[order]
            begin = np.flatnonzero(np.diff(bucket, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.array([r[s:e].tobytes() for s, e in zip(begin, [*begin[1:], len(r)])], pa.binary())], names=["bucket", "data"])

    def verify(_: tuple, blobs: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(b for c in blobs.column("data").chunks for b in c.to_pylist()), dtype=kind)
        r = r[np.lexsort((-r["own"], r["cell"]))]
        node, place = np.unique(r["node"], return_inverse=True)
        begin = np.flatnonzero(np.diff(r["cell"], prepend=r["cell"][:1] - 1))
        pairs_a, pairs_b, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for s, e in zip(begin, [*begin[1:], len(r)]):
            for i, j in cell_pairs(np.ascontiguousarray(r["v"][s:e]), int(r["own"][s:e].sum()), params.cosine):
                i, j = place[i + s], place[j + s]
                pairs_a.append(i[i != j])
                pairs_b.append(j[i != j])
                held += len(pairs_a[-1])
                if held > 1 << 20:
                    label = min_labels(np.concatenate(pairs_a), np.concatenate(pairs_b), len(node))
                    at = np.flatnonzero(label != np.arange(len(node)))
                    pairs_a, pairs_b, held = [at], [label[at]], len(at)
        label = min_labels(np.concatenate(pairs_a), np.concatenate(pairs_b), len(node))
        a = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[label[a]], pa.int64())})

    return uniq.select("node", "v").mapInArrow(probe, "bucket int, data binary").groupBy("bucket").applyInArrow(verify, "a long, b long")


def near_copies(table: DataFrame, params: MultiIndexParams = MultiIndexParams(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, kept_vec_id, group_size): each vector with a near copy but the group's smallest id.

    Groups are the connected components of the verified pairs. Rows that repeat an id are
    told apart by their vector; equal rows count once. Vectors of each dimension have an
    index of their own, since only they can be compared. Rows whose id or vector is null,
    or whose vector is empty, zero or not finite, have no copies; an empty table gives no
    row. A cosine of exactly the threshold counts as alike. Only id and vector are read,
    so other columns can't clash; the id keeps its type.
    """
    every = cut(vectors(table, vec_id, embedding).distinct())
    uniq = cut(every.groupBy("node").agg(F.first("v").alias("v")).withColumn("dim", F.size("v")))
    sizes = uniq.groupBy("dim").count().orderBy("dim").collect()
    found = [_links(uniq.where(F.col("dim") == r["dim"]), r["dim"], r["count"], params) for r in sizes]
    labels = components(reduce(DataFrame.unionByName, found)) if found else table.sparkSession.createDataFrame([], "node long, label long")
    named = every.select("vec_id", "node").join(labels, "node", "left").select("vec_id", "node", F.coalesce("label", "node").alias("label"))
    best = named.groupBy("label").agg(F.min(F.struct("vec_id", "node")).alias("kept"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return named.join(best, "label").where("vec_id <> kept.vec_id or node <> kept.node").select("vec_id", F.col("kept.vec_id").alias("kept_vec_id"), "group_size")


#: The exact groups, by comparing all pairs: the index finds 97 of 100 at the threshold itself and nearly all above.
ORACLE_SQL = """
WITH RECURSIVE unit AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
edge AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95 - 1e-6),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
grouped AS (SELECT a AS vec_id, least(a, min(b)) AS kept_vec_id FROM reach GROUP BY a)
SELECT vec_id, kept_vec_id, CAST(count(*) OVER (PARTITION BY kept_vec_id) AS BIGINT) AS group_size FROM grouped QUALIFY vec_id <> kept_vec_id"""

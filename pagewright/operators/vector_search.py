"""Exact cosine search over a table of vectors, the keyword test after it, and upserts."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..schemas import SearchRequest


class EmbeddingClient(Protocol):
    def embed_texts(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class VectorStore(Protocol):
    """What a store of chunk vectors offers; ``Service`` keeps one in Parquet folders."""

    def upsert(self, chunks: DataFrame) -> int: ...

    def query(self, vector: list[float], k: int, document_id: str | None = None) -> DataFrame: ...

    def delete_document(self, document_id: str) -> None: ...


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in doubles; null where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def top_k(vectors: DataFrame, query: list[float], k: int, document_id=None, min_similarity: float | None = None, scope: str = "document_id", key: str = "chunk_id") -> DataFrame:
    """The k nearest vectors, ties by key; similarity is 1 - distance, held within 0..1.

    The scope filter comes before the search and reaches the scan. The similarity bound
    comes after the limit, so fewer than k rows may remain. Vectors without length sort
    last and are dropped after the limit, so each score is computed once.
    """
    rows = vectors if document_id is None else vectors.where(F.col(scope) == F.lit(document_id))
    score = cosine(F.col("embedding"), F.array(*[F.lit(float(v)) for v in query]))
    best = rows.withColumn("__score", score).orderBy(F.desc("__score"), key).limit(k).where(F.col("__score").isNotNull())
    best = best.withColumn("similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__score")))).drop("__score")
    return best if min_similarity is None else best.where(F.col("similarity") >= min_similarity)


def with_rows(best: DataFrame, stored: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The rows of ``stored`` beside the few rows of a top-k result, read by their keys alone.

    The k keys, bounded by the search, reach the scan as an IN filter. Exploding one array
    keeps later filters on the stored columns above the join: the optimiser would else move
    them down to the scan and test the whole table.
    """
    rows = best.collect()
    few = best.sparkSession.createDataFrame(rows, best.schema)
    wanted = stored.where(F.col(key).isin(*[r[key] for r in rows]) if rows else F.lit(False))
    others = [c for c in stored.columns if c != key]
    joined = wanted.join(F.broadcast(few), key).select(*best.columns, F.explode(F.array(F.struct(*others))).alias("__row"))
    return joined.select(*best.columns, *[F.col(f"__row.{c}").alias(c) for c in others])


def top_k_join(queries: DataFrame, vectors: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """The k nearest vectors of each query row (query_id, query): one pass for all queries."""
    pairs = queries.crossJoin(vectors).withColumn("similarity", cosine(F.col("embedding"), F.col("query")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), key))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).drop("query", "embedding")


def top_k_blocks(queries: DataFrame, vectors: DataFrame, k: int, key: str = "chunk_id", block: int = 32768) -> DataFrame:
    """``top_k_join`` for as many queries as there are vectors: (query_id, key, rank, similarity).

    A partition holds one block of queries and streams its share of the vectors past them in
    Arrow batches of plain rows, so Python holds the block, a batch and the best so far, whatever
    the tables' sizes; only k rows a query and share are shuffled after it. Products in single
    precision merely find candidates, with a margin for their rounding; the cosines of those
    that stay are summed in doubles and in order as ``cosine`` does, so ties fall to the smallest
    key. Vectors without length are nobody's neighbour and have none. Ids are longs.
    """
    spark = queries.sparkSession
    some = queries.where(F.col("query_id").isNotNull() & F.col("query").isNotNull())
    n, width = some.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("query")), F.lit(1))).first()
    parts = max(1, -(-n // max(1, min(block, 64 * block // max(1, width)))))
    shares = max(1, -(-2 * spark.sparkContext.defaultParallelism // parts))
    of = lambda name, m: F.pmod(F.xxhash64(name), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    q = some.select(F.lit(0).alias("side"), F.col("query_id").cast("long").alias("id"), F.col("query").alias("v"), of("query_id", parts).alias("p"), every(shares).alias("s"))
    v = vectors.where(F.col(key).isNotNull() & F.col("embedding").isNotNull()).select(F.lit(1).alias("side"), F.col(key).cast("long").alias("id"), F.col("embedding").alias("v"), of(key, shares).alias("s"), every(parts).alias("p"))
    place = (F.col("p") * shares + F.col("s")).alias("cell")
    rows = q.select(place, "side", "id", "v").unionByName(v.select(place, "side", "id", "v"))
    cells = rows.repartitionById(parts * shares, F.col("cell")).sortWithinPartitions("side")
    best = cells.select("side", "id", "v").mapInArrow(lambda batches: _best_of_cell(batches, k, key), f"query_id long, {key} long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), key))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def _best_of_cell(batches, k: int, key: str):
    """The k best of the vectors (side 1) for each query (side 0); all queries come first."""
    import numpy as np
    import pyarrow as pa

    def matrix(batch):
        """Ids, vectors, norms and unit vectors in single precision of the rows that have a length."""
        ids, cells = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v")
        flat = cells.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and len(set(cells.value_lengths().to_pylist())) > 1:
            raise ValueError("vectors of different lengths")
        v = flat.reshape(len(ids), -1)
        square = np.zeros(len(v))
        for j in range(v.shape[1]):
            square += v[:, j].astype(np.float64) ** 2
        with_length = square > 0
        ids, v, norm = ids[with_length], v[with_length], np.sqrt(square[with_length])
        return ids, v, norm, (v / norm[:, None]).astype(np.float32)

    def cosines(a, x, xn):
        out = np.empty(len(a))
        for at in range(0, len(a), 8192):
            some = slice(at, at + 8192)
            left, right, dot = qv[a[some]].astype(np.float64).T.copy(), x[some].astype(np.float64).T.copy(), 0.0
            for j in range(len(left)):
                dot = dot + right[j] * left[j]
            out[some] = dot / (xn[some] * qn[a[some]])
        return out

    def exact(a, ids, x, xn):
        """Places of the k best of each query, and their cosines."""
        s = cosines(a, x, xn)
        order = np.lexsort((ids, -s, a))
        first = np.arange(len(a)) - np.searchsorted(a[order], a[order])
        keep = order[first < k]
        return keep, s[keep]

    def pruned(pool):
        """The candidates that may still be among the k best; least[q] is what a new one must reach."""
        a, score, ids, x, xn = (np.concatenate(c) for c in zip(*pool))
        order = np.lexsort((-score, a))
        a, score = a[order], score[order]
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        last = nth == k - 1
        least[a[last]] = score[last] - margin
        keep = score >= least[a]
        a, score, order = a[keep], score[keep], order[keep]
        crowded = np.bincount(a, minlength=len(qi))[a] > 2 * k
        if crowded.any():  # many ties: decide them now
            where = np.flatnonzero(crowded)
            stay, _ = exact(a[where], ids[order[where]], x[order[where]], xn[order[where]])
            keep = np.sort(np.concatenate([np.flatnonzero(~crowded), where[stay]]))
            a, score, order = a[keep], score[keep], order[keep]
        return [(a, score, ids[order], x[order], xn[order])]

    head, pool, pooled, limit = [], [], 0, 0
    qi = None
    for batch in batches:
        side = batch.column("side").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(side, 1))
        if cut:
            head.append(matrix(batch.slice(0, cut)))
        if cut == batch.num_rows:
            continue
        if qi is None:
            if not head:
                return
            qi, qv, qn, unit = (np.concatenate(c) for c in zip(*head))
            head, least = [], np.full(len(qi), -np.inf, dtype=np.float32)
            margin = np.float32((unit.shape[1] + 8) * 2.0**-22)
        ids, v, norm, vu = matrix(batch.slice(cut))
        if len(ids) and len(qi) and v.shape[1] != qv.shape[1]:
            raise ValueError("vectors of different lengths")
        for at in range(0, len(ids), 2048):
            here = np.ascontiguousarray(vu[at : at + 2048].T)
            for low in range(0, len(qi), 1024):
                score, bound = unit[low : low + 1024] @ here, least[low : low + 1024]
                if np.isneginf(bound).any() and score.shape[1] >= k:
                    bound = np.maximum(bound, np.partition(score, -k, axis=1)[:, -k] - margin)
                found = np.flatnonzero(score >= bound[:, None])
                a, b = found // score.shape[1] + low, found % score.shape[1]
                score = score.ravel()[found]
                if len(a) > 8 * k * 1024:  # many ties: no more than k a query go on
                    stay = []
                    for part in np.array_split(np.arange(len(a)), -(-len(a) // 65536)):
                        stay.append(part[exact(a[part], ids[at + b[part]], v[at + b[part]], norm[at + b[part]])[0]])
                    stay = np.concatenate(stay)
                    a, b, score = a[stay], b[stay], score[stay]
                if len(a):
                    pool.append((a, score, ids[at + b], v[at + b], norm[at + b]))
                    pooled += len(a)
                if pooled > limit + 4 * k * len(qi):
                    pool = pruned(pool)
                    pooled = limit = len(pool[0][0])
            if pooled > 1.5 * limit:
                pool = pruned(pool)
                pooled = limit = len(pool[0][0])
    if pool:
        a, _, ids, x, xn = (np.concatenate(c) for c in zip(*pool))
        keep, s = exact(a, ids, x, xn)
        yield pa.RecordBatch.from_arrays([pa.array(qi[a[keep]], pa.int64()), pa.array(ids[keep], pa.int64()), pa.array(s, pa.float64())], names=["query_id", key, "similarity"])


def keyword_filter(results: DataFrame, query: str) -> DataFrame:
    """Results that pass the query's keywords; see ``keywords.matches``."""
    return results.where(K.matches(K.tokens(F.lit(query)), K.tokens(F.col("text"))))


def enrich_source(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Put the catalogue's file name, where it has one, in place of ``source_file``.

    Results are the bounded side; the catalogue is joined by key and never broadcast by hand.
    """
    names = catalog.select(F.col("document_id").alias("__id"), F.col("filename").alias("__name"))
    joined = results.join(names, results["document_id"] == names["__id"], "left")
    return joined.withColumn("source_file", F.coalesce(F.nullif("__name", F.lit("")), F.col("source_file"))).drop("__id", "__name")


def upsert(stored: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Stored rows with the new ones in their places; of equal new keys the last ``seq`` wins."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    new = chunks.withColumn("__n", last).where("__n = 1").drop("__n", "seq")
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def delete_document(stored: DataFrame, document_id) -> DataFrame:
    return stored.where(~F.col("document_id").eqNullSafe(F.lit(document_id)))


def with_embeddings(chunks: DataFrame, client: EmbeddingClient, batch: int = 32, limit: int = 6000) -> DataFrame:
    """Add ``embedding`` by a client that runs on the executors, in batches and in order.

    A client that returns another number of vectors than texts fails the task.
    """
    names = chunks.columns

    def run(parts):
        for pdf in parts:
            texts, found = pdf["__sent"].tolist(), []
            for at in range(0, len(texts), batch):
                got = client.embed_texts(texts[at : at + batch])
                if len(got) != len(texts[at : at + batch]):
                    raise ValueError("the client returned another number of vectors than texts")
                found += got
            yield pdf.assign(embedding=found)[[*names, "embedding"]]

    from pyspark.sql import types as T

    sent = chunks.withColumn("__sent", F.coalesce(F.substring("text", 1, limit), F.lit("")))
    return sent.mapInPandas(run, T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def search(vectors: DataFrame, request: SearchRequest, client: EmbeddingClient) -> DataFrame:
    """Embed, search, bound, then test keywords: the limit applies before the keywords."""
    best = top_k(vectors, client.embed_query(request.query), request.n_results, request.document_id, request.min_similarity)
    return keyword_filter(best, request.query)

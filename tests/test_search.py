import math

import pytest
from pyspark.sql import functions as F

from pagewright.operators import catalog as C
from pagewright.operators import jobs as J
from pagewright.operators import vector_search as V
from pagewright.schemas import AgentRequest, SearchRequest

VECTORS = "chunk_id string, document_id string, source_file string, page_number int, text string, embedding array<float>"


class Client:
    def embed_texts(self, texts):
        return [[float(len(t)), 1.0] for t in texts]

    def embed_query(self, text):
        return [1.0, 0.0]


class Short(Client):
    def embed_texts(self, texts):
        return [[1.0, 1.0]] * (len(texts) - 1)


@pytest.fixture
def vectors(spark):
    rows = [("a", "d1", "x", 1, "houve dano moral", [1.0, 0.0]), ("b", "d1", "x", 1, "danos morais sem fim", [1.0, 1.0]), ("c", "d2", "x", 2, "outra coisa", [0.9, 0.1]), ("z", "d2", "x", 2, "oposto", [-1.0, 0.0]), ("n", "d2", "x", 2, "sem norma", [0.0, 0.0])]
    return spark.createDataFrame(rows, VECTORS)


def test_top_k(vectors):
    got = V.top_k(vectors, [1.0, 0.0], 10).collect()
    assert [r.chunk_id for r in got] == ["a", "c", "b", "z"]
    assert got[0].similarity == 1 and got[-1].similarity == 0 and got[2].similarity == pytest.approx(math.sqrt(0.5))
    assert [r.chunk_id for r in V.top_k(vectors, [1.0, 0.0], 10, document_id="d2").collect()] == ["c", "z"]
    assert [r.chunk_id for r in V.top_k(vectors, [1.0, 0.0], 2, min_similarity=0.999).collect()] == ["a"]


def test_plan_is_a_top_k(vectors):
    plan = V.top_k(vectors, [1.0, 0.0], 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_keywords_are_tested_on_the_best_rows_only(spark, vectors, tmp_path):
    """The scan of the texts sees the k keys and no keyword test, which stays above the join."""
    vectors.select("chunk_id", "text").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    best = V.top_k(vectors.select("chunk_id", "embedding"), [1.0, 0.0], 3).select("chunk_id", "similarity")
    found = V.keyword_filter(V.with_rows(best, texts), "dano moral")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(chunk_id" in plan and "regexp_extract_all" in plan
    scan = plan[plan.index("Generate") :]
    assert "regexp_extract_all" not in scan and "FileScan" in scan
    assert {r.chunk_id for r in found.collect()} == {"a", "b"}
    assert V.with_rows(best.where("similarity > 5"), texts).count() == 0


def test_search_filters_after_the_limit(vectors):
    assert [r.chunk_id for r in V.search(vectors, SearchRequest("dano moral", 2), Client()).collect()] == ["a"]
    assert {r.chunk_id for r in V.search(vectors, SearchRequest("dano moral", 3), Client()).collect()} == {"a", "b"}


def test_enrich_and_upsert(spark, vectors):
    cat = spark.createDataFrame([("d1", "um.pdf"), ("d2", "")], "document_id string, filename string")
    assert {r.chunk_id: r.source_file for r in V.enrich_source(vectors, cat).collect()} == {"a": "um.pdf", "b": "um.pdf", "c": "x", "z": "x", "n": "x"}
    stored = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 9, 1)], "chunk_id string, v int, seq int")
    assert sorted(map(tuple, V.upsert(stored, new).collect())) == [("a", 1), ("b", 3), ("c", 9)]
    assert V.delete_document(vectors, "d1").count() == 3


def test_embedding_batches(spark, vectors):
    chunks = vectors.drop("embedding")
    assert {r.chunk_id: r.embedding[0] for r in V.with_embeddings(chunks, Client(), batch=2).collect()}["c"] == 11.0
    with pytest.raises(Exception, match="another number of vectors"):
        V.with_embeddings(chunks, Short()).collect()


@pytest.mark.parametrize("bad", [dict(query=""), dict(query="x", n_results=0), dict(query="x", n_results=101), dict(query="x", min_similarity=1.1)])
def test_requests_are_checked(bad):
    with pytest.raises(ValueError):
        SearchRequest(**bad)
    with pytest.raises(ValueError):
        AgentRequest("x", max_iterations=21)


CAT = "document_id string, file_hash string, filename string, file_size long, pdf_path string, status string, created_at int, processed_at int, error_message string, total_pages int, pages array<struct<page:int,blocks:array<struct<block_id:string,text:string>>>>"


@pytest.fixture
def catalog(spark):
    pages = [(1, [("p1_b1", "Um CONTRATO"), ("p1_b2", None)]), (2, [("p2_b1", "contrato 100%")])]
    return spark.createDataFrame([("1", "h1", "a.pdf", 5, "/a", "processed", 3, 4, None, 2, pages), ("2", "h2", "b.pdf", 6, "/b", "pending", 1, None, "old", None, None), ("3", "h3", "c.pdf", 7, "/c", "pending", 1, None, None, None, None)], CAT)


def test_catalogue(spark, catalog):
    uploads = spark.createDataFrame([("4", "h1", 9), ("5", "h5", 9), ("6", "h5", 8)], "document_id string, file_hash string, created_at int")
    assert sorted(r.document_id for r in C.create(catalog, uploads).collect()) == ["1", "2", "3", "6"]
    assert [r.document_id for r in C.list_page(catalog, None, 2, 1).collect()] == ["3", "1"]
    assert [r.document_id for r in C.list_page(catalog, "pending").collect()] == ["2", "3"] and C.count(catalog, "pending") == 2
    assert C.find_by_hash(catalog, "h2").first().document_id == "2"
    assert [r.block_id for r in C.search_text(catalog, "1", "contrato").collect()] == ["p1_b1", "p2_b1"]
    assert [r.block_id for r in C.search_text(catalog, "1", "0%").collect()] == ["p2_b1"]
    changes = spark.createDataFrame([("2", "failed", None), ("3", "failed", "bad")], "document_id string, status string, error_message string")
    assert {r.document_id: (r.status, r.error_message) for r in C.update_status(catalog, changes).collect()} == {"1": ("processed", None), "2": ("failed", "old"), "3": ("failed", "bad")}
    parsed = catalog.where("document_id = '1'").select(F.lit("2").alias("document_id"), "pages", "total_pages", F.lit(7).alias("processed_at"))
    r = C.get(C.save_parsed(catalog, parsed), "2").first()
    assert (r.status, r.total_pages, r.processed_at, r.error_message) == ("processed", 2, 7, "old")
    assert C.get(C.update_pdf_path(catalog, spark.createDataFrame([("1", "/new")], "document_id string, pdf_path string")), "1").first().pdf_path == "/new"


@pytest.mark.parametrize("which,code", [("1", None), (None, None), ("2", 409), ("9", 404)])
def test_readiness(catalog, which, code):
    if code is None:
        C.require_ready(catalog, which)
    else:
        with pytest.raises(C.NotReady) as e:
            C.require_ready(catalog, which)
        assert e.value.code == code
    with pytest.raises(C.NotReady):
        C.require_ready(None, "1")


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a"), (5, None), (6, None)], "k int, t string")
    got = {(r.k, r.first_k) for r in C.duplicates(df, "t", "k").collect()}
    assert {(3, 1), (4, 1)} <= got


EVENTS = "job_id string, seq long, ts int, status string, error_message string, file_hash string"


def test_job_fold(spark):
    rows = [("a", 1, 1, "queued", None, None), ("a", 2, 2, "processing", None, "h"), ("a", 3, 3, "failed", "boom", None), ("a", 4, 4, "queued", "", None), ("a", 5, 5, "processing", None, None), ("a", 6, 6, "uploaded", None, None), ("b", 1, 2, "queued", None, None), ("c", 1, 1, "queued", None, None), ("c", 2, 1, "processing", None, None)]
    jobs = J.job_states(spark.createDataFrame(rows, EVENTS))
    got = {r.job_id: r for r in jobs.collect()}
    a = got["a"]
    assert (a.status, a.created_at, a.started_at, a.completed_at, a.error_message, a.file_hash) == ("uploaded", 1, 2, 6, "boom", "h")
    assert got["c"].status == "processing" and J.next_queued(jobs).first().job_id == "b"
    assert [r.job_id for r in J.list_page(jobs, 2, 1).collect()] == ["b", "c"] and J.count(jobs) == 3 and J.get(jobs, "zz").count() == 0


def test_top_k_blocks_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    some = [[float(rng.randint(-3, 3)) for _ in range(6)] for _ in range(90)]
    rows = [(k, v) for k, v in enumerate([*some, *some[:20], [0.0] * 6])]

    def cos(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        return dot(b, a) / (math.sqrt(dot(b, b)) * math.sqrt(dot(a, a)))

    whole = [r for r in rows if any(r[1])]
    want = {(q, n + 1): c for q, x in whole for n, (_, c) in enumerate(sorted((-cos(x, y), c) for c, y in whole)[:4])}
    v = spark.createDataFrame([*rows, (500, None)], "chunk_id long, embedding array<float>")
    q = v.selectExpr("chunk_id AS query_id", "embedding AS query")
    got = {(r.query_id, r.rank): r.chunk_id for r in V.top_k_blocks(q, v, 4, block=16).collect()}
    assert got == want


def test_top_k_blocks_streams_plain_rows_and_decides_many_ties(spark):
    """Copies by the thousand: the smallest keys win, and no pair of blocks travels as a row."""
    rows = [(k, [1.0, 0.0] if k % 2 else [0.0, 2.0]) for k in range(6000)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    q = v.selectExpr("chunk_id AS query_id", "embedding AS query")
    best = V.top_k_blocks(q, v, 2, block=1500)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {(r.query_id, r.rank): (r.chunk_id, r.similarity) for r in best.collect()}
    assert got == {(k, n): (2 * n - 2 + k % 2, 1.0) for k in range(6000) for n in (1, 2)}

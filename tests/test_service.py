import pytest

from pagewright.operators.catalog import NotReady
from pagewright.plans.service import ParquetVectors, Service
from pagewright.schemas import CHUNK, AgentRequest, SearchRequest
from pagewright.sources.tables import VersionedTable

from .test_plans import GOOD, Chat, Engine, Reader


class Client:
    def embed_texts(self, texts):
        return [[float(len(t)), 1.0] for t in texts]

    def embed_query(self, text):
        return [1.0, 0.0]


LONG = GOOD.replace("Hello", "contrato de locacao com clausulas suficientes para um trecho longo")


def test_from_upload_to_answer(spark, tmp_path):
    s = Service(spark, str(tmp_path), Reader(), Engine(), Client(), Chat({"content": "done"}))
    files = spark.createDataFrame([("/in/a.pdf", LONG.encode()), ("/in/b.pdf", LONG.encode()), ("/in/c.txt", b"x"), ("/in/bad.pdf", b"%PDF-{")], "path string, content binary")
    codes = {r.path: r.code for r in s.submit(files).collect()}
    assert codes == {"/in/a.pdf": 202, "/in/b.pdf": 409, "/in/c.txt": 400, "/in/bad.pdf": 202}
    assert s.list_jobs()[1] == 2 and s.list_documents("pending")[1] == 2
    assert s.work(jobs=1) == 1 and s.run_worker(until_empty=True) == 1 and s.work(files) == 0
    states = {r.filename: (r.document_id, r.status) for r in s.catalog.collect()}
    assert states["a.pdf"][1] == "processed" and states["bad.pdf"][1] == "failed"
    assert {r.status for r in s.jobs.collect()} == {"uploaded", "failed"}
    assert s.get_job(states["bad.pdf"][0]).first().error_message
    assert s.wait_for(states["bad.pdf"][0]) == "failed" and s.wait_for(states["a.pdf"][0], timeout=0) == "uploaded"
    doc = states["a.pdf"][0]
    found = s.search(SearchRequest("contrato de locacao", document_id=doc))
    assert found["total_matches"] == 1 and found["results"][0]["source_file"] == "a.pdf"
    assert s.agent_search(AgentRequest("q", document_id=doc)).answer == "done"
    with pytest.raises(NotReady) as e:
        s.search(SearchRequest("x", document_id=states["bad.pdf"][0]))
    assert e.value.code == 409
    with pytest.raises(NotReady) as e:
        s.document_status("nope")
    assert e.value.code == 404 and s.document_status(doc) == "processed"
    with pytest.raises(NotReady):
        s.list_documents("odd")
    out = s.artifacts(doc, str(tmp_path / "art"))
    assert spark.read.parquet(out["overlay_path"]).count() == 2
    assert {r.path: r.code for r in s.submit(files).collect()}["/in/a.pdf"] == 409
    bare = Service(spark, str(tmp_path), Reader())
    assert bare.healthcheck() == {"status": "ok", "search": False, "agent": False}
    with pytest.raises(NotReady) as e:
        bare.search(SearchRequest("x"))
    assert e.value.code == 503


def test_vectors_are_replaced_by_document(spark, tmp_path):
    store = ParquetVectors(spark, str(tmp_path))
    row = lambda c, d, v: (c, d, "f", 1, "b", "paragraph", c, 1.0, v)
    chunks = lambda *r: spark.createDataFrame(list(r), CHUNK + ", embedding array<float>")
    assert store.upsert(chunks(row("a1", "a", [1.0, 0.0]), row("a2", "a", [0.0, 1.0]), row("b1", "b", [1.0, 1.0]))) == 3
    assert store.upsert(chunks(row("a1", "a", [0.0, 2.0]))) == 1
    assert {(r.chunk_id, tuple(r.embedding)) for r in store.read().collect()} == {("a1", (0.0, 2.0)), ("b1", (1.0, 1.0))}
    assert [r.chunk_id for r in store.query([1.0, 0.0], 5).collect()] == ["b1", "a1"]
    store.delete_document("b")
    assert [r.chunk_id for r in store.read().collect()] == ["a1"]


def test_a_broken_batch_keeps_its_traceback(spark, tmp_path):
    class Torn(Reader):
        def pages(self, doc, content):
            yield {"doc_id": doc, "page": "no number"}

    s = Service(spark, str(tmp_path), Torn())
    s.submit(spark.createDataFrame([("/a.pdf", GOOD.encode())], "path string, content binary"))
    assert s.work() == 1
    job = s.jobs.first()
    assert job.status == "failed" and "Traceback" in job.error_message


def test_versions(spark, tmp_path):
    t = VersionedTable(str(tmp_path / "t"), "a int, b string")
    assert t.read(spark).count() == 0
    t.write(spark.createDataFrame([(1, "x")], "a int, b string"))
    for k in range(3):
        t.write(t.read(spark).selectExpr("b", "a + 1 as a"))
    assert [tuple(r) for r in t.read(spark).collect()] == [(4, "x")]
    (tmp_path / "t" / "v00000099").mkdir()
    assert t.read(spark).first().a == 4
    t.write(t.read(spark))
    assert t.read(spark).first().a == 4

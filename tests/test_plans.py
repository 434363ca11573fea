import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.operators import agent_results as A
from pagewright.plans import agent, documents
from pagewright.schemas import AgentRequest, DOCUMENT
from pagewright.sources import files, images
from pagewright.streaming import jobs as S


class Reader:
    """A file is JSON: a list of pages with words, images, tables."""

    def _load(self, content):
        return json.loads(content.decode().removeprefix("%PDF-"))

    def pages(self, doc, content):
        for k, p in enumerate(self._load(content), 1):
            yield {"doc_id": doc, "page": k, "width": 100.0, "height": 100.0, "text": p.get("text", "")}

    def words(self, doc, content):
        for k, p in enumerate(self._load(content), 1):
            for n, (t, x, y) in enumerate(p.get("words", [])):
                yield {"doc_id": doc, "page": k, "pos": n, "text": t, "x0": x, "x1": x + 20.0, "top": y, "bottom": y + 8.0}

    def images(self, doc, content):
        for k, p in enumerate(self._load(content), 1):
            if p.get("image"):
                yield {"doc_id": doc, "page": k, "x0": 0.0, "x1": 100.0, "top": 0.0, "bottom": 90.0}

    def tables(self, doc, content):
        for k, p in enumerate(self._load(content), 1):
            if "table" in p:
                yield {"doc_id": doc, "page": k, "table_no": 2, "accuracy": 90.0, "rows": p["table"], "bbox": {"x1": 0.0, "y1": 0.0, "x2": 100.0, "y2": 50.0}, "width": 100.0, "height": 100.0}


class Engine:
    def recognise(self, doc, page, content):
        for n, w in enumerate(["scanned", "words", "here"]):
            yield {"doc_id": doc, "page": page, "block_no": 0, "line_no": 0, "word_no": n, "value": w, "confidence": 0.9, "line_bbox": {"x1": 0.1, "y1": 0.1, "x2": 0.9, "y2": 0.2}}


GOOD = "%PDF-" + json.dumps([{"words": [("Hello", 0.0, 5.0), ("there", 30.0, 6.0), ("hidden", 0.0, 60.0)], "table": [["a", "b"], ["", None]]}, {"image": True}, {"text": "bare text"}])


@pytest.fixture
def uploads(spark):
    return spark.createDataFrame([("d", "d.pdf", GOOD.encode()), ("bad", "bad.pdf", b"%PDF-{")], "doc_id string, source_file string, content binary")


@pytest.fixture(scope="module")
def processed(spark):
    """Both files processed once; the rows as a plain table."""
    files = spark.createDataFrame([("d", "d.pdf", GOOD.encode()), ("bad", "bad.pdf", b"%PDF-{")], "doc_id string, source_file string, content binary")
    return spark.createDataFrame(documents.process(files, Reader(), Engine()).collect(), DOCUMENT)


def test_documents_end_to_end(spark, processed):
    got = {r.doc_id: r for r in processed.collect()}
    pages = got["d"].pages
    assert [(p.page, p.source, [b.text for b in p.blocks]) for p in pages] == [(1, "digital", ["Hello there", None]), (2, "ocr", ["scanned words here"]), (3, "ocr", ["scanned words here"])]
    assert pages[0].blocks[1].rows == [["a", "b"]] and pages[0].blocks[1].block_id == "p1_t2" and pages[1].blocks[0].lines[0].text == "scanned words here"
    assert [p.source for p in got["bad"].pages] == ["ocr"]
    totals = {r.doc_id: (r.total_pages, r.n_blocks, r.n_tables) for r in documents.summary(processed).collect()}
    assert totals["d"] == (3, 4, 1)


def test_without_an_engine(spark, uploads):
    got = {r.doc_id: [len(p.blocks) for p in r.pages] for r in documents.process(uploads, Reader()).collect()}
    assert got["d"] == [2, 0, 0]


class WordTable:
    """Fails on page 2, in the other shape of rows."""

    def word_table(self, doc, page, content):
        if page == 2:
            raise RuntimeError("too dark")
        for n, w in enumerate(["table", "words"]):
            yield {"doc_id": doc, "page": page, "word_pos": n, "block_num": 1, "text": w, "conf": 90.0, "left": 1.0 + n, "top": 1.0, "width": 5.0, "height": 2.0}


class Batches:
    batch_pages = 2

    def recognise_batch(self, pages):
        if any(p == 3 for _, p, _ in pages):
            raise RuntimeError("page 3")
        for d, p, _ in pages:
            yield {"doc_id": d, "page": p, "block_no": 0, "line_no": 0, "word_no": 0, "value": f"batch of {len(pages)}", "confidence": 0.9, "line_bbox": {"x1": 0.1, "y1": 0.1, "x2": 0.9, "y2": 0.2}}


def test_engines_in_turn_and_in_batches(spark):
    files = spark.createDataFrame([("d", "d.pdf", GOOD.encode())], "doc_id string, source_file string, content binary")
    texts = lambda p: [[b.text for b in x.blocks if b.type != "table"] for x in p.documents.first().pages]
    both = documents.parse(files, Reader(), [WordTable(), Engine()])
    assert texts(both)[1:] == [["scanned words here"], ["table words"]] and both.errors.count() == 0
    alone = documents.parse(files, Reader(), WordTable(), keep=True)
    assert texts(alone)[1:] == [[], ["table words"]]
    assert [(r.page, r.step, r.error) for r in alone.errors.collect()] == [(2, "recognise", "RuntimeError: too dark")]
    alone.release()
    some = documents.parse(files, Reader(), Batches())
    assert texts(some)[1] == ["batch of 1"] and [(r.page, r.error) for r in some.errors.collect()] == [(3, "RuntimeError: page 3")]


def test_what_a_reader_fails_on_is_reported(spark):
    class Half(Reader):
        def tables(self, doc, content):
            raise ValueError("no tables")

    files = spark.createDataFrame([("d", "d.pdf", GOOD.encode())], "doc_id string, source_file string, content binary")
    got = documents.parse(files, Half())
    assert [(r.step, r.error) for r in got.errors.collect()] == [("tables", "ValueError: no tables")]
    assert got.documents.first().pages[0].blocks[0].text.startswith("Hello")


def test_json_round_trip(spark, processed, tmp_path):
    docs = processed
    files.write_documents(docs, str(tmp_path / "j"))
    back = files.read_documents(spark, str(tmp_path / "j"))
    assert back.count() == 2 and back.where("doc_id = 'd'").first().pages[0].blocks[0].text == "Hello there"
    assert '"rows":null' in files.document_json(docs).where("doc_id = 'd'").first().json


def test_uploads(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1"), ("b.PDF", b"%PDF-1"), ("c.txt", b"%PDF-1"), ("d.pdf", b"no")):
        (tmp_path / name).write_bytes(data)
    got = files.accept_uploads(files.read_uploads(spark, str(tmp_path))).collect()
    assert [r.path.split("/")[-1] for r in got] == ["a.pdf"]


def test_worker_stream(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.pdf").write_bytes(GOOD.encode())
    run = lambda: S.start_worker(spark, inbox, out, state, lambda f: f.select("doc_id", "source_file", F.lit(1).alias("total_pages")), interval=None).awaitTermination()
    run()
    (tmp_path / "in" / "again.pdf").write_bytes(GOOD.encode())
    (tmp_path / "in" / "new.pdf").write_bytes(GOOD.replace("Hello", "Other").encode())
    run()
    rows = spark.read.schema(DOCUMENT).option("recursiveFileLookup", "true").parquet(out).collect()
    assert sorted(r.source_file for r in rows) == ["new.pdf", "x.pdf"]


class Chat:
    def __init__(self, *replies):
        self.replies, self.seen = list(replies), []

    def chat(self, messages, tools=None):
        self.seen.append((list(messages), tools))
        r = self.replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r


class Embed:
    def embed_query(self, text):
        return [1.0, 0.0]


@pytest.fixture
def registry(spark):
    vectors = spark.createDataFrame([("d1:1:a", "d1", "f", 1, "dano moral grave", [1.0, 0.0]), ("d2:1:a", "d2", "f", 1, "dano moral leve", [0.9, 0.1])], "chunk_id string, document_id string, source_file string, page_number int, text string, embedding array<float>")
    pages = [(1, [("p1_b1", "o dano")])]
    catalog = spark.createDataFrame([("d1", "um.pdf", "processed", 1, 1, 1, pages), ("d2", "dois.pdf", "processed", 1, 2, 1, pages)], "document_id string, filename string, status string, total_pages int, created_at int, file_size int, pages array<struct<page:int,blocks:array<struct<block_id:string,text:string>>>>")
    return agent.ToolRegistry(vectors, catalog, Embed())


def test_tools(registry):
    lines = [json.loads(x) for x in registry.execute("search_chunks", {"query": "dano moral", "n_results": "2"}).split("\n")]
    assert [x["document_id"] for x in lines] == ["d1", "d2"] and lines[0]["filename"] == "um.pdf"
    own = registry.scoped_to("d2")
    assert [json.loads(x)["document_id"] for x in own.execute("search_chunks", {"query": "dano moral", "document_id": "d1"}).split("\n")] == ["d2"]
    assert json.loads(own.execute("list_documents", {}))["document_id"] == "d2"
    assert json.loads(registry.execute("search_document_text", {"document_id": "d1", "query": "DANO"}))["chunk_id"] == "p1_b1"
    assert registry.execute("nope", {}) == "Unknown tool: nope" and "failed" in registry.execute("get_document", {"wrong": 1})
    assert registry.execute("search_chunks", {"query": "dano moral"}, max_chars=20).endswith("... [truncado]")
    assert "document_id" not in agent.tool_schemas(True)[0]["function"]["parameters"]["properties"]


def test_agent_loop(spark, registry):
    call = {"content": "", "tool_calls": [{"id": "1", "name": "search_chunks", "arguments": json.dumps({"query": "dano moral"})}]}
    text = {"content": "<tool_call><function=get_document><parameter=document_id>d1</parameter></function></tool_call>"}
    chat = Chat(call, text, {"content": "Answer <tool_call>x</tool_call>"})
    got = agent.AgentRunner(spark, chat, registry).run(AgentRequest("q"))
    assert (got.answer, got.iterations) == ("Answer", 3)
    assert [(s["document_id"], s["chunk_id"]) for s in got.sources] == [("d1", "d1:1:a"), ("d2", "d2:1:a")]
    chat = Chat(call, {"content": "late"})
    got = agent.AgentRunner(spark, chat, registry).run(AgentRequest("q", max_iterations=2))
    assert (got.answer, got.iterations) == ("late", 2) and chat.seen[1][1] is None
    tight = agent.AgentRunner(spark, Chat({"content": "forced"}), registry, EngineConfig(agent_char_budget=100)).run(AgentRequest("q" * 95))
    assert (tight.answer, tight.iterations) == ("forced", 1)
    broken = agent.AgentRunner(spark, Chat({"content": ""}, RuntimeError("down")), registry).run(AgentRequest("q"))
    assert broken.answer == ""
    assert agent.AgentRunner._arguments("{bad") == {} and agent.AgentRunner._arguments("[1]") == {}


def test_markup_on_both_sides(spark):
    text = "<tool_call><function=f><parameter=a>1</parameter><parameter=a>2</parameter><parameter=b> x\ny </parameter></function><function=g></function></tool_call><tool_call>none</tool_call>"
    got = spark.createDataFrame([(text,)], "t string").select(A.parse_tool_calls(F.col("t")).alias("c")).first().c
    assert [(c.name, json.loads(c.arguments)) for c in got] == [("f", {"a": "2", "b": "x\ny"})]
    assert agent.text_tool_calls(text) == [{"name": "f", "arguments": {"a": "2", "b": "x\ny"}}]


def test_sources_first_mention_and_cut_lines(spark):
    a = json.dumps({"document_id": "d", "chunk_id": "c", "page": 1, "text": "first"})
    rows = [(0, a + "\nnoise\n" + a.replace("first", "second")), (1, a[:30] + "... [truncado]"), (2, json.dumps({"document_id": "d", "page": 2})), (3, json.dumps({"document_id": "e"}))]
    got = A.sources(spark.createDataFrame(rows, "result_no int, content string")).orderBy("result_no").collect()
    assert [(r.text, r.page) for r in got] == [("first", 1), (None, 2)]


def test_config():
    c = EngineConfig.from_env({"PAGEWRIGHT_TABLE_ACCURACY": "0.5", "PAGEWRIGHT_OCR_MERGE_WORDS": "yes", "PAGEWRIGHT_SEARCH_RESULTS": " "})
    assert (c.table_accuracy, c.ocr_merge_words, c.search_results) == (0.5, True, 10)
    with pytest.raises(ValueError):
        EngineConfig.from_env({"PAGEWRIGHT_OCR_CLEAN": "maybe"})


def test_images():
    page = np.full((80, 120), 255, np.uint8)
    page[20:24, 10:110] = 0
    page[50:54, 10:110] = 0
    assert set(np.unique(images.binarize(page))) == {0, 255} and images.prepare(page).shape == (80, 120, 3) and images.prepare(np.zeros((4, 4, 4))).shape == (4, 4, 3)
    assert images.skew_angle(page) == 0 and images.deskew(page) is page
    y, x = np.mgrid[0:80, 0:120]
    tilted = np.where(np.abs(y - 40 - (x - 60) * np.tan(np.radians(4))) < 2, 0, 255).astype(np.uint8)
    assert abs(abs(images.skew_angle(tilted)) - 4) <= 0.5 and abs(images.skew_angle(images.deskew(tilted))) <= 1
    dot = page.copy()
    dot[70, 70] = 0
    assert images.remove_noise(dot)[70, 70] == 255 and images.remove_borders(page).shape == (60, 100) and images.resize_to_dpi(page, 150).shape == (160, 240)
    assert images.preprocess(np.stack([page] * 3, -1)).shape == page.shape and images.binarize(page, "adaptive").shape == page.shape
    with pytest.raises(ValueError):
        images.binarize(page, "other")


def test_images_in_a_table(spark):
    page = np.full((40, 60), 250, np.uint8)
    page[10:12, 5:50] = 10
    colour = np.stack([page] * 3, -1)
    rows = [("d", 1, 40, 60, 1, page.tobytes()), ("d", 2, 40, 60, 3, colour.tobytes()), ("d", 3, 40, 60, 1, None)]
    table = spark.createDataFrame(rows, "doc_id string, page int, height int, width int, channels int, pixels binary")
    got = {r.page: r for r in images.transform_pages(table, ["gray", "binarize"]).collect()}
    assert got[3].pixels is None and got[2].channels == 1
    assert bytes(got[1].pixels) == images.binarize(page).tobytes() == bytes(got[2].pixels)
    assert images.transform_pages(table, ["prepare"], dpi=150).where("page = 1").first().height == 80
    with pytest.raises(ValueError):
        images.transform_pages(table, ["sharpen"])


def test_command_line(spark, tmp_path, capsys):
    from pagewright import __main__ as cli

    (tmp_path / "a.pdf").write_bytes(GOOD.encode())
    assert cli.main(["process", str(tmp_path / "a.pdf"), "--out", str(tmp_path / "out"), "--reader", "tests.test_plans:Reader"]) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (said["documents"], said["pages"], said["tables"], said["errors"]) == (1, 3, 1, [])
    assert cli.main(["check"]) == 0 and json.loads(capsys.readouterr().out)["ok"]

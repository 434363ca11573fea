"""The engine as a service: ingest, catalogue, jobs, search and agent over stored tables.

Every method is what one route of an HTTP surface would call; errors carry the code it
would answer with.
"""

from __future__ import annotations

import time
import traceback
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import catalog as C, chunking, export, jobs as J, vector_search as V
from ..schemas import AgentRequest, CHUNK, DOCUMENT, DOCUMENT_STATES, JOB_EVENT, SearchRequest
from ..sources import files as S
from ..sources import providers as P
from ..sources.tables import LogTable, latest, next_seq
from . import agent, documents


LIGHT = "document_id string, seq long, file_hash string, filename string, file_size long, pdf_path string, status string, created_at timestamp_ntz, processed_at timestamp_ntz, error_message string, total_pages int"


class ParquetVectors:
    """A vector store in two logs: vectors under their document's version, and the versions that count.

    A document that is indexed again, or deleted, gets one new row in the small log; no
    vector is ever rewritten. A search joins the versions by document and reads no other.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.rows = LogTable(f"{root}/vectors", CHUNK + ", embedding array<float>, seq long")
        self.versions = LogTable(f"{root}/vector_versions", "document_id string, version long, seq long")

    def read(self) -> DataFrame:
        now = latest(self.versions.read(self.spark), "document_id").select("document_id", F.col("version").alias("seq"))
        return self.rows.read(self.spark).join(now, ["document_id", "seq"], "left_semi").drop("seq")

    def upsert(self, chunks: DataFrame) -> int:
        """Store whole documents' chunks, in place of what was known of these documents; the number of chunks."""
        seq = next_seq()
        self.rows.append(chunks.withColumn("seq", F.lit(seq)))
        stored = self.rows.read(self.spark).where(F.col("seq") == seq)
        self.versions.append(stored.select("document_id", F.lit(seq).alias("version"), F.lit(seq).alias("seq")).distinct())
        return stored.count()

    def query(self, vector: list[float], k: int, document_id: str | None = None) -> DataFrame:
        return V.top_k(self.read(), vector, k, document_id)

    def delete_document(self, document_id: str) -> None:
        """Nothing is stored under version 0."""
        self.versions.append(self.spark.createDataFrame([(document_id, 0, next_seq())], self.versions.ddl))


@dataclass
class Service:
    spark: SparkSession
    root: str
    reader: P.PdfReader
    #: One recognition engine, or a list tried in order.
    engine: P.OcrEngine | list | None = None
    client: V.EmbeddingClient | None = None
    chat: P.ChatClient | None = None
    config: EngineConfig = field(default_factory=EngineConfig)

    def __post_init__(self) -> None:
        self.catalog_log = LogTable(f"{self.root}/catalog", LIGHT)
        self.event_log = LogTable(f"{self.root}/job_events", JOB_EVENT)
        self.upload_log = LogTable(f"{self.root}/uploads", "document_id string, content binary, seq long")
        self.parsed_log = LogTable(f"{self.root}/parsed", DOCUMENT + ", seq long")
        self.store = ParquetVectors(self.spark, self.root)

    # --- state ---------------------------------------------------------------------------------------

    @property
    def catalog(self) -> DataFrame:
        """One row a document, without its pages."""
        return latest(self.catalog_log.read(self.spark), "document_id")

    @property
    def documents(self) -> DataFrame:
        """The catalogue with the pages of what is parsed."""
        parsed = latest(self.parsed_log.read(self.spark).select("doc_id", "pages", "seq"), "doc_id")
        return self.catalog.join(parsed.withColumnRenamed("doc_id", "document_id"), "document_id", "left")

    @property
    def jobs(self) -> DataFrame:
        return J.job_states(self.event_log.read(self.spark))

    @property
    def vectors(self) -> DataFrame:
        return self.store.read()

    def healthcheck(self) -> dict:
        return {"status": "ok", "search": self.client is not None, "agent": self.client is not None and self.chat is not None}

    # --- ingest --------------------------------------------------------------------------------------

    def submit(self, uploads: DataFrame, now: datetime | None = None) -> DataFrame:
        """Store and queue files (path, content): (path, file_hash, code), 202 queued, 400 no PDF, 409 known content."""
        now = now or datetime.now()
        hashed = uploads.withColumn("file_hash", S.content_hash(F.col("content"))).withColumn("valid", S.is_pdf(F.col("path"), F.col("content")))
        kept = S.accept_uploads(uploads.select("path", "content")).join(self.catalog.select("file_hash"), "file_hash", "left_anti").select("file_hash", "path")
        answer = hashed.join(kept.withColumn("fresh", F.lit(True)), ["file_hash", "path"], "left").select("path", "file_hash", F.when(~F.col("valid"), 400).when(F.col("fresh"), 202).otherwise(409).alias("code")).collect()
        fresh = self.spark.createDataFrame([(r.file_hash, r.path) for r in answer if r.code == 202], "file_hash string, path string")
        new = uploads.select("path", "content").join(fresh, "path").select(F.col("file_hash").alias("document_id"), "file_hash", "content", F.element_at(F.split("path", "/"), -1).alias("filename"), F.octet_length("content").cast("long").alias("file_size"), F.col("path").alias("pdf_path"), F.lit(now).cast("timestamp_ntz").alias("created_at"))
        # Bytes come before the catalogue and the catalogue before the queue: no job can start without either.
        self.upload_log.append(new.withColumn("seq", F.lit(next_seq())))
        self._note(new.withColumn("status", F.lit("pending")))
        self._events([(r.file_hash, "queued", None, r.file_hash) for r in answer if r.code == 202], now)
        return self.spark.createDataFrame(answer, "path string, file_hash string, code int")

    def _events(self, rows: list[tuple], now: datetime) -> None:
        if rows:
            new = [(job, next_seq(), now, status, error, digest) for job, status, error, digest in rows]
            self.event_log.append(self.spark.createDataFrame(new, JOB_EVENT))

    def _note(self, changes: DataFrame) -> None:
        """Append changes to the catalogue: what isn't given stays as it was."""
        lacking = [f for f in self.spark.createDataFrame([], LIGHT).schema if f.name not in changes.columns and f.name != "seq"]
        self.catalog_log.append(changes.withColumn("seq", F.lit(next_seq())).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in lacking]))

    def work(self, uploads: DataFrame | None = None, now: datetime | None = None, jobs: int = 256) -> int:
        """Process the ``jobs`` oldest queued jobs; the number of them.

        Their bytes are those that ``submit`` stored, or come with ``uploads`` (path, content).
        Documents without a readable page fail, with the reason. Indexing is tried after the
        parse is stored, and its failure is only noted: the document stays processed.
        """
        now = now or datetime.now()
        waiting = J.queued(self.jobs).orderBy("created_at", "job_id")
        if uploads is None:
            names = [r.job_id for r in waiting.limit(jobs).select("job_id").collect()]
            content = self.upload_log.read(self.spark).where(F.col("document_id").isin(names or [""])).dropDuplicates(["document_id"])
        else:
            content = uploads.withColumn("document_id", S.content_hash(F.col("content"))).dropDuplicates(["document_id"])
            names = [r.job_id for r in waiting.join(content, F.col("job_id") == F.col("document_id"), "left_semi").orderBy("created_at", "job_id").limit(jobs).select("job_id").collect()]
        if not names:
            return 0
        todo = content.join(self.catalog.select("document_id", "filename"), "document_id").where(F.col("document_id").isin(names)).select(F.col("document_id").alias("doc_id"), F.col("filename").alias("source_file"), "content")
        self._events([(n, "processing", None, n) for n in names], now)
        seq = next_seq()
        try:
            parsed = documents.parse(todo, self.reader, self.engine, self.config, keep=True)
            self.parsed_log.append(parsed.documents.withColumn("seq", F.lit(seq)))
            broken = {r.doc_id: r.error for r in parsed.errors.where("step = 'pages'").collect()}
            partly = {r.doc_id: r.error for r in parsed.errors.where("step <> 'pages'").collect() if r.doc_id not in broken}
            parsed.release()
        except Exception:  # noqa: BLE001 - the jobs fail, the worker goes on
            self._fail({n: traceback.format_exc()[-4000:] for n in names}, now)
            return len(names)
        rows = self.parsed_log.read(self.spark).where((F.col("seq") == seq) & ~F.col("doc_id").isin(list(broken) or [""]))
        self._note(rows.select(F.col("doc_id").alias("document_id"), F.lit("processed").alias("status"), "total_pages", F.lit(now).cast("timestamp_ntz").alias("processed_at")))
        note = None
        if self.client is not None:
            try:
                self.index(rows)
            except Exception as e:  # noqa: BLE001
                note = f"not indexed: {type(e).__name__}: {e}"[:2000]
        self._events([(n, "uploaded", f"read in part: {partly[n]}" if n in partly else note, n) for n in names if n not in broken], now)
        self._fail(broken, now)
        return len(names)

    def run_worker(self, jobs: int = 256, idle_seconds: float = 2.0, until_empty: bool = False) -> int:
        """Work through the queue, waiting while it is empty; with ``until_empty`` the number of jobs done."""
        done = 0
        while True:
            n = self.work(jobs=jobs)
            done += n
            if not n:
                if until_empty:
                    return done
                time.sleep(idle_seconds)

    def _fail(self, errors: dict[str, str], now: datetime) -> None:
        if errors:
            self._events([(n, "failed", e, n) for n, e in errors.items()], now)
            self._note(self.spark.createDataFrame([(n, "failed", e) for n, e in errors.items()], "document_id string, status string, error_message string"))

    def index(self, parsed: DataFrame) -> int:
        """Chunk, embed, store; the number of chunks."""
        chunks = chunking.chunk_blocks(chunking.document_blocks(parsed))
        return self.store.upsert(V.with_embeddings(chunks, self.client, self.config.embedding_batch, self.config.embedding_max_chars))

    # --- reading -------------------------------------------------------------------------------------

    def list_jobs(self, limit: int = 20, offset: int = 0) -> tuple[DataFrame, int]:
        _page(limit, offset)
        return J.list_page(self.jobs, limit, offset), J.count(self.jobs)

    def get_job(self, job_id: str) -> DataFrame:
        return _found(J.get(self.jobs, job_id), f"no job {job_id}")

    def wait_for(self, job_id: str, timeout: float = 600.0, interval: float = 1.0) -> str:
        """Poll a job until it is uploaded or failed; its status then, or where the time ends."""
        end = time.monotonic() + timeout
        while True:
            status = self.get_job(job_id).first().status
            if status in J.TERMINAL or time.monotonic() >= end:
                return status
            time.sleep(interval)

    def list_documents(self, status: str | None = None, limit: int = 20, offset: int = 0) -> tuple[DataFrame, int]:
        _page(limit, offset)
        if status is not None and status not in DOCUMENT_STATES:
            raise C.NotReady(400, f"unknown status {status}")
        return C.list_page(self.catalog, status, limit, offset), C.count(self.catalog, status)

    def document_status(self, document_id: str) -> str:
        return _found(C.get(self.catalog, document_id).select("status"), f"no document {document_id}").first().status

    def get_document(self, document_id: str) -> DataFrame:
        """The document with its pages."""
        return _found(C.get(self.documents, document_id), f"no document {document_id}")

    def search(self, request: SearchRequest) -> dict:
        """Results with the catalogue's file names, their number, and the time taken."""
        if self.client is None:
            raise C.NotReady(503, "search is not configured")
        C.require_ready(self.catalog, request.document_id)
        began = time.monotonic()
        rows = V.enrich_source(V.search(self.vectors, request, self.client), self.catalog).drop("embedding").orderBy(F.desc("similarity"), "chunk_id").collect()
        return {"results": [r.asDict() for r in rows], "total_matches": len(rows), "processing_time_ms": round((time.monotonic() - began) * 1000, 1)}

    def agent_search(self, request: AgentRequest) -> agent.AgentResult:
        if self.client is None or self.chat is None:
            raise C.NotReady(503, "the agent is not configured")
        C.require_ready(self.catalog, request.document_id)
        tools = agent.ToolRegistry(self.vectors, self.documents, self.client)
        return agent.AgentRunner(self.spark, self.chat, tools, self.config).run(request)

    # --- artefacts -----------------------------------------------------------------------------------

    def artifacts(self, document_id: str, folder: str) -> dict:
        """Write a document as JSON, and the lines of its invisible text layer as Parquet."""
        row = self.get_document(document_id)
        docs = row.select(F.col("document_id").alias("doc_id"), F.col("filename").alias("source_file"), "total_pages", F.col("processed_at").alias("processing_date"), "pages")
        S.write_documents(docs, f"{folder}/json")
        pages = docs.select("doc_id", F.explode("pages").alias("p"))
        scanned = pages.where("p.source = 'ocr'")
        blocks = scanned.select("doc_id", F.col("p.page").alias("page"), F.explode("p.blocks").alias("b")).select("doc_id", "page", "b.block_id", "b.type", "b.text", "b.bbox", "b.rows", "b.lines")
        size = scanned.select("doc_id", F.col("p.page").alias("page"), "p.width", "p.height")
        export.place_lines(export.overlay_lines(blocks), size).write.mode("overwrite").parquet(f"{folder}/overlay")
        return {"json_path": f"{folder}/json", "overlay_path": f"{folder}/overlay"}


def _page(limit: int, offset: int) -> None:
    if limit < 1 or offset < 0:
        raise C.NotReady(400, "limit must be at least 1 and offset at least 0")


def _found(rows: DataFrame, message: str) -> DataFrame:
    if rows.limit(1).count() == 0:
        raise C.NotReady(404, message)
    return rows

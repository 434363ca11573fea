"""Registered queries: vector search, catalogue, jobs, agent results, streaming."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..operators import agent_results, catalog as C, jobs as J, vector_search as V
from ..sources import files
from ..streaming import jobs as S
from .registry import query, table


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), "embedding")


def _query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(v) for v in row.embedding] if row else [1.0]


def _benchmark_text(spark: SparkSession, sf_dir: str, item: int) -> str:
    row = table(spark, sf_dir, "benchmark").where(F.col("item_id") == item).select("text").first()
    return row.text if row else ""


def sim(q: str) -> str:
    return f"greatest(0, least(1, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {q}))))"


@query(f"SELECT vec_id AS chunk_id, label AS document_id, round({sim('0')}, 6) AS similarity FROM embeddings e ORDER BY {sim('0')} DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    return V.top_k(_vectors(spark, sf_dir), _query_vector(spark, sf_dir, 0), 10).select("chunk_id", "document_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT vec_id AS chunk_id, round({sim('1')}, 6) AS similarity FROM embeddings e WHERE label = 3 ORDER BY {sim('1')} DESC, vec_id LIMIT 10")
def scoped_topk(spark, sf_dir):
    return V.top_k(_vectors(spark, sf_dir), _query_vector(spark, sf_dir, 1), 10, document_id=3).select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT * FROM (SELECT vec_id AS chunk_id, round({sim('2')}, 6) AS similarity FROM embeddings e ORDER BY {sim('2')} DESC, vec_id LIMIT 20) WHERE similarity >= 0.3")
def topk_min_similarity(spark, sf_dir):
    return V.top_k(_vectors(spark, sf_dir), _query_vector(spark, sf_dir, 2), 20, min_similarity=0.3).select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query("""SELECT query_id, chunk_id, rank, similarity FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id) AS INTEGER) AS rank
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e, LATERAL (SELECT list_cosine_similarity(e.v, q.v) AS s)) WHERE rank <= 5""")
def topk_many_queries(spark, sf_dir):
    """The stated query set, every id divisible by 20, against all vectors."""
    v = _vectors(spark, sf_dir)
    q = v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.top_k_blocks(q, v.select("chunk_id", "embedding"), 5).select("query_id", "chunk_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("""SELECT query_id, chunk_id, rank, similarity FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id) AS INTEGER) AS rank
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) q, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e, LATERAL (SELECT list_cosine_similarity(e.v, q.v) AS s)) WHERE rank <= 5""")
def topk_every_query(spark, sf_dir):
    """Like topk_many_queries, with every vector as a query."""
    v = _vectors(spark, sf_dir)
    q = v.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.top_k_blocks(q, v.select("chunk_id", "embedding"), 5).select("query_id", "chunk_id", "rank", F.round("similarity", 6).alias("similarity"))


def tok(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(strip_accents({x})), '[a-z0-9]{{4,}}'))"


def passes(q: str, t: str) -> str:
    pre = lambda x: f"list_distinct(list_transform({x}, lambda w: w[1:4]))"
    return f"(len({q}) = 0 OR len(list_intersect({q}, {t})) > 0 OR len(list_intersect({pre(q)}, {pre(t)})) >= CASE WHEN len({pre(q)}) = 1 THEN 1 ELSE 2 END)"


ITEM = "(SELECT text FROM benchmark WHERE item_id = 2)"


@query(f"SELECT doc_id FROM (SELECT doc_id, {tok('text')} AS t, {tok(ITEM)} AS q FROM documents) WHERE {passes('q', 't')}")
def keyword_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return V.keyword_filter(docs, _benchmark_text(spark, sf_dir, 2)).select("doc_id")


@query(f"""WITH best AS (SELECT e.vec_id AS chunk_id, {sim('0')} AS s FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id ORDER BY s DESC, chunk_id LIMIT 50),
hit AS (SELECT chunk_id, round(s, 6) AS similarity, {tok('d.text')} AS t, {tok(ITEM)} AS q FROM best JOIN documents d ON d.doc_id = chunk_id WHERE s >= 0.1)
SELECT chunk_id, similarity, toxic FROM hit LEFT JOIN labels ON labels.doc_id = chunk_id WHERE {passes('q', 't')}""")
def hybrid_search(spark, sf_dir):
    """Top-k by cosine, bound, keywords, then labels: the order decides the result."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    # The limit runs on ids and scores; texts are read for its k rows only, and keywords tested on them.
    known = _vectors(spark, sf_dir).join(docs.select("chunk_id"), "chunk_id", "left_semi")
    best = V.top_k(known, _query_vector(spark, sf_dir, 0), 50, min_similarity=0.1).select("chunk_id", "similarity")
    found = V.keyword_filter(V.with_rows(best, docs), _benchmark_text(spark, sf_dir, 2))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "toxic")
    return found.join(labels, "chunk_id", "left").select("chunk_id", F.round("similarity", 6).alias("similarity"), "toxic")


CATALOG_SQL = """cat AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'f' || doc_id || '.pdf' END AS filename, ['pending', 'processing', 'processed', 'failed'][doc_id % 4 + 1] AS status, n_chars AS file_size, CAST(doc_id % 7 AS INTEGER) AS total_pages, doc_id % 50 AS created_at, text FROM documents)"""


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    states = F.array(*[F.lit(s) for s in ("pending", "processing", "processed", "failed")])
    return table(spark, sf_dir, "documents").select(d.alias("document_id"), F.when(d % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("f"), d.cast("string"), F.lit(".pdf"))).alias("filename"), F.element_at(states, (d % 4 + 1).cast("int")).alias("status"), F.col("n_chars").alias("file_size"), (d % 7).cast("int").alias("total_pages"), (d % 50).alias("created_at"))


@query(f"""WITH {CATALOG_SQL}, best AS (SELECT vec_id AS chunk_id, {sim('5')} AS s FROM embeddings e ORDER BY s DESC, vec_id LIMIT 25)
SELECT chunk_id, round(s, 6) AS similarity, coalesce(nullif(filename, ''), 'old.pdf') AS source_file FROM best LEFT JOIN cat ON document_id = chunk_id""")
def enriched_search(spark, sf_dir):
    best = V.top_k(_vectors(spark, sf_dir), _query_vector(spark, sf_dir, 5), 25).select("chunk_id", F.col("chunk_id").alias("document_id"), "similarity", F.lit("old.pdf").alias("source_file"))
    return V.enrich_source(best, _catalog(spark, sf_dir)).select("chunk_id", F.round("similarity", 6).alias("similarity"), "source_file")


@query("""WITH new AS (SELECT vec_id AS chunk_id, -1 AS document_id, vec_id % 2 AS seq FROM embeddings WHERE vec_id % 5 = 0 UNION ALL SELECT vec_id, -2, 9 FROM embeddings WHERE vec_id % 10 = 0)
SELECT vec_id AS chunk_id, label AS document_id FROM embeddings WHERE vec_id NOT IN (SELECT chunk_id FROM new)
UNION ALL SELECT chunk_id, arg_max(document_id, seq) FROM new GROUP BY chunk_id""")
def upsert_chunks(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("chunk_id", "document_id")
    new = v.where("chunk_id % 5 = 0").select("chunk_id", F.lit(-1).alias("document_id"), (F.col("chunk_id") % 2).alias("seq")).unionByName(v.where("chunk_id % 10 = 0").select("chunk_id", F.lit(-2).alias("document_id"), F.lit(9).cast("long").alias("seq")))
    return V.upsert(v, new)


@query("SELECT vec_id AS chunk_id, label AS document_id FROM embeddings WHERE label <> 4")
def delete_document(spark, sf_dir):
    return V.delete_document(_vectors(spark, sf_dir), 4).select("chunk_id", "document_id")


@query("SELECT doc_id, sha256(text) AS file_hash, m AS first_doc_id FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY sha256(text)) AS m FROM documents) WHERE doc_id <> m")
def dedup_by_hash(spark, sf_dir):
    return C.duplicates(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT page_id, sha256(html) AS file_hash FROM pages")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.content_hash(F.col("html")).alias("file_hash"))


@query("SELECT page_id FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '%PDF-1.7' ELSE html END AS c, CASE WHEN page_id % 2 = 0 THEN url || '.PDF' ELSE url END AS p FROM pages) WHERE ends_with(lower(p), '.pdf') AND starts_with(c, '%PDF-')")
def upload_validation(spark, sf_dir):
    p = F.col("page_id")
    content = F.when(p % 3 == 0, F.lit("%PDF-1.7")).otherwise(F.col("html")).cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", F.when(p % 2 == 0, F.concat("url", F.lit(".PDF"))).otherwise(F.col("url")).alias("path"), content.alias("content")).where(files.is_pdf(F.col("path"), F.col("content"))).select("page_id")


@query(f"WITH {CATALOG_SQL} SELECT document_id, filename, status, total_pages, created_at, file_size FROM cat WHERE status = 'processed' ORDER BY created_at, document_id LIMIT 20 OFFSET 20")
def list_documents_page(spark, sf_dir):
    return C.list_page(_catalog(spark, sf_dir), "processed", 20, 20)


@query(f"WITH {CATALOG_SQL} SELECT status, count(*) AS n FROM cat GROUP BY status")
def count_by_status(spark, sf_dir):
    return _catalog(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CATALOG_SQL} SELECT count(*) AS documents, count(*) FILTER (WHERE status = 'processed') AS processed, count(*) FILTER (WHERE status = 'none') AS unknown FROM cat")
def count_documents(spark, sf_dir):
    cat = _catalog(spark, sf_dir)
    return spark.createDataFrame([(C.count(cat), C.count(cat, "processed"), C.count(cat, "none"))], "documents long, processed long, unknown long")


@query(f"WITH {CATALOG_SQL} SELECT document_id, filename, status, total_pages FROM cat WHERE document_id = 7")
def get_document(spark, sf_dir):
    return C.get(_catalog(spark, sf_dir), 7).select("document_id", "filename", "status", "total_pages")


@query("SELECT doc_id AS document_id FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 5)")
def find_by_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("file_hash"))
    row = C.get(d, 5).select("file_hash").first()
    return C.find_by_hash(d, row.file_hash if row else "").select("document_id")


@query(f"WITH {CATALOG_SQL} SELECT document_id, CASE WHEN document_id % 6 = 0 THEN '/out/' || document_id || '.pdf' WHEN document_id % 5 = 0 THEN 'old' END AS pdf_path FROM cat")
def update_pdf_path(spark, sf_dir):
    """Each change comes twice; the one with the larger seq counts."""
    d = F.col("document_id")
    cat = _catalog(spark, sf_dir).withColumn("pdf_path", F.when(d % 5 == 0, F.lit("old")))
    new = cat.where(d % 6 == 0).select("document_id", F.concat(F.lit("/out/"), d.cast("string"), F.lit(".pdf")).alias("pdf_path"), F.lit(2).alias("seq"))
    return C.update_pdf_path(cat, new.unionByName(new.withColumn("pdf_path", F.lit("first")).withColumn("seq", F.lit(1)))).select("document_id", "pdf_path")


@query("""WITH known AS (SELECT doc_id AS document_id, sha256(text) AS file_hash FROM documents WHERE doc_id % 4 = 0), up AS (SELECT doc_id AS document_id, sha256(text) AS file_hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents WHERE doc_id % 4 <> 0)
SELECT document_id, file_hash, NULL::VARCHAR AS status FROM known UNION ALL SELECT document_id, file_hash, 'pending' FROM up WHERE n = 1 AND file_hash NOT IN (SELECT file_hash FROM known)""")
def create_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("file_hash"))
    known = d.where("document_id % 4 = 0").withColumn("status", F.lit(None).cast("string"))
    uploads = d.where("document_id % 4 <> 0").withColumn("created_at", F.lit(0))
    return C.create(known.withColumn("created_at", F.lit(0)), uploads).select("document_id", "file_hash", "status")


@query(f"WITH {CATALOG_SQL} SELECT document_id, CASE WHEN document_id % 6 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN document_id % 12 = 0 THEN 'bad' WHEN document_id % 5 = 0 THEN 'old' END AS error_message FROM cat")
def update_status(spark, sf_dir):
    d = F.col("document_id")
    cat = _catalog(spark, sf_dir).withColumn("error_message", F.when(d % 5 == 0, F.lit("old")))
    changes = cat.where(d % 6 == 0).select("document_id", F.lit("failed").alias("status"), F.when(d % 12 == 0, F.lit("bad")).alias("error_message"))
    return C.update_status(cat, changes).select("document_id", "status", "error_message")


@query(f"WITH {CATALOG_SQL} SELECT document_id, CASE WHEN document_id % 6 = 0 THEN 'processed' ELSE status END AS status, CASE WHEN document_id % 6 = 0 THEN 9 ELSE total_pages END AS total_pages FROM cat")
def save_parsed(spark, sf_dir):
    cat = _catalog(spark, sf_dir).withColumn("pages", F.lit(None).cast("array<int>")).withColumn("processed_at", F.lit(None).cast("long"))
    parsed = cat.where("document_id % 6 = 0").select("document_id", F.array(F.lit(1)).alias("pages"), F.lit(9).alias("total_pages"), F.lit(1).cast("long").alias("processed_at"))
    return C.save_parsed(cat, parsed).select("document_id", "status", "total_pages")


@query("""WITH j AS (SELECT doc_id AS job_id, doc_id % 9 AS created_at, sha256(text) AS file_hash FROM documents WHERE doc_id % 3 <> 0),
o AS (SELECT * FROM j), n AS (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY created_at, job_id) AS r FROM o WHERE file_hash NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0))
SELECT job_id, file_hash FROM n WHERE r = 1""")
def backfill(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.sha2("text", 256).alias("file_hash"))
    jobs = d.select("job_id", F.lit("x.pdf").alias("filename"), (F.col("job_id") % 9).alias("created_at"), F.when(F.col("job_id") % 3 == 0, F.col("job_id")).alias("document_id"))
    return C.backfill(d.where("job_id % 3 = 0"), jobs, d).select("job_id", "file_hash")


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the')")
def doc_text_search(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(F.lower("text").contains("the")).select("conv_id", "turn")


@query("""SELECT document_id, page, block_id FROM (SELECT conv_id AS document_id, CAST(turn + 1 AS INTEGER) AS page, 'p' || (turn + 1) || '_b1' AS block_id, text FROM conversations) WHERE document_id = 3 AND contains(lower(text), 'e')""")
def document_keyword_scan(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").withColumn("page", (F.col("turn") + 1).cast("int"))
    block = F.struct(F.format_string("p%d_b1", "page").alias("block_id"), "text")
    trees = conv.groupBy(F.col("conv_id").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("page", F.array(block).alias("blocks")))).alias("pages"))
    return C.search_text(trees, 3, "E").select("document_id", "page", "block_id")


STATES = {"signup": "queued", "view": "processing", "purchase": "uploaded", "error": "failed"}
_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items())
JOBS_SQL = f"""ev AS (SELECT user_id AS job_id, event_id AS seq, ts, CASE event_type {_CASE} END AS status, CASE WHEN event_type = 'error' THEN 'e' || event_id END AS error_message, CASE WHEN event_id % 3 = 0 THEN 'h' || event_id END AS file_hash FROM events WHERE event_type IN ('signup', 'view', 'purchase', 'error')),
jobs AS (SELECT job_id, arg_max(status, (ts, seq)) AS status, min(ts) AS created_at, min(ts) FILTER (WHERE status = 'processing') AS started_at, max(ts) FILTER (WHERE status IN ('uploaded', 'failed')) AS completed_at,
  arg_max(error_message, (ts, seq)) FILTER (WHERE error_message IS NOT NULL) AS error_message, arg_max(file_hash, (ts, seq)) FILTER (WHERE file_hash IS NOT NULL) AS file_hash FROM ev GROUP BY job_id)"""


def _transitions(events: DataFrame) -> DataFrame:
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), F.col("event_type"))
    e = F.col("event_id")
    return events.where(F.col("event_type").isin(*STATES)).select(F.col("user_id").alias("job_id"), e.alias("seq"), "ts", status.alias("status"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), e.cast("string"))).alias("error_message"), F.when(e % 3 == 0, F.concat(F.lit("h"), e.cast("string"))).alias("file_hash"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_states(_transitions(table(spark, sf_dir, "events")))


@query(f"WITH {JOBS_SQL} SELECT * FROM jobs")
def job_state(spark, sf_dir):
    return _jobs(spark, sf_dir)


@query(f"WITH {JOBS_SQL} SELECT job_id, status, created_at FROM jobs WHERE status = 'queued' ORDER BY created_at, job_id LIMIT 1")
def next_queued(spark, sf_dir):
    return J.next_queued(_jobs(spark, sf_dir)).select("job_id", "status", "created_at")


@query(f"WITH {JOBS_SQL} SELECT job_id, status, error_message FROM jobs WHERE job_id = 3")
def get_job(spark, sf_dir):
    return J.get(_jobs(spark, sf_dir), 3).select("job_id", "status", "error_message")


@query(f"WITH {JOBS_SQL} SELECT count(*) AS n FROM jobs")
def count_jobs(spark, sf_dir):
    return spark.createDataFrame([(J.count(_jobs(spark, sf_dir)),)], "n long")


@query(f"WITH {JOBS_SQL} SELECT job_id, status FROM jobs ORDER BY job_id LIMIT 20 OFFSET 5")
def list_jobs_page(spark, sf_dir):
    return J.list_page(_jobs(spark, sf_dir), 20, 5).select("job_id", "status")


def _stream(spark: SparkSession, sf_dir: str, df_of, mode: str) -> DataFrame:
    """Run a stream over the events to its end and give what it wrote.

    The source watches the scale's folder and takes the events only; the result is written
    by ``foreachBatch``, the last batch of a key deciding.
    """
    from pyspark.sql.streaming import StreamingQuery

    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="pagewright-stream-")
    folder = f"{root}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    source = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events*")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number}")

    run: StreamingQuery = df_of(source).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")


@query(f"WITH {JOBS_SQL} SELECT CAST(job_id AS VARCHAR) AS job_id, status, created_at, started_at, completed_at, error_message, file_hash FROM jobs")
def job_state_stream(spark, sf_dir):
    from pyspark.sql import Window

    found = _stream(spark, sf_dir, lambda e: S.job_states(_transitions(e).withColumn("job_id", F.col("job_id").cast("string"))), "update")
    last = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("batch")))
    return found.withColumn("n", last).where("n = 1").drop("n", "batch")


@query(f"WITH {JOBS_SQL} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, status, count(*) AS n FROM ev GROUP BY 1, 2")
def transitions_by_hour_stream(spark, sf_dir):
    found = _stream(spark, sf_dir, lambda e: S.counts_by_window(_transitions(e)), "update")
    return found.groupBy("start", "status").agg(F.max_by("n", "batch").alias("n"))


@query("""WITH r AS (SELECT conv_id, turn, CAST(conv_id % 5 AS VARCHAR) AS d, CAST(turn % 2 AS VARCHAR) AS c, CAST(conv_id % 3 AS INTEGER) AS p FROM conversations)
SELECT d AS document_id, c AS chunk_id, p AS page, arg_min(turn, (conv_id, turn)) AS turn FROM r GROUP BY d, c, p""")
def agent_sources(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct((F.col("conv_id") % 5).cast("string").alias("document_id"), (F.col("turn") % 2).cast("string").alias("chunk_id"), (F.col("conv_id") % 3).cast("int").alias("page"), F.col("turn").cast("string").alias("text")))
    # A result holds its line, a sentence, and the same line cut short.
    content = F.concat_ws("\n", line, F.lit("no json"), F.substring(line, 1, 20))
    rows = conv.select(F.struct("conv_id", "turn").alias("result_no"), content.alias("content"))
    return agent_results.sources(rows).select("document_id", "chunk_id", "page", F.col("text").cast("long").alias("turn"))


@query("SELECT doc_id, length(text) AS n FROM documents")
def document_json(spark, sf_dir):
    docs = files.document_json(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.length(F.get_json_object("json", "$.text")).cast("long").alias("n"))


@query(f"SELECT doc_id, array_to_string(list_sort({tok('text')}), ' ') AS tokens FROM documents")
def keyword_tokens_exact(spark, sf_dir):
    t = K.tokens(F.col("text"), exact=True)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(t), " ").alias("tokens"))

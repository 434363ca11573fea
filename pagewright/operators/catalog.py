"""The document catalogue as relations: every change gives a new DataFrame to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMMARY = ("document_id", "filename", "status", "total_pages", "created_at", "file_size")


class NotReady(Exception):
    """A document can't be searched; ``code`` is what an HTTP surface would answer."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def create(catalog: DataFrame, uploads: DataFrame) -> DataFrame:
    """Append uploads whose hash is new; of equal hashes in one batch the first upload stays."""
    first = F.row_number().over(Window.partitionBy("file_hash").orderBy("created_at", "document_id"))
    new = uploads.withColumn("__n", first).where("__n = 1").drop("__n").join(catalog.select("file_hash"), "file_hash", "left_anti")
    return catalog.unionByName(new.withColumn("status", F.lit("pending")), allowMissingColumns=True)


def duplicates(rows: DataFrame, content: str, key: str) -> DataFrame:
    """(key, file_hash, first_key) of each row whose content was seen under a smaller key."""
    hashed = rows.select(F.col(key), F.sha2(F.col(content).cast("binary"), 256).alias("file_hash"))
    # Aggregated before it is shuffled, so that a popular content is no task's burden.
    first = hashed.groupBy("file_hash").agg(F.min(key).alias(f"first_{key}"), F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("file_hash").alias("__h"), f"first_{key}")
    return hashed.join(first, F.col("file_hash").eqNullSafe(F.col("__h"))).where(F.col(key) != F.col(f"first_{key}")).select(key, "file_hash", f"first_{key}")


def find_by_hash(catalog: DataFrame, file_hash: str) -> DataFrame:
    return catalog.where(F.col("file_hash") == file_hash)


def get(catalog: DataFrame, document_id) -> DataFrame:
    return catalog.where(F.col("document_id") == F.lit(document_id))


def _update(catalog: DataFrame, changes: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Merge changes by document_id; columns of ``changes`` are reached as ``c_<name>``.

    Of several changes to one document the last by ``seq`` counts, where there is such a
    column, else any one of them: a document keeps one row.
    """
    if "seq" in changes.columns:
        nth = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("seq")))
        changes = changes.withColumn("__n", nth).where("__n = 1").drop("__n", "seq")
    else:
        changes = changes.dropDuplicates(["document_id"])
    c = changes.select([F.col(x).alias(f"c_{x}") for x in changes.columns])
    joined = catalog.join(c, catalog["document_id"] == c["c_document_id"], "left")
    hit = F.col("c_document_id").isNotNull()
    return joined.select([F.when(hit, new[x]).otherwise(F.col(x)).alias(x) if x in new else F.col(x) for x in catalog.columns])


def save_parsed(catalog: DataFrame, parsed: DataFrame) -> DataFrame:
    """Store pages (document_id, pages, total_pages, processed_at); an old error message stays."""
    return _update(catalog, parsed, {"pages": F.col("c_pages"), "total_pages": F.col("c_total_pages"), "processed_at": F.col("c_processed_at"), "status": F.lit("processed")})


def update_status(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the status; the error message only where one is given."""
    return _update(catalog, changes, {"status": F.col("c_status"), "error_message": F.coalesce("c_error_message", "error_message")})


def update_pdf_path(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    return _update(catalog, changes, {"pdf_path": F.col("c_pdf_path")})


def list_page(catalog: DataFrame, status: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of summaries, ordered by creation and id so that pages never overlap."""
    rows = catalog if status is None else catalog.where(F.col("status") == status)
    return rows.select(*[c for c in SUMMARY if c in catalog.columns]).orderBy("created_at", "document_id").offset(offset).limit(limit)


def count(catalog: DataFrame, status: str | None = None) -> int:
    return (catalog if status is None else catalog.where(F.col("status") == status)).count()


def search_text(catalog: DataFrame, document_id, keyword: str) -> DataFrame:
    """Blocks of a document that hold the keyword, whatever its case and without wildcards."""
    pages = get(catalog, document_id).select("document_id", F.posexplode("pages").alias("p", "page"))
    blocks = pages.select("document_id", "p", page_number("page").alias("page"), F.posexplode("page.blocks").alias("b", "block"))
    return blocks.where(F.lower("block.text").contains(keyword.lower())).select("document_id", "page", "block.block_id", "block.text", "p", "b").orderBy("p", "b").drop("p", "b")


def page_number(page: str) -> Column:
    """The page's number; 0 counts as missing."""
    return F.coalesce(F.nullif(F.col(f"{page}.page"), F.lit(0)), F.lit(0))


def require_ready(catalog: DataFrame | None, document_id) -> None:
    """Raise unless the document exists and is processed; reads one row."""
    if document_id is None:
        return
    if catalog is None:
        raise NotReady(503, "no catalogue is configured")
    row = get(catalog, document_id).select("status").first()
    if row is None:
        raise NotReady(404, f"no document {document_id}")
    if row.status != "processed":
        raise NotReady(409, f"document {document_id} is {row.status}")


def backfill(catalog: DataFrame, jobs: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents to add for jobs that have none: the file exists and its hash is new.

    ``files`` has job_id, file_hash, file_size and pdf_path; one hash gives one document.
    All open jobs are taken, or the ``limit`` oldest.
    """
    open_jobs = jobs.where(F.col("document_id").isNull())
    if limit is not None:
        open_jobs = open_jobs.orderBy("created_at", "job_id").limit(limit)
    open_jobs = open_jobs.select("job_id", "filename", "created_at")
    known = catalog.select(F.col("file_hash").alias("__h"))
    found = open_jobs.join(files, "job_id").join(known, F.col("file_hash") == F.col("__h"), "left_anti")
    first = F.row_number().over(Window.partitionBy("file_hash").orderBy("created_at", "job_id"))
    return found.withColumn("__n", first).where("__n = 1").drop("__n").withColumn("status", F.lit("pending"))

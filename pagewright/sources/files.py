"""File sources and sinks: uploads, JSON artefacts, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DOCUMENT


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Binary files of a folder (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").load(path)


def is_pdf(path: Column, content: Column) -> Column:
    """The suffix, whatever its case, and the magic bytes."""
    return F.endswith(F.lower(path), F.lit(".pdf")) & (F.substring(content, 1, 5) == F.lit(b"%PDF-"))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def accept_uploads(files: DataFrame) -> DataFrame:
    """Valid uploads, hashed, one row a content: the first path of equal files stays."""
    valid = files.where(is_pdf(F.col("path"), F.col("content"))).withColumn("file_hash", content_hash(F.col("content")))
    kept = valid.groupBy("file_hash").agg(F.min("path").alias("path"))
    return valid.join(kept, ["file_hash", "path"], "left_semi")


def write_documents(documents: DataFrame, path: str) -> None:
    """JSON lines, one document a line, nulls kept."""
    documents.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def document_json(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"}).alias("json"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines under the known schema, so nothing is inferred and no extra pass is made."""
    return spark.read.schema(DOCUMENT).json(path)

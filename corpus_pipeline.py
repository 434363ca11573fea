"""A corpus pipeline: toxic documents go, unclear languages go, near copies go, the rest is packed.

Each stage takes (spark, docs, sf_dir). ``run`` writes a stage's result as Parquet to the
shared folder and reads it again as the next one's documents, so an executor that is lost
costs no earlier stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import langid, packing, simhash, toxicity
from pagewright.llm._common import ensure_checkpoint_dir
from pagewright.plans.registry import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, trained on the table of labels: toxic documents go.

    Null and empty texts are not toxic and stay; repeated rows go or stay together; texts
    are read whole; an empty table gives an empty one; extra columns are kept as they are.
    Without labels of both classes everything stays.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents whose language is rejected go.

    Null, empty and blank texts and ties have no language and go; repeated rows go or stay
    together; a row with text but no given language stays if one is found. An empty table
    gives an empty one; extra columns are kept as they are.
    """
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group the document with the smallest id stays.

    Rows repeated with equal id and text are copies; rows without id or without a word have
    no copies and stay. An empty table gives an empty one; extra columns are kept.
    """
    return simhash.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the rows are pieces of documents, in real tokens, and their bins.

    Null and empty texts take one token's place, null ids are packed under a null id, ties
    go by id and piece, long documents are cut into pieces without loss. An empty table
    gives no row; only id and text are read.
    """
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("language_id", keep_known_languages), ("simhash_near_dedup", drop_near_copies), ("best_fit_packing", pack)]

#: Compression, a trained field and SimHash can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's input is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs

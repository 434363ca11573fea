"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only in local mode without that setting (unit tests, a laptop) a temporary folder
    takes its place; on a cluster, where executors could not read it, this fails.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return folder or context._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pagewright-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_hash(text: str) -> F.Column:
    """64-bit hash of a text column; null texts hash alike."""
    return F.xxhash64(F.col(text))


def schema_of(**fields: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field(k, t) for k, t in fields.items()])


def type_of(df: DataFrame, column: str) -> str:
    """A column's own type as DDL: identifiers keep theirs, be they numbers or strings."""
    return df.select(F.col(column).alias("x")).schema["x"].dataType.simpleString()


def in_slices(batches: Iterator[pa.RecordBatch], rows: int, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by rows and by bytes of text, so that long texts never pile up in one Python list.

    A slice holds one row at least, however long.
    """
    for batch in batches:
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        end, at = np.cumsum(size), 0
        while at < batch.num_rows:
            until = int(np.searchsorted(end, (end[at - 1] if at else 0) + most_bytes, side="right"))
            until = min(max(until, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, until - at)
            at = until


def even_share(counts: list[int], total: int) -> int:
    """The largest number a group at which groups of these sizes give at most ``total``, one at least."""
    left = total
    for k, n in enumerate(sorted(counts)):
        share = left // (len(counts) - k)
        if n > share:
            return max(1, share)
        left -= n
    return max(1, *counts) if counts else 1


def bounded_sample(df: DataFrame, key: str, order: list[str], per_key: int) -> DataFrame:
    """At most ``per_key`` rows of each key that differ in ``order``, chosen by hash and so independent of layout.

    Counting reads the key column only. The hash threshold keeps about four times what
    is wanted, so that the ranking window never sees the whole table. Only the counts of
    the 4096 most frequent keys are broadcast; rarer keys go to the window whole, so no
    key is left out. ``__pw_rank`` numbers each key's rows from 1. ``__pw_rank`` numbers each key's rows from 1.
    """
    frequent = df.groupBy(F.col(key).alias("__pw_key")).agg(F.count(F.lit(1)).alias("__pw_n")).orderBy(F.desc("__pw_n"), "__pw_key").limit(4096)
    ticket = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    few = df.withColumn("__pw_ticket", ticket).join(F.broadcast(frequent), F.col(key) == F.col("__pw_key"), "left")
    few = few.where(F.col("__pw_n").isNull() | (F.col("__pw_ticket") <= (4.0 * per_key + 64.0) / F.col("__pw_n")))
    few = few.dropDuplicates([key, *order])  # copies would fill the sample
    rank = F.row_number().over(Window.partitionBy(key).orderBy("__pw_ticket", *order))
    return few.withColumn("__pw_rank", rank).where(F.col("__pw_rank") <= per_key).drop("__pw_key", "__pw_n", "__pw_ticket")

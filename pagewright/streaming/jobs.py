"""Job states on a stream of transitions, and the worker that turns uploads into documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import TERMINAL
from ..sources.files import accept_uploads

STATE = "status string, created_at timestamp, started_at timestamp, completed_at timestamp, error_message string, error_ts timestamp, error_seq long, file_hash string, hash_ts timestamp, hash_seq long, last_ts timestamp, last_seq long"
OUTPUT = "job_id string, status string, created_at timestamp, started_at timestamp, completed_at timestamp, error_message string, file_hash string"


def _none(value):
    return None if value is None or value is pd.NaT or (isinstance(value, float) and value != value) else value


def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold a job's new transitions into its state; the same rules as the batch aggregation.

    Transitions may arrive out of order, in any batch: the latest by (ts, seq) decides the
    status, and the latest that has one the error message and the file hash. Of equal
    (ts, seq) the one that came last counts.
    """
    status, created, started, completed, error, error_ts, error_seq, digest, hash_ts, hash_seq, ts, seq = map(_none, state.get) if state.exists else (None,) * 12
    for row in pd.concat(list(parts)).sort_values(["ts", "seq"], kind="stable").itertuples(index=False):
        at = (row.ts, row.seq)
        created = row.ts if created is None else min(created, row.ts)
        if row.status == "processing":
            started = row.ts if started is None else min(started, row.ts)
        if row.status in TERMINAL:
            completed = row.ts if completed is None else max(completed, row.ts)
        if ts is None or at >= (ts, seq):
            status, (ts, seq) = row.status, at
        if _none(row.error_message) and (error_ts is None or at >= (error_ts, error_seq)):
            error, (error_ts, error_seq) = row.error_message, at
        if _none(row.file_hash) is not None and (hash_ts is None or at >= (hash_ts, hash_seq)):
            digest, (hash_ts, hash_seq) = row.file_hash, at
    whole = lambda n: None if n is None else int(n)
    state.update((status, created, started, completed, error, error_ts, whole(error_seq), digest, hash_ts, whole(hash_seq), ts, whole(seq)))
    # Typed columns, so that groups without a time or message don't change the batch's types.
    times = {n: pd.Series([v], dtype="datetime64[ns]") for n, v in (("created_at", created), ("started_at", started), ("completed_at", completed))}
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], **times, "error_message": pd.Series([error], dtype=object), "file_hash": pd.Series([digest], dtype=object)})


def job_states(events: DataFrame) -> DataFrame:
    """Streaming (job_id, seq, ts, status, error_message, file_hash) to current states, in update mode."""
    return events.groupBy("job_id").applyInPandasWithState(fold, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def counts_by_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Transitions by event-time window and status; what comes later than ``late`` is dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def start_worker(spark: SparkSession, folder: str, out: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], interval: str | None = "2 seconds") -> StreamingQuery:
    """Watch a folder of uploads; every micro-batch is validated, deduplicated, processed, written.

    ``process`` takes (doc_id, source_file, content, file_hash) and returns documents. With
    no interval the query handles what is there and ends. A batch that is repeated after a
    failure overwrites its own output, so nothing is doubled. The hashes taken so far lie
    in a narrow table of their own, ``<out>_hashes``: no batch reads documents again.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    taken = f"{out.rstrip('/')}_hashes"

    def handle(batch: DataFrame, number: int) -> None:
        fresh = accept_uploads(batch)
        seen = _known_hashes(spark, taken, number)
        if seen is not None:
            fresh = fresh.join(seen, "file_hash", "left_anti")
        named = fresh.select(F.col("file_hash").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("source_file"), "content", "file_hash")
        process(named).write.mode("overwrite").parquet(f"{out}/batch={number}")
        named.select("file_hash").write.mode("overwrite").parquet(f"{taken}/batch={number}")

    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def _known_hashes(spark: SparkSession, taken: str, number: int) -> DataFrame | None:
    """Hashes of the batches before this one; a batch that runs again must not know its own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(taken)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("file_hash string, batch int").parquet(taken).where(F.col("batch") < number).select("file_hash")

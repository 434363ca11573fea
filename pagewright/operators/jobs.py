"""Job queue and job state as a fold of transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("uploaded", "failed")


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job after all its transitions (job_id, seq, ts, status, error_message, file_hash).

    The latest transition gives the status. Work started at the first 'processing';
    completion is the last terminal one. The last non-empty error and the last non-null
    hash stay. One aggregation with partial sums per task; no sort.
    """
    at = F.struct("ts", "seq")
    done = F.col("status").isin(*TERMINAL)
    said = F.col("error_message").isNotNull() & (F.col("error_message") != "")
    return events.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"),
        F.min("ts").alias("created_at"),
        F.min(F.when(F.col("status") == "processing", F.col("ts"))).alias("started_at"),
        F.max(F.when(done, F.col("ts"))).alias("completed_at"),
        F.max_by("error_message", F.when(said, at)).alias("error_message"),
        F.max_by("file_hash", F.when(F.col("file_hash").isNotNull(), at)).alias("file_hash"),
    )


def get(jobs: DataFrame, job_id) -> DataFrame:
    return jobs.where(F.col("job_id") == F.lit(job_id))


def queued(jobs: DataFrame) -> DataFrame:
    """The queue is a view: a job leaves it with its status, so nothing has to be removed."""
    return jobs.where(F.col("status") == "queued")


def next_queued(jobs: DataFrame) -> DataFrame:
    """The oldest queued job, ties by id; no row if none waits."""
    return queued(jobs).orderBy("created_at", "job_id").limit(1)


def list_page(jobs: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return jobs.orderBy("job_id").offset(offset).limit(limit)


def count(jobs: DataFrame) -> int:
    return jobs.count()

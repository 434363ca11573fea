"""Tables that can be read while they are replaced: Parquet folders with numbered versions."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class VersionedTable:
    """``path/v00000001``, ``v00000002``, ...: the newest one that was completed counts.

    A writer that dies leaves a folder without ``_SUCCESS``, which is never read. One
    writer at a time is assumed, as for any file-based table without a transaction log.
    """

    path: str
    ddl: str

    def _complete(self, spark: SparkSession) -> tuple[list[int], int]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return [], 0
        names = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v")]
        numbers = [int(p.getName()[1:]) for p in names]
        done = [n for p, n in zip(names, numbers) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(done), max(numbers, default=0)

    def read(self, spark: SparkSession) -> DataFrame:
        done, _ = self._complete(spark)
        if not done:
            return spark.createDataFrame([], self.ddl)
        return spark.read.schema(self.ddl).parquet(f"{self.path}/v{done[-1]:08d}")

    def write(self, df: DataFrame, keep: int = 2) -> None:
        """Write the next version, then drop all but the newest ``keep``."""
        spark = df.sparkSession
        done, last = self._complete(spark)
        names = spark.createDataFrame([], self.ddl).columns
        df.select(*names).write.parquet(f"{self.path}/v{last + 1:08d}")
        for n in [*done, last + 1][: -keep]:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{n:08d}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


@dataclass(frozen=True)
class LogTable:
    """A folder that is only added to: every write is a folder of its own, and nothing is read to write.

    Rows carry ``seq``; what counts now is folded on read. A write that dies leaves a
    folder without ``_SUCCESS``, which is never read.
    """

    path: str
    ddl: str

    def read(self, spark: SparkSession) -> DataFrame:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/_SUCCESS")
        found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder) or []
        done = [s.getPath().getParent().toString() for s in found]
        return spark.read.schema(self.ddl).parquet(*done) if done else spark.createDataFrame([], self.ddl)

    def append(self, df: DataFrame) -> None:
        names = df.sparkSession.createDataFrame([], self.ddl).columns
        df.select(*names).write.parquet(f"{self.path}/{next_seq():020d}")


_last = 0


def next_seq() -> int:
    """A number that grows with time, and within this process with every call."""
    global _last
    _last = max(_last + 1, time.time_ns())
    return _last


def latest(log: DataFrame, key: str) -> DataFrame:
    """One row a key: each column's value of the last row, by ``seq``, in which it isn't null.

    One aggregation with partial results a task; columns that aren't asked for aren't read.
    """
    others = [c for c in log.columns if c not in (key, "seq")]
    return log.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in others])

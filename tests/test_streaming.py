import datetime
import os
import random

import pandas as pd
from pyspark.sql import functions as F

from pagewright.operators import jobs as J
from pagewright.streaming import jobs as S

EVENTS = "job_id string, seq long, ts timestamp, status string, error_message string, file_hash string"


def at(k):
    return datetime.datetime(2024, 1, 1, 0, k)


def test_stream_over_several_batches_equals_the_batch_fold(spark, tmp_path):
    rows = [("a", 1, at(1), "queued", None, None), ("a", 2, at(2), "processing", None, "h"), ("b", 1, at(1), "queued", None, None), ("a", 3, at(3), "failed", "boom", None), ("a", 5, at(6), "uploaded", None, None), ("a", 4, at(5), "processing", "", None), ("c", 1, at(9), "processing", None, None), ("b", 2, at(0), "processing", None, "late")]
    for k in range(0, len(rows), 3):
        spark.createDataFrame(rows[k : k + 3], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    run = S.job_states(source).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert len({n for n, *_ in seen}) == 3
    last = {r[1]: tuple(r[2:]) for r in sorted(seen, key=lambda r: r[0])}
    want = {r.job_id: tuple(r)[1:] for r in J.job_states(spark.createDataFrame(rows, EVENTS)).select("job_id", "status", "created_at", "started_at", "completed_at", "error_message", "file_hash").collect()}
    assert last == want


class State:
    def __init__(self):
        self.exists, self.get = False, None

    def update(self, row):
        self.exists, self.get = True, row


def test_the_fold_equals_the_batch_fold_in_any_order(spark):
    """Shuffled transitions in shuffled batches, late errors and hashes among them."""
    rng = random.Random(3)
    rows, folded = [], {}
    for j in range(120):
        own = []
        for k in range(rng.randrange(1, 9)):
            own.append((str(j), k, at(rng.randrange(6)), rng.choice(["queued", "processing", "uploaded", "failed"]), rng.choice([None, "", "e%d" % k]), rng.choice([None, "h%d" % k])))
        rng.shuffle(own)
        rows += own
        state, left = State(), own
        while left:
            n = rng.randrange(1, len(left) + 1)
            part = pd.DataFrame(left[:n], columns=["job_id", "seq", "ts", "status", "error_message", "file_hash"])
            out = list(S.fold((str(j),), iter([part]), state))[0]
            left = left[n:]
        folded[str(j)] = tuple(None if v is None or v is pd.NaT else v for v in out.iloc[0].tolist()[1:])
    want = {r.job_id: tuple(r)[1:] for r in J.job_states(spark.createDataFrame(rows, EVENTS)).select("job_id", "status", "created_at", "started_at", "completed_at", "error_message", "file_hash").collect()}
    assert folded == want


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    """A batch drops by the watermark that the batch before it began with."""
    day = lambda d, h: datetime.datetime(2024, 1, d, h)
    for k, rows in enumerate([[("a", 1, day(1, 1), "queued", None, None)], [("a", 2, day(9, 1), "queued", None, None)], [("b", 1, day(10, 1), "queued", None, None)], [("a", 3, day(1, 1), "queued", None, None)]]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        for f in (tmp_path / "in" / str(k)).iterdir():
            os.utime(f, (1_700_000_000 + 60 * k,) * 2)  # the source takes the oldest files first
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen = []
    run = S.counts_by_window(source).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.select(F.date_format("start", "d"), "n").collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, seen)) == [("1", 1), ("10", 1), ("9", 1)]

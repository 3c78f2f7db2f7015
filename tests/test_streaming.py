import os
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from probity.plans import reviews as P
from probity.streaming import jobs as J

COLUMNS = ["review_id", "reviewer_id", "text", "stars", "published_at"]


@pytest.fixture(scope="module")
def days(spark, folder):
    """Reviews as one file per day, in time order of the files."""
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    df = P.reviews(spark, folder).select(*COLUMNS).cache()
    stamp = 1_700_000_000
    for i, day in enumerate(sorted(r[0] for r in df.select(F.to_date("published_at")).distinct().collect())):
        path = f"{base}/day={i:03d}"
        df.filter(F.to_date("published_at") == day).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(f"{path}/{f}", (stamp + i, stamp + i))
    return base, df


def stream(spark, base, df, n=6):
    return J.read_stream(spark, base + "/*", df.schema, files_per_trigger=n)


def test_stream_equals_batch(spark, days):
    base, df = days
    cols = ["review_id", "text_prediction", "fusion_prediction"]
    got = J.run_to_table(J.score_stream(stream(spark, base, df)).select(*cols))
    want = J.score_stream(df).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_totals_over_many_batches(spark, days):
    base, df = days
    got = J.run_to_table(J.decision_totals(stream(spark, base, df)), "complete").first()
    assert got == J.decision_totals(df).first()


def test_late_rows_are_dropped(spark, days):
    base, df = days
    late = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    t = datetime(2024, 1, 10)
    for i, when in enumerate((t, t + timedelta(days=9), t + timedelta(days=10), t, t + timedelta(days=20))):
        path = f"{late}/{i}"
        spark.createDataFrame([(i, 1, "a good day out", 3.0, when)], df.schema).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(f"{path}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    out = J.run_to_table(J.decisions_per_window(stream(spark, late, df, 1)), "append").collect()
    # The fourth file is ten days behind the newest row: its window was closed with the first row only.
    assert [r.n for r in out if r.start == t] == [1]


def test_progress_restarts(spark, days):
    base, df = days
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for _ in range(2):
        J.start_progress(stream(spark, base, df).select("review_id"), f"{out}/rows", f"{out}/check").awaitTermination()
    assert spark.read.parquet(f"{out}/rows").count() == df.count()


def test_late_stream_holds_every_event_in_several_files(spark, folder, catalog, monkeypatch):
    from pyspark.sql import functions as F

    from probity.plans.catalog import streams

    own = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name in os.listdir(folder):
        if name != "events.parquet":
            os.symlink(f"{folder}/{name}", f"{own}/{name}")
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.withColumn("ts", F.when(F.col("event_id") % 7 != 0, F.col("ts"))).write.parquet(f"{own}/events.parquet")
    assert catalog.queries["stream_totals"](spark, own).first().total_processed == events.count()

    want = sorted(map(tuple, catalog.queries["stream_decisions_per_day"](spark, own).collect()))
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    triggers = []
    read = J.read_stream
    monkeypatch.setattr(J, "read_stream", lambda *a, **b: triggers.append(b["files_per_trigger"]) or read(*a, **b))
    assert sorted(map(tuple, catalog.queries["stream_decisions_per_day"](spark, own).collect())) == want
    assert triggers[0] > 1

"""The keyed-state ring of day buckets against recounting, with late rows and a restart."""

import os
import tempfile
from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from probity.streaming import jobs as J
from probity.streaming import rings as R

SHAPE = "review_id long, reviewer_id long, published_at timestamp, stars double"
START = datetime(2024, 1, 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 90), st.integers(1, 4), st.booleans()), unique_by=lambda d: d[0], max_size=30), st.integers(1, 5))
def test_ring_equals_recount(days, cut):
    days = [(d, n, n if rated else 0, 2.5 * n if rated else 0.0) for d, n, rated in sorted(days)]
    ring, got = np.zeros(0, R.BUCKET), []
    for i in range(0, len(days), cut):
        batch = np.array(days[i : i + cut][::-1], R.BUCKET)  # order inside a batch does not matter
        ring, out = R.advance(ring, batch, (7, 30))
        got += out
        assert len(ring) <= 30
    want = []
    for d, *_ in days:
        row = [d]
        for span in (7, 30):
            part = [x for x in days if d - span < x[0] <= d]
            rated = sum(x[2] for x in part)
            row += [sum(x[1] for x in part), sum(x[3] for x in part) / rated if rated else None]
        want.append(tuple(row))
    assert got == want


def put(spark, base, number, rows):
    path = f"{base}/{number}"
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(path)
    for f in os.listdir(path):
        os.utime(f"{path}/{f}", (1_700_000_000 + number, 1_700_000_000 + number))


def review(i, reviewer, day, stars=4.0):
    return (i, reviewer, None if day is None else START + timedelta(days=day, hours=5), stars)


def day_number(day):
    return (START - datetime(1970, 1, 1)).days + day


def test_late_rows_and_restart(spark):
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    schema = spark.createDataFrame([], SHAPE).schema

    def run():
        stream = J.read_stream(spark, f"{base}/in/*", schema, files_per_trigger=1)
        J.start_progress(R.rolling_reviewer_days(stream), f"{base}/out", f"{base}/progress").awaitTermination()
        rows = spark.read.parquet(f"{base}/out").filter("day IS NOT NULL").collect()
        return {(r.reviewer_id, r.day - day_number(0)): (r.reviews_7d, r.stars_mean_7d, r.reviews_30d, r.stars_mean_30d) for r in rows}

    put(spark, f"{base}/in", 0, [review(1, 7, 0, 1.0), review(2, 7, 0, None), review(3, 8, 1), (4, None, START, 5.0), review(5, 7, None)])
    put(spark, f"{base}/in", 1, [review(6, 7, 5, 3.0), review(7, 9, 10)])
    put(spark, f"{base}/in", 2, [review(13, 9, 10)])  # a batch drops by the watermark that the batch before it ran with
    put(spark, f"{base}/in", 3, [review(8, 7, 1, 5.0), review(9, 7, 9, 5.0)])  # day 1 is closed by now, day 9 is not
    first = run()
    assert first[7, 0] == (2, 1.0, 2, 1.0) and first[8, 1] == (1, 4.0, 1, 4.0)
    assert first[7, 5] == (3, 2.0, 3, 2.0)
    assert (7, 1) not in first and (9, 10) not in first
    put(spark, f"{base}/in", 4, [review(10, 7, 20, 2.0), review(11, 9, 45)])
    put(spark, f"{base}/in", 5, [review(12, 9, 100)])
    second = run()  # goes on with the rings of the first run
    assert second[7, 9] == (2, 4.0, 4, 3.0)  # day 5 and day 9; the 30 days hold day 0 as well
    assert second[7, 20] == (1, 2.0, 5, 11 / 4)
    assert second[9, 10] == (2, 4.0, 2, 4.0) and second[9, 45] == (1, 4.0, 1, 4.0)
    assert {k: v for k, v in second.items() if k in first} == first

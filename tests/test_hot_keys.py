"""Split plans against plain ones on tables where one key, value or instant holds a large share."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from probity.functions.temporal import micros
from probity.operators import ordered as O
from probity.operators import windows as W


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(900):
        # A third of the rows belong to one reviewer, many at the very same instant.
        who = "hot" if i % 3 == 0 else f"u{i % 40}"
        at = start + timedelta(days=rng.randrange(60)) if i % 4 == 0 else start + timedelta(seconds=rng.randrange(60 * 86400))
        rows.append((i, who, at if i % 50 else None, float(rng.randrange(1, 6)) if i % 7 else None))
    df = spark.createDataFrame(rows, "review_id long, reviewer_id string, published_at timestamp, stars double")
    return O.cut_lineage(df)


def same(a, b, keys=("review_id",)):
    def rows(df):
        return sorted(
            (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect()),
            key=str,
        )

    assert rows(a) == rows(b)


def test_gap_of_hot_reviewer(skewed):
    timed = skewed.filter("published_at IS NOT NULL")
    w = Window.partitionBy("reviewer_id").orderBy("published_at", "review_id")
    here = micros(F.col("published_at"))
    want = timed.withColumn("days_since_last_review", F.floor((here - F.lag(here).over(w)) / 86_400e6).cast("long"))
    for buckets in (1, 7):
        same(W.days_since_previous(timed, buckets=buckets), want)


def test_rolling_buckets_agree(skewed):
    one, many = (W.rolling_stars(skewed, buckets=b) for b in (1, 7))
    same(one, many)
    assert many.count() == skewed.count()


def test_rolling_against_brute_force(skewed):
    rows = [r for r in skewed.collect() if r.published_at is not None]
    got = {r.review_id: r for r in W.rolling_stars(skewed, buckets=5).collect()}
    for r in rows[::37]:
        past = [
            x.stars for x in rows
            if x.reviewer_id == r.reviewer_id and r.published_at - timedelta(days=7) <= x.published_at < r.published_at
        ]
        stars = [s for s in past if s is not None]
        assert got[r.review_id].rolling_7d_review_count == len(past)
        assert got[r.review_id].rolling_7d_stars_count == len(stars)
        if stars:
            assert got[r.review_id].rolling_7d_stars_mean == pytest.approx(sum(stars) / len(stars))
        else:
            assert got[r.review_id].rolling_7d_stars_mean is None


@pytest.mark.parametrize("buckets", [2, 5, 40])
def test_global_row_number_with_heavy_value(skewed, buckets):
    # stars has five values and NULL: every value fills whole buckets.
    got = O.global_row_number(skewed, F.col("stars"), "review_id", buckets=buckets)
    want = skewed.withColumn(
        "rn", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("stars").asc_nulls_first(), "review_id")).cast("long")
    )
    same(got, want)


def test_heavy_value_is_spread(skewed):
    one = skewed.withColumn("v", F.when(F.col("review_id") % 3 > 0, F.lit(1.0)).otherwise(F.col("review_id").cast("double")))
    sizes = [r["n"] for r in O.with_buckets(one, F.col("v"), "review_id", 12).groupBy("_bucket").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 900 / 12 * 2.5


def test_row_number_with_text_tie(skewed):
    got = O.global_row_number(skewed.withColumn("key", F.concat(F.lit("r"), "review_id")), F.col("stars"), "key", buckets=6)
    assert sorted(r["rn"] for r in got.collect()) == list(range(1, 901))


def test_running_sums(skewed):
    df = skewed.filter("stars IS NOT NULL").withColumn("y", (F.col("review_id") % 2).cast("long"))
    for down in (False, True):
        got = {r["stars"]: r["cum_s"] for r in O.global_cumsum(df, "stars", {"s": F.sum("y")}, descending=down, buckets=4).collect()}
        rows = df.collect()
        for v in got:
            assert got[v] == sum(r.y for r in rows if (r.stars >= v if down else r.stars <= v))


def test_gap_over_whole_table(skewed):
    df = skewed.filter("published_at IS NOT NULL")
    w = Window.partitionBy(F.lit(1)).orderBy("published_at", "review_id")
    want = df.withColumn("prev_micros", F.lag(micros(F.col("published_at"))).over(w))
    same(O.gap_to_previous(df, micros(F.col("published_at")), "review_id", 9), want)


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_partition_count_does_not_matter(skewed, parts):
    base = W.rolling_stars(skewed).select("review_id", "rolling_7d_stars_mean")
    same(base, W.rolling_stars(skewed.repartition(parts), buckets=parts + 1).select("review_id", "rolling_7d_stars_mean"))


def test_rows_without_a_key_have_no_history(spark):
    t = datetime(2024, 1, 1)
    rows = [(i, None, t + timedelta(days=i), 3.0) for i in range(4)]
    df = spark.createDataFrame(rows, "review_id long, reviewer_id string, published_at timestamp, stars double")
    out = W.rolling_stars(W.days_since_previous(df), ).collect()
    assert all(r.days_since_last_review is None and r.rolling_7d_review_count == 0 for r in out)


def test_smallest_hashes(spark):
    from probity.operators.ordered import smallest

    df = spark.range(0, 40_000, numPartitions=64).withColumnRenamed("id", "review_id")
    code = F.xxhash64("review_id", F.lit(3))
    want = [r[0] for r in df.orderBy(code, "review_id").limit(500).collect()]
    found = smallest(df, code, 500, "review_id")
    assert [r[0] for r in found.collect()] == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan  # rows above the bound go before the order
    assert smallest(df.limit(0), code, 5, "review_id").count() == 0
    assert smallest(df.filter("review_id < 7"), code, 500, "review_id").count() == 7
    one = df.withColumn("review_id", F.lit(1).cast("long"))  # all rows share a hash
    assert smallest(one, code, 500, "review_id").count() == 500


def test_rolling_deviation_is_exact_behind_many_rows(spark):
    """Fractional stars of a hot key: equal to a two-pass deviation, and exactly 0 where all stars of the span are equal."""
    import statistics

    start = datetime(2020, 1, 1)
    early = spark.range(0, 2_000_000, numPartitions=16).select(
        F.col("id").alias("review_id"), F.lit(1).alias("reviewer_id"), F.timestamp_micros(F.col("id") * 40_000_000 + 1_000_000_000_000_000).alias("published_at"),
        (F.col("id") % 50 / 10).alias("stars"),
    )
    rows = [(10_000_000 + i, 1, start + timedelta(hours=7 * i), [4.3, 4.35, 1.1, 2.7][i % 4] if i < 60 else 4.3) for i in range(200)]
    late = spark.createDataFrame(rows, "review_id long, reviewer_id int, published_at timestamp, stars double")
    found = W.rolling_stars(early.unionByName(late), days=(7,)).filter("review_id >= 10000000").collect()
    assert len(found) == 200
    for r in found:
        own = [s for i, (_, _, t, s) in enumerate(rows) if r.published_at - timedelta(days=7) <= t < r.published_at]
        assert r.rolling_7d_stars_count == len(own)
        if len(own) > 1:
            assert abs(r.rolling_7d_stars_std - statistics.stdev(own)) < 1e-9
            assert len(set(own)) > 1 or r.rolling_7d_stars_std == 0.0
        if own:
            assert abs(r.rolling_7d_stars_mean - statistics.fmean(own)) < 1e-9


def test_texts_of_a_reviewer_are_counted_apart(spark):
    """Beside the statistics, a distinct count sent a set of them for each reviewer and text. Reviewers without a key are one."""
    from probity.operators.profiles import reviewer_profile

    rows = [(1, 5.0, "a"), (1, 3.0, "a"), (1, None, None), (2, 4.0, "b"), (None, 1.0, "c"), (None, 2.0, "d"), (3, None, None)]
    got = reviewer_profile(spark.createDataFrame(rows, "reviewer_id long, stars double, text string"))
    assert "count(distinct" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    found = {r.reviewer_id: (r.user_review_count, r.user_avg_rating, r.user_unique_text_ratio) for r in got.collect()}
    assert found == {1: (3, 4.0, 1 / 3), 2: (1, 4.0, 1.0), None: (2, 1.5, 1.0), 3: (1, None, 0.0)}

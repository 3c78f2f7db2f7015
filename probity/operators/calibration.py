"""Calibrating scores to probabilities."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.operators.ordered import collapse, running_sums, with_buckets
from probity.session import cut_lineage

SCALE, SHIFT = 0.7, -0.3
NEW_BUSINESS_RELIEF, SINGLE_REVIEW_RELIEF = 0.4, 0.3


def shifted(p: Column, new_business: Column, single_review: Column) -> Column:
    """clip(0.7 p - 0.3, 0, 1), then relief for new businesses and one-review reviewers."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p * SCALE + SHIFT))
    base = base * F.when(new_business, 1 - NEW_BUSINESS_RELIEF).otherwise(1.0)
    return base * F.when(single_review, 1 - SINGLE_REVIEW_RELIEF).otherwise(1.0)


def platt(df: DataFrame, score: str, y: str, out: str = "p_platt") -> DataFrame:
    """Logistic curve fitted to one score."""
    ready = VectorAssembler(inputCols=[score], outputCol="_x").transform(df)
    model = LogisticRegression(featuresCol="_x", labelCol=y, maxIter=50).fit(ready)
    a, b = float(model.coefficients[0]), float(model.intercept)
    return df.withColumn(out, 1 / (1 + F.exp(-(F.col(score) * a + b))))


def quantile_map(df: DataFrame, score: str, row_key: str = "review_id", out: str = "percentile") -> DataFrame:
    """Share of the other rows with a lower score (0 for the lowest, as ``percent_rank``)."""
    flat = collapse(df.filter(F.col(score).isNotNull()), score, {"n": F.count(F.lit(1))})
    steps = running_sums(flat, score, ["n"])
    total = flat.agg(F.sum("n").alias("t")).scalar()
    below = steps.withColumn("_t", total).select(
        score,
        F.when(F.col("_t") > 1, (F.col("cum_n") - F.col("n")) / (F.col("_t") - 1)).otherwise(0.0).alias(out),
    )
    return df.join(below, score, "left")


BLOCK_SCHEMA = "score double, w double, s double, _bucket int"
POOL_ROWS = 50_000


def pooled(score: np.ndarray, w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjacent violators pooled: blocks in score order whose mean ``s / w`` falls behind the block before are merged with it."""
    starts, weights, sums = [], [], []
    for x, b, a in zip(score.tolist(), w.tolist(), s.tolist()):
        while sums and sums[-1] * b > a * weights[-1]:
            x, b, a = starts.pop(), b + weights.pop(), a + sums.pop()
        starts.append(x)
        weights.append(b)
        sums.append(a)
    return np.array(starts), np.array(weights), np.array(sums)


def _pooled_buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pools every bucket of a sorted stream; a bucket is held whole, which its size bounds."""

    def out(parts: list, bucket: int) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*parts)]
        found = pooled(*columns)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.float64()) for c in found), pa.array(np.full(len(found[0]), bucket, np.int32))], names=["score", "w", "s", "_bucket"]
        )

    held, current = [], None
    for batch in batches:
        score, w, s, bucket = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if current is not None and bucket[a] != current:
                    yield out(held, current)
                    held = []
                current = int(bucket[a])
                held.append((score[a:b], w[a:b], s[a:b]))
    if held:
        yield out(held, current)


def isotonic_steps(flat: DataFrame, rows: int = POOL_ROWS) -> DataFrame:
    """The isotonic regression of a table of distinct ``score`` with weight ``w`` and sum ``s``, as steps: ``score`` (first of the step) and ``value``.

    Scores are cut into buckets of about ``rows`` blocks, and each bucket pools its violators. A block whose mean is at least every mean
    before its bucket and at most every mean behind it can never be pooled again: it is settled and leaves. Only the rest
    goes into the next round, in buckets twice as large, until all are settled. The means of buckets are compared in a table
    with a row per bucket; no block reaches the driver. Noise pools neighbours only, so most blocks settle in the first round; data
    that falls everywhere shrinks by the size of a bucket in each.
    """
    parts, left = [], cut_lineage(flat.select(F.col("score").cast("double"), F.col("w").cast("double"), F.col("s").cast("double")))
    while True:
        n = left.count()
        if n == 0:
            break
        cut = left.withColumn("_bucket", F.lit(0)) if n <= rows else with_buckets(left, F.col("score"), None, -(-n // rows))
        dealt = cut.select("score", "w", "s", "_bucket").repartition("_bucket").sortWithinPartitions("_bucket", "score")
        blocks = cut_lineage(dealt.mapInArrow(_pooled_buckets, BLOCK_SCHEMA))
        value = F.col("s") / F.col("w")
        ends = blocks.groupBy("_bucket").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
        behind = Window.orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
        ends = ends.select("_bucket", F.max("hi").over(before).alias("_before"), F.min("lo").over(behind).alias("_behind"))
        final = F.coalesce(value >= F.col("_before"), F.lit(True)) & F.coalesce(value <= F.col("_behind"), F.lit(True))
        judged = cut_lineage(blocks.join(F.broadcast(ends), "_bucket").withColumn("final", final))
        parts.append(judged.filter("final").select("score", value.alias("value")))
        left, rows = judged.filter("NOT final").select("score", "w", "s"), 2 * rows
    if not parts:
        return left.select("score", F.col("s").alias("value"))
    return reduce(DataFrame.unionByName, parts)


def isotonic(df: DataFrame, score: str, y: str, out: str = "p_isotonic", rows: int = POOL_ROWS) -> DataFrame:
    """Monotone calibration: the non-decreasing step function of the score that is nearest to ``y`` in squares.

    Rows without a score stay with a null result; rows without ``y`` do not count in the fit but get the step of their score.
    """
    sums = {"w": F.count(y).cast("double"), "s": F.coalesce(F.sum(F.col(y).cast("double")), F.lit(0.0))}
    flat = collapse(df.filter(F.col(score).isNotNull()).withColumn("score", F.col(score).cast("double")), "score", sums)
    steps = isotonic_steps(flat.filter("w > 0"), rows).withColumnRenamed("score", "_start")
    # Steps never fall, so the step of a score is the largest value up to it; scores below the first step take the first.
    marked = cut_lineage(with_buckets(flat.join(steps, F.col("score") == F.col("_start"), "left"), F.col("score"), None))
    carry = marked.groupBy("_bucket").agg(F.max("value").alias("_top"))
    over = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    carry = carry.select("_bucket", F.max("_top").over(over).alias("_carry"))
    inside = Window.partitionBy("_bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = steps.agg(F.min("value").alias("v")).scalar()
    found = marked.withColumn("_run", F.max("value").over(inside)).join(F.broadcast(carry), "_bucket")
    found = found.select(F.col("score").alias("_score"), F.coalesce(F.greatest("_run", "_carry"), first).alias(out))
    return df.join(found, F.col(score).cast("double") == F.col("_score"), "left").drop("_score")

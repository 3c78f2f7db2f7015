"""Isotonic calibration against the max-min formula, in buckets far smaller than the data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators import calibration as C


def brute(score, y):
    """max over starts of min over ends of the mean between them, per distinct score."""
    xs = sorted(set(score))
    w = np.array([sum(s == x for s in score) for x in xs], float)
    t = np.array([sum(v for s, v in zip(score, y) if s == x) for x in xs], float)
    cw, ct = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(t)])
    n = len(xs)
    mean = np.full((n, n), np.inf)
    for j in range(n):
        mean[j, j:] = (ct[j + 1 :] - ct[j]) / (cw[j + 1 :] - cw[j])
    least = np.minimum.accumulate(mean[:, ::-1], axis=1)[:, ::-1]
    return {x: max(least[j, i] for j in range(i + 1)) for i, x in enumerate(xs)}


SHAPES = {
    "noise": lambda x, d: d.random() < x,
    "falling": lambda x, d: d.random() > x,
    "saw": lambda x, d: d.random() < (x * 9) % 1,
    "rising": lambda x, d: x > 0.5,
    "one value": lambda x, d: 1,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_isotonic_equals_brute_force(spark, shape):
    draw = np.random.default_rng(4)
    score = [float(round(v, 3)) for v in draw.random(900)]
    y = [int(SHAPES[shape](x, draw)) for x in score]
    df = spark.createDataFrame(list(zip(range(len(y)), score, y)), "review_id long, p double, y int")
    want = brute(score, y)
    for rows in (16, 10_000):
        got = C.isotonic(df, "p", "y", rows=rows).collect()
        assert len(got) == len(y)
        assert max(abs(r.p_isotonic - want[r.p]) for r in got) < 1e-9


def test_isotonic_edge_rows(spark):
    rows = [(1, None, 1), (2, 0.1, None), (3, 0.2, 1), (4, 0.2, 0), (5, 0.9, 1), (6, 0.95, None)]
    df = spark.createDataFrame(rows, "review_id long, p double, y int")
    got = {r.review_id: r.p_isotonic for r in C.isotonic(df, "p", "y").collect()}
    assert got == {1: None, 2: 0.5, 3: 0.5, 4: 0.5, 5: 1.0, 6: 1.0}
    assert C.isotonic(df.limit(0), "p", "y").count() == 0


def test_blocks_settle_in_their_bucket(spark):
    """Scores that rise with the truth settle in the first round: the rounds stop there, whatever the number of steps."""
    df = spark.range(0, 20_000).select((F.col("id") / 20_000).alias("score"), F.lit(1.0).alias("w"), (F.col("id") / 20_000).alias("s"))
    steps = C.isotonic_steps(df, rows=500)
    assert steps.count() == 20_000 and "Union" not in steps._jdf.queryExecution().optimizedPlan().toString()

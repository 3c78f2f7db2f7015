"""The exact pair of thresholds against all pairs of scores."""

import random
from collections import Counter

import pytest

from probity.operators import thresholds


def brute(rows, max_route, min_precision, c_fp=5, c_fn=3, c_route=1):
    rows = [(p, y) for p, y in rows if p is not None and y is not None]
    steps = sorted({p for p, _ in rows})
    best = None
    for low in [float("-inf"), *steps]:
        for high in [*steps, float("inf")]:
            if low >= high:
                continue
            fp = sum(p >= high and y == 0 for p, y in rows)
            tp = sum(p >= high and y == 1 for p, y in rows)
            fn = sum(p <= low and y == 1 for p, y in rows)
            routes = sum(low < p < high for p, _ in rows)
            if routes > max_route * len(rows) + 1e-9 or (tp / (tp + fp) if tp + fp else 0) < min_precision:
                continue
            # Nothing removed sorts first among equal costs, as a null does.
            key = (c_fp * fp + c_fn * fn + c_route * routes, low, -1 if high == float("inf") else high)
            if best is None or key < best[0]:
                best = (key, (None if low == float("-inf") else low, None if high == float("inf") else high, fp, tp, fn, routes))
    return best and best[1]


def found(spark, rows, **limits):
    df = spark.createDataFrame(rows, "p_final double, y int")
    out = thresholds.exact_thresholds(df, **limits).collect()
    return tuple(out[0][c] for c in ("low", "high", "fp", "tp", "fn", "routes")) if out else None


def scores(n, steps, seed, hot=0.0):
    """Truth follows the score with noise; ``hot`` is the share of rows on one score."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        p = 0.5 if draw.random() < hot else draw.randrange(steps) / steps
        out.append((p, int(draw.random() < p**2)))
    return out


@pytest.mark.parametrize(
    ("n", "steps", "hot", "buckets", "max_route", "min_precision"),
    [
        (120, 40, 0.0, 4096, 0.3, 0.5), (120, 40, 0.35, 4096, 0.3, 0.5), (120, 200, 0.0, 7, 0.25, 0.4), (150, 60, 0.35, 5, 0.5, 0.0),
        (100, 50, 0.0, 4096, 0.0, 0.3), (100, 50, 0.0, 3, 1.0, 0.2), (90, 30, 0.3, 4, 0.02, 0.6), (60, 20, 0.0, 4096, 0.1, 1.01),
    ],
)
def test_equals_all_pairs(spark, monkeypatch, n, steps, hot, buckets, max_route, min_precision):
    monkeypatch.setattr(thresholds, "BUCKETS", buckets)
    rows = scores(n, steps, n + steps, hot)
    assert found(spark, rows, max_route=max_route, min_precision=min_precision) == brute(rows, max_route, min_precision)


def test_edges(spark):
    limits = {"max_route": 0.2, "min_precision": 0.5}
    assert found(spark, [], **limits) is None
    assert found(spark, [(None, 1), (0.5, None)], **limits) is None
    assert found(spark, [(0.5, 1)] * 9 + [(None, 1)], **limits) == (None, 0.5, 0, 9, 0, 0)
    same = [(0.0, 0), (-0.0, 1), (1.0, 1)]
    assert found(spark, same, **limits) == brute(same, **limits)
    assert Counter(scores(50, 5, 1))  # repeated rows are counted, not merged
    twice = scores(50, 5, 1) * 2
    assert found(spark, twice, **limits) == brute(twice, **limits)

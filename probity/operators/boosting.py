"""Boosted trees for one class against the rest, grown on a bounded sample of labelled rows.

Spark deals the rows out by class; each class is one task that grows its whole ensemble on binned features. Scoring walks
all trees at once over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 64
SHRINK = 1.0  # added to the second derivatives of a leaf
SCHEMA = "cls int, start double, feature array<int>, cut array<double>, value array<double>, gains array<double>"


def grow(codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
    """One tree as arrays in heap order (children of i: 2i+1, 2i+2), the leaf value of every row, and gain per feature."""
    rows, width = codes.shape
    size = 2 ** (depth + 1) - 1
    feature, split, value, gains = np.full(size, -1), np.zeros(size, int), np.zeros(size), np.zeros(width)
    node = np.zeros(rows, int)
    for level in range(depth + 1):
        first, count = 2**level - 1, 2**level
        inside = node >= first
        at = node[inside] - first
        g, h = (np.bincount(at, v[inside], count) for v in (grad, hess))
        value[first : first + count] = g / (h + SHRINK)
        if level == depth:
            break
        best = np.full(count, 1e-6)
        for f in range(width):
            key = at * BINS + codes[inside, f]
            gl, hl = (np.bincount(key, v[inside], count * BINS).reshape(count, BINS).cumsum(axis=1) for v in (grad, hess))
            gr, hr = g[:, None] - gl, h[:, None] - hl
            gain = gl**2 / (hl + SHRINK) + gr**2 / (hr + SHRINK) - (g**2 / (h + SHRINK))[:, None]
            gain[(hl < 1e-3) | (hr < 1e-3)] = 0
            top = gain.argmax(axis=1)
            reach = gain[np.arange(count), top]
            better = reach > best
            best[better] = reach[better]
            feature[first : first + count][better] = f
            split[first : first + count][better] = top[better]
        for i in np.flatnonzero(feature[first : first + count] >= 0):
            gains[feature[first + i]] += best[i]
        chosen = feature[node]
        moves = inside & (chosen >= 0)
        right = codes[np.arange(rows), np.maximum(chosen, 0)] > split[node]
        node = np.where(moves, 2 * node + 1 + right, node)
    return feature, split, value, value[node], gains


def ensemble(x: np.ndarray, y: np.ndarray, rounds: int, rate: float, depth: int):
    """Trees that follow the gradient of the logistic loss, ``rate`` of each; cuts are given in units of the features."""
    points = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    codes = np.column_stack([np.searchsorted(p, c, side="left") for p, c in zip(points, x.T)])
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    total, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        feature, split, value, step, gains = grow(codes, y - p, p * (1 - p), depth)
        total += rate * step
        cut = [float(points[f][s]) if f >= 0 and s < len(points[f]) else float("inf") for f, s in zip(feature, split)]
        trees.append((feature, cut, rate * value, gains))
    return start, trees


def fit(df: DataFrame, features: str, label: str, classes: int, rounds: int, rate: float, depth: int) -> list[dict]:
    """The trees of every class (bounded: classes x rounds), from rows with an array of features and a class number."""
    rows = df.select(F.col(features).alias("x"), F.col(label).cast("int").alias("y"))
    rows = rows.withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(k=[v.tobytes() for v in pdf["x"]]).sort_values(["k", "y"])  # the same order on every run
        cls = int(pdf["cls"].iloc[0])
        start, trees = ensemble(np.stack(pdf["x"].to_numpy()), (pdf["y"] == cls).to_numpy(float), rounds, rate, depth)
        return pd.DataFrame([{"cls": cls, "start": start, "feature": f, "cut": c, "value": v, "gains": g} for f, c, v, g in trees])

    return [r.asDict() for r in rows.groupBy("cls").applyInPandas(one, SCHEMA).collect()]


def probabilities(spark, trees: list[dict], classes: int, depth: int, vector: Column) -> Column:
    """Probability of every class, each from its own trees, normalised to sum 1."""
    packed = []
    for cls in range(classes):
        own = [t for t in trees if t["cls"] == cls]
        packed.append((own[0]["start"], [(np.array(t["feature"]), np.array(t["cut"]), np.array(t["value"])) for t in own]))
    sent = spark.sparkContext.broadcast(packed)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            x = np.stack(series.to_numpy()) if len(series) else np.zeros((0, 1))
            rows, out = np.arange(len(x)), []
            for start, own in sent.value:
                total = np.full(len(x), start)
                for feature, cut, value in own:
                    at = np.zeros(len(x), int)
                    for _ in range(depth):
                        f = feature[at]
                        at = np.where(f >= 0, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > cut[at]), at)
                    total += value[at]
                out.append(1 / (1 + np.exp(-total)))
            p = np.column_stack(out)
            yield pd.Series(list(p / p.sum(axis=1, keepdims=True)))

    return score(vector)

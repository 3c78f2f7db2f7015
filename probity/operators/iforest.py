"""Isolation forest (Liu, Ting, Zhou 2008) fitted on bounded samples and scored in Arrow batches.

Whatever the table size, a fit draws at most ``trees * sample`` rows: a hash of the row key picks a
pool, each tree takes its own rows from the pool. The forest itself is at most ``trees * 511`` nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.operators.anomaly import clean, flag_share
from probity.session import cut_lineage

TREE_SCHEMA = (
    "tree int, rows int, feature array<int>, cut array<double>, left array<int>, right array<int>, "
    "path array<double>"
)
EULER = 0.5772156649015329


def mean_path(n):
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _unit(*cols):
    """A stable number in [0, 1) from the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(2**53)).cast("double") / float(2**53)


def grow(points: np.ndarray, columns: np.ndarray, rng: np.random.Generator):
    """One tree as parallel arrays; leaves carry their depth plus the correction for their size."""
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    feature, cut, left, right, path = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        me = len(feature)
        feature.append(-1)
        cut.append(0.0)
        left.append(-1)
        right.append(-1)
        path.append(float(depth + mean_path(len(rows))))
        if depth >= limit or len(rows) <= 1:
            return me
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        usable = [c for c in columns if high[c] > low[c]]
        if not usable:
            return me
        c = int(rng.choice(usable))
        at = float(rng.uniform(low[c], high[c]))
        goes_left = points[rows, c] <= at
        if goes_left.all() or not goes_left.any():
            return me
        feature[me], cut[me] = c, at
        left[me] = node(rows[goes_left], depth + 1)
        right[me] = node(rows[~goes_left], depth + 1)
        return me

    node(np.arange(len(points)), 0)
    return feature, cut, left, right, path


ROWS = 1024  # rows that walk down the trees together


def _flat(row: dict) -> tuple:
    """A tree without ends to ask for: a leaf leads to itself. Children stand side by side, the left one first."""
    feature, left, right = (np.asarray(row[k], np.int64) for k in ("feature", "left", "right"))
    leaf, me = feature < 0, np.arange(len(feature))
    children = np.column_stack([np.where(leaf, me, left), np.where(leaf, me, right)]).ravel()
    depth, level = 0, np.zeros(1, np.int64)
    while not leaf[level].all():
        inner = level[~leaf[level]]
        depth, level = depth + 1, np.concatenate([left[inner], right[inner]])
    return np.maximum(feature, 0), np.asarray(row["cut"], float), children, np.asarray(row["path"], float), depth


def _total_path(x: np.ndarray, forest: list[tuple]) -> np.ndarray:
    """Summed path lengths of the rows of ``x`` over all trees."""
    n, width = x.shape
    flat, starts, total = np.ascontiguousarray(x).ravel(), np.arange(n) * width, np.zeros(n)
    for feature, cut, children, path, depth in forest:
        at = np.zeros(n, np.int64)
        for _ in range(depth):
            right = ~(flat.take(starts + feature.take(at)) <= cut.take(at))
            at = children.take(2 * at + right)
        total += path.take(at)
    return total


@dataclass
class IsolationForest:
    features: list[str]
    trees: int = 200
    sample: int = 256
    max_features: int = 15
    contamination: float = 0.08
    seed: int = 42
    row_key: str = "review_id"

    def fit(self, df: DataFrame) -> "ForestModel":
        data = df.select(self.row_key, *[clean(F.col(f)).alias(f) for f in self.features])
        n = data.count()
        draw = min(1.0, 1.5 * self.sample / max(n, 1))
        # Each tree draws from all rows, by their keys alone: about 1.5 * sample rows of each tree are left to fetch.
        drawn = data.select(F.col(self.row_key).alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))).alias("tree"))
        place = _unit(F.col("_key"), F.col("tree"), F.lit(self.seed + 1))
        drawn = drawn.filter(place < draw).distinct().withColumn("_u", place)
        each = data.join(F.broadcast(drawn), F.col(self.row_key).eqNullSafe(F.col("_key"))).drop("_key")
        # About 1.5 * sample rows reach a tree, whatever the size of the table.
        w = Window.partitionBy("tree").orderBy("_u", self.row_key)
        each = each.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= self.sample)
        width, share, seed, names = len(self.features), self.max_features, self.seed, list(self.features)

        def fit_tree(pdf: pd.DataFrame) -> pd.DataFrame:
            t = int(pdf["tree"].iloc[0])
            rng = np.random.default_rng([seed, t])
            pdf = pdf.sort_values("_k")
            cols = np.sort(rng.choice(width, size=min(width, share), replace=False))
            f, c, lo, hi, p = grow(pdf[names].to_numpy(float), cols, rng)
            return pd.DataFrame(
                {"tree": [t], "rows": [len(pdf)], "feature": [f], "cut": [c], "left": [lo], "right": [hi], "path": [p]}
            )

        forest = each.groupBy("tree").applyInPandas(fit_tree, TREE_SCHEMA)
        return ForestModel(forest, self.features, self.contamination)


class ForestModel:
    """A fitted forest: a table with one row per tree (at most a few hundred rows)."""

    def __init__(self, forest: DataFrame, features: list[str], contamination: float):
        self.features = list(features)
        self.contamination = contamination
        rows = sorted(forest.collect(), key=lambda r: r["tree"])
        self.rows = [r.asDict() for r in rows]
        self.spark = forest.sparkSession

    def save(self, path: str) -> None:
        frame = self.spark.createDataFrame(
            [{**r, "features": self.features, "contamination": float(self.contamination)} for r in self.rows],
            TREE_SCHEMA + ", features array<string>, contamination double",
        )
        frame.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "ForestModel":
        frame = spark.read.parquet(path)
        head = frame.select("features", "contamination").first()
        return cls(frame.drop("features", "contamination"), head["features"], head["contamination"])

    def score(self, df: DataFrame, out: str = "ml_anomaly_score") -> DataFrame:
        """Adds 2^(-mean path / expected path): near 1 is odd, 0.5 and below is ordinary."""
        trees = [_flat(r) for r in self.rows]
        expected = float(np.mean([mean_path(r["rows"]) for r in self.rows]))
        shared = self.spark.sparkContext.broadcast(trees)

        @F.pandas_udf("double")
        def depth_score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            forest = shared.value
            for series in batches:
                x = np.column_stack([s.to_numpy(float) for s in series])
                total = np.concatenate([np.zeros(0), *[_total_path(x[i : i + ROWS], forest) for i in range(0, len(x), ROWS)]])
                yield pd.Series(np.power(2.0, -total / len(forest) / max(expected, 1e-9)))

        return df.withColumn(out, depth_score(*[clean(F.col(f)) for f in self.features]))

    def detect(self, df: DataFrame, out: str = "ml_anomaly_score", flag: str = "ml_anomaly") -> DataFrame:
        """Score and the contamination cut. ``<out>_centred`` is the score less the cut: above 0 is odd."""
        # The cut needs all scores before the first flag: they are stored, not computed twice.
        return flag_share(cut_lineage(self.score(df, out)), out, self.contamination, flag)


def stage_probability(centred):
    """Centred anomaly score to [0, 1]: (s + 1) / 2, clipped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (centred + 1) / 2))

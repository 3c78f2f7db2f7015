import random
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators import anomaly as A
from probity.operators import fusion as M
from probity.operators import gridsearch as G
from probity.operators import iforest as I
from probity.operators import textmodel as T
from probity.plans.catalog import models
from probity.session import cut_lineage

NAMES = [f"x{i}" for i in range(8)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(3)
    rows = []
    for i in range(2000):
        odd = i % 100 == 0
        rows.append((i, odd, *[rng.gauss(8 if odd else 0, 1) for _ in NAMES]))
    df = spark.createDataFrame(rows, "review_id long, planted boolean, " + ", ".join(f"{n} double" for n in NAMES))
    return cut_lineage(df)


def test_forest_ranks_planted_first(planted):
    model = I.IsolationForest(NAMES, trees=60, contamination=0.01).fit(planted)
    out = model.detect(planted)
    top = out.orderBy(F.desc("ml_anomaly_score")).limit(20).collect()
    assert all(r.planted for r in top)
    share = out.agg(F.avg("ml_anomaly")).first()[0]
    assert share == pytest.approx(0.01, abs=0.002)
    assert max(r["rows"] for r in model.rows) <= 256


def test_forest_is_stable_and_saved(spark, planted):
    a = I.IsolationForest(NAMES, trees=10).fit(planted)
    b = I.IsolationForest(NAMES, trees=10).fit(planted.repartition(5))
    assert a.rows == b.rows
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/forest"
    a.save(path)
    again = I.ForestModel.load(spark, path)
    x = a.score(planted).agg(F.sum("ml_anomaly_score")).first()[0]
    assert x == pytest.approx(again.score(planted).agg(F.sum("ml_anomaly_score")).first()[0])


def test_model_features_order(spark):
    df = spark.createDataFrame([(1, 2, 3.0, 4.0, "s")], "review_id long, a int, text_risk double, b_anomaly double, s string")
    assert A.model_features(df) == ["text_risk", "a"]
    wide = spark.createDataFrame([tuple(range(60))], ", ".join(f"c{i} int" for i in range(60)))
    assert len(A.model_features(wide)) == 60


def test_text_model_learns(spark):
    rows = [(i, "buy cheap pills now" if i % 2 else "lovely soup and kind staff", "spam" if i % 2 else "genuine_positive") for i in range(60)]
    df = spark.createDataFrame(rows, "review_id long, text string, label string")
    for balanced in (False, True):
        out = T.text_model_scores(df, T.train_text_model(df, balanced, iterations=5, features=256))
        assert out.filter("label <> text_prediction").count() == 0
        assert out.select(F.size("probs")).first()[0] == 7


def test_failed_training_is_a_row(spark):
    def broken():
        raise RuntimeError("no data")

    r = T.training_runs(spark, {"bad": broken}).first()
    assert r.success is False and r.path is None


def test_boosting_fits_a_step_and_a_corner():
    from probity.operators.boosting import ensemble

    rng = np.random.default_rng(3)
    x = rng.random((1500, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.7)).astype(float)
    start, trees = ensemble(x, y, 30, 0.3, 3)
    total = np.full(len(x), start)
    for feature, cut, value, _ in trees:
        for i, row in enumerate(x):
            at = 0
            while feature[at] >= 0:
                at = 2 * at + 1 + int(row[feature[at]] > cut[at])
            total[i] += value[at]
    assert ((total > 0) == (y > 0)).mean() > 0.97
    gains = np.sum([t[3] for t in trees], axis=0)
    assert set(np.argsort(gains)[-2:]) == {0, 2}


def test_bound_of_a_fit_does_not_bound_the_scored_rows(spark, folder, monkeypatch):
    rows = models.fusion_rows(spark, folder).count()
    fitted = []
    sample, fit = M.fit_sample, M.FusionModel.fit
    monkeypatch.setattr(M, "fit_sample", lambda df, row_key="review_id": sample(df, row_key, 200))
    monkeypatch.setattr(M.FusionModel, "fit", lambda self, df: fitted.append(df.count()) or fit(self, df))
    assert rows > 200
    got = {r.is_train: r.n for r in models.split_accuracy(spark, folder, "logistic", maxIter=5).collect()}
    assert fitted == [200] and got == {True: int(0.8 * rows), False: rows - int(0.8 * rows)}


def test_grid_search_tries_every_setting(spark, folder):
    rows = models.fusion_rows(spark, folder)
    small = {
        "random_forest": {"numTrees": [2, 3, 4], "maxDepth": [1, 2, 3], "minInstancesPerNode": [2, 5, 10]},
        "boosting": {"maxIter": [1, 2, 3], "stepSize": [0.05, 0.1, 0.2], "maxDepth": [1, 2, 3]},
        "neural_network": {"hidden": [(2,), (3,), (3, 2), (4, 2)], "stepSize": [0.001, 0.01, 0.1]},
    }
    assert {k: {n: len(v) for n, v in g.items()} for k, g in small.items()} == {k: {n: len(v) for n, v in g.items()} for k, g in M.GRIDS.items()}
    found = M.search(rows, small).collect()
    assert Counter(r.kind for r in found) == {"random_forest": 27, "boosting": 27, "neural_network": 12}
    assert len({(r.kind, r.setting) for r in found}) == 66 and all(0 <= r.accuracy <= 1 and r.deviation >= 0 for r in found)
    assert found == M.search(rows, small).collect()  # reruns agree
    assert len(G.jobs_of(M.GRIDS, 5)) == 5 * (3 + 9 + 12)


@pytest.fixture(scope="module")
def numbers():
    draw = np.random.default_rng(8)
    x = np.round(draw.random((600, 6)), 2)
    y = (x[:, 0] > 0.5).astype(int) + 2 * ((x[:, 1] + 0.2 * draw.random(600)) > 0.7)
    return x, G.binned(x), y


def test_settings_that_share_a_fit(numbers):
    _, codes, y = numbers
    train, test = (codes[:400], y[:400]), (codes[400:], y[400:])
    shared = G.boosting_scores(train, test, 4, [2, 5, 9], 0.3, 3)
    assert all(G.boosting_scores(train, test, 4, [n], 0.3, 3) == {n: a} for n, a in shared.items()) and shared[9] > 0.8
    forest = G.forest_scores(train, test, 4, [3, 8], [1, 3, 7], 2, seed=1)
    assert all(G.forest_scores(train, test, 4, [n], [d], 2, seed=1) == {(n, d): a} for (n, d), a in forest.items()) and forest[8, 7] > 0.8


def test_tree_with_subtracted_histograms_equals_plain_search(numbers):
    """Every split of a tree has the best gain that counting the node's own rows anew finds."""
    _, codes, y = numbers
    grad, hess = (y == 1) - 0.3, np.full(len(y), 0.21)
    levels, step = G.boosted_tree(codes + np.arange(6) * G.BINS, codes, grad, hess, 4)
    nodes = [np.arange(len(y))]
    for feature, split, value, child in levels:
        below = {}
        for i, rows in enumerate(nodes):
            g, h = grad[rows].sum(), hess[rows].sum()
            assert value[i] == pytest.approx(g / (h + G.SHRINK))
            gains = {}
            for f in range(6):
                for c in range(G.BINS):
                    left = rows[codes[rows, f] <= c]
                    if 0 < len(left) < len(rows):
                        gl, hl = grad[left].sum(), hess[left].sum()
                        gains[f, c] = gl**2 / (hl + G.SHRINK) + (g - gl) ** 2 / (h - hl + G.SHRINK) - g**2 / (h + G.SHRINK)
            if feature[i] >= 0:
                assert gains[feature[i], split[i]] == pytest.approx(max(gains.values()))
                right = codes[rows, feature[i]] > split[i]
                below[child[i]], below[child[i] + 1] = rows[~right], rows[right]
            else:
                assert child is None or max(gains.values(), default=0) <= 1e-6
                assert step[rows] == pytest.approx(value[i])
        nodes = [below[k] for k in sorted(below)]


def test_network_learns(numbers):
    x, _, y = numbers
    assert G.network_score((x[:400], y[:400]), (x[400:], y[400:]), 4, (20,), 0.01, seed=3) > 0.8


def test_forest_draws_by_keys_and_walks_flat_trees(spark):
    """Keys that repeat or are null draw like others, wide rows are fetched only when drawn, and the score is that of a plain walk."""
    draw = np.random.default_rng(3)
    rows = [(None if i % 50 == 0 else i // 2, *map(float, draw.normal(size=2))) for i in range(400)]
    df = spark.createDataFrame(rows, "review_id long, x0 double, x1 double")
    forest = I.IsolationForest(["x0", "x1"], trees=5, sample=64)
    model = forest.fit(df)
    assert [r["rows"] for r in model.rows] == [64] * 5
    share = 1.5 * 64 / 400
    place = I._unit(F.col("review_id"), F.col("tree"), F.lit(forest.seed + 1))
    every = df.crossJoin(spark.range(5).select(F.col("id").cast("int").alias("tree"))).withColumn("u", place).filter(F.col("u") < share)
    assert every.groupBy("tree").count().filter("count < 64").count() == 0
    x = np.array([r[1:] for r in rows])

    def walk(tree, point):
        at = 0
        while tree["feature"][at] >= 0:
            at = tree["left"][at] if point[tree["feature"][at]] <= tree["cut"][at] else tree["right"][at]
        return tree["path"][at]

    want = np.array([sum(walk(t, p) for t in model.rows) for p in x])
    assert I._total_path(x, [I._flat(t) for t in model.rows]) == pytest.approx(want, rel=1e-12)

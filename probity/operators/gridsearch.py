"""Grid search as one Spark job: each row is a model family, a setting and a fold, and its task grows everything that such a row needs.

The labelled rows of a search are bounded (``fusion.FIT_ROWS``); they go to the tasks once, already cut into bins. Settings that are
prefixes of each other share one fit: fewer rounds or trees are the first ones of more, and a shallower forest is a deeper one
read at an earlier level. A level's histograms are counted for the smaller child of each split only; the larger one is the parent's
minus its sister's. A lost executor repeats its own rows of the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
SHRINK = 1.0  # added to the second derivatives of a leaf
SCORES = "kind string, setting string, fold int, accuracy double"


def binned(x: np.ndarray) -> np.ndarray:
    """Bin numbers of every feature, by quantiles of all rows of the search."""
    points = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    return np.column_stack([np.searchsorted(p, c, side="left") for p, c in zip(points, x.T)]).astype(np.int64)


def _smaller_first(at: np.ndarray, count: int, sums, parents: list[np.ndarray]) -> list[np.ndarray]:
    """Histograms of the children 2i and 2i + 1 of every parent: the smaller child counted, the other by subtraction."""
    sizes = np.bincount(at, minlength=2 * count).reshape(count, 2)
    counted = (np.arange(count) * 2 + (sizes[:, 1] < sizes[:, 0])).astype(np.int64)
    small = np.zeros(2 * count, bool)
    small[counted] = True
    found = sums(np.flatnonzero(small[at]))
    for child, parent in zip(found, parents):
        child[counted ^ 1] = parent - child[counted]
    return found


def boosted_tree(keys: np.ndarray, codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
    """Feature, split, value and first child of the nodes of every level, and the leaf value of every row."""
    rows, width = codes.shape
    at, active = np.zeros(rows, np.int64), np.arange(rows)
    step, levels = np.zeros(rows), []

    def sums(chosen: np.ndarray) -> list[np.ndarray]:
        key = (at[chosen][:, None] * (width * BINS) + keys[active[chosen]]).ravel()
        return [np.bincount(key, np.repeat(v[active[chosen]], width), count * width * BINS).reshape(count, width, BINS) for v in (grad, hess)]

    count = 1
    g, h = sums(np.arange(rows))
    for level in range(depth + 1):
        if not count:
            break
        total_g, total_h = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
        value = total_g / (total_h + SHRINK)
        step[active] = value[at]
        if level == depth:
            levels.append((np.full(count, -1), np.zeros(count, np.int64), value, None))
            break
        gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
        gr, hr = total_g[:, None, None] - gl, total_h[:, None, None] - hl
        gain = gl * gl / (hl + SHRINK) + gr * gr / (hr + SHRINK)
        gain[(hl < 1e-3) | (hr < 1e-3)] = -np.inf
        gain = gain.reshape(count, -1)
        top = gain.argmax(axis=1)
        good = gain[np.arange(count), top] - total_g * value > 1e-6
        feature, split = np.where(good, top // BINS, -1), top % BINS
        child = 2 * (np.cumsum(good) - 1)  # only nodes with a split have children
        levels.append((feature, split, value, child))
        moves = good[at]
        at, active = at[moves], active[moves]
        at = child[at] + (codes[active, feature[at]] > split[at])
        count = 2 * int(good.sum())
        if count:
            g, h = _smaller_first(at, count // 2, sums, [g[good], h[good]])
    return levels, step


def walk(levels, codes: np.ndarray) -> Iterator[np.ndarray]:
    """The value of every row at each level of a tree; a row whose node has no split keeps its value."""
    at, live = np.zeros(len(codes), np.int64), np.arange(len(codes))
    out = None
    for feature, split, value, child in levels:
        if out is None:
            out = np.zeros((len(codes), *value.shape[1:]))
        out[live] = value[at]
        yield out
        moves = feature[at] >= 0
        at, live = at[moves], live[moves]
        if len(live):
            at = child[at] + (codes[live, feature[at]] > split[at])


def boosting_scores(train, test, classes: int, rounds: list[int], rate: float, depth: int) -> dict[int, float]:
    """Accuracy after each number of rounds, one ensemble against the rest per class."""
    (codes, y), (held, truth) = train, test
    keys = codes + np.arange(codes.shape[1]) * BINS
    share = {n: np.zeros((len(held), classes)) for n in rounds}
    for cls in range(classes):
        target = (y == cls).astype(float)
        p = min(max(target.mean(), 1e-6), 1 - 1e-6)
        own, other = np.full(len(y), np.log(p / (1 - p))), np.full(len(held), np.log(p / (1 - p)))
        for n in range(1, max(rounds) + 1):
            p = 1 / (1 + np.exp(-own))
            levels, step = boosted_tree(keys, codes, target - p, p * (1 - p), depth)
            own += rate * step
            for value in walk(levels, held):
                last = value
            other += rate * last
            if n in share:
                share[n][:, cls] = 1 / (1 + np.exp(-other))
    return {n: float((s.argmax(axis=1) == truth).mean()) for n, s in share.items()}


def forest_tree(codes, y, weight, classes: int, depth: int, least: int, draw: np.random.Generator):
    """A tree of a forest by gini impurity on a random subset of features per node; values are class shares."""
    rows, width = codes.shape
    tried = int(np.ceil(np.sqrt(width)))
    active = np.flatnonzero(weight)
    at, levels, count = np.zeros(len(active), np.int64), [], 1
    for level in range(depth + 1):
        totals = np.bincount(at * classes + y[active], weight[active], count * classes).reshape(count, classes)
        size = totals.sum(axis=1)
        share = totals / np.maximum(size, 1)[:, None]
        feature, split = np.full(count, -1), np.zeros(count, np.int64)
        open_ = np.flatnonzero((size >= 2 * least) & (share.max(axis=1, initial=0) < 1))
        if level == depth or not len(open_):
            levels.append((feature, split, share, None))
            break
        number = np.full(count, -1)
        number[open_] = np.arange(len(open_))
        keep = number[at] >= 0
        at, active = at[keep], active[keep]
        chosen = draw.random((len(open_), width)).argsort(axis=1)[:, :tried]
        node = number[at]
        code = np.take_along_axis(codes[active], chosen[node], axis=1)
        key = (((node[:, None] * tried + np.arange(tried)) * BINS + code) * classes + y[active][:, None]).ravel()
        left = np.bincount(key, np.repeat(weight[active], tried), len(open_) * tried * BINS * classes)
        left = left.reshape(len(open_), tried, BINS, classes).cumsum(axis=2)
        right = totals[open_][:, None, None, :] - left
        nl, nr = left.sum(axis=3), right.sum(axis=3)
        with np.errstate(divide="ignore", invalid="ignore"):
            pure = (left * left).sum(axis=3) / nl + (right * right).sum(axis=3) / nr
        pure[(nl < least) | (nr < least)] = -np.inf
        pure = pure.reshape(len(open_), -1)
        top = pure.argmax(axis=1)
        good = pure[np.arange(len(open_)), top] > (totals[open_] ** 2).sum(axis=1) / size[open_] + 1e-9
        feature[open_[good]] = chosen[good, top[good] // BINS]
        split[open_] = top % BINS
        child = 2 * (np.cumsum(feature >= 0) - 1)
        levels.append((feature, split, share, child))
        moves = feature[at] >= 0
        at, active = at[moves], active[moves]
        at = child[at] + (codes[active, feature[at]] > split[at])
        count = 2 * int((feature >= 0).sum())
        if not count:
            break
    return levels


def forest_scores(train, test, classes: int, trees: list[int], depths: list[int], least: int, seed: int) -> dict[tuple[int, int], float]:
    """Accuracy for each (number of trees, depth), all from one forest of the most and deepest trees."""
    (codes, y), (held, truth) = train, test
    votes, found = {d: np.zeros((len(held), classes)) for d in depths}, {}
    for n in range(1, max(trees) + 1):
        draw = np.random.default_rng((seed, n))  # one stream per tree: a tree's upper levels do not depend on its depth
        weight = draw.poisson(1.0, len(y)).astype(float)
        levels = forest_tree(codes, y, weight, classes, max(depths), least, draw)
        for level, value in enumerate(walk(levels, held)):
            if level in votes:
                votes[level] += value
            last = value
        for d in depths:
            if d >= len(levels):
                votes[d] += last
        if n in trees:
            found.update({(n, d): float((v.argmax(axis=1) == truth).mean()) for d, v in votes.items()})
    return found


def network_score(train, test, classes: int, hidden: tuple[int, ...], rate: float, seed: int, epochs: int = 1000, batch: int = 200) -> float:
    """A network of rectified layers by stochastic steps with moment estimates; it stops when ten epochs bring no gain."""
    (x, y), (held, truth) = train, test
    centre, spread = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    x, held = ((a - centre) / spread for a in (x, held))
    x, held = x.astype(np.float32), held.astype(np.float32)
    draw, sizes = np.random.default_rng(seed), [x.shape[1], *hidden, classes]
    weights = [draw.normal(0, np.sqrt(2 / a), (a, b)).astype(np.float32) for a, b in zip(sizes, sizes[1:])]
    params = [*weights, *(np.zeros(b, np.float32) for b in sizes[1:])]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    layers, target = len(weights), np.eye(classes, dtype=np.float32)[y]
    best, waited, step = np.inf, 0, 0

    def forward(a: np.ndarray) -> list[np.ndarray]:
        out = [a]
        for k in range(layers):
            a = a @ params[k] + params[layers + k]
            out.append(np.maximum(a, 0) if k < layers - 1 else a)
        return out

    for _ in range(epochs):
        order, loss = draw.permutation(len(x)), 0.0
        for i in range(0, len(x), batch):
            part = order[i : i + batch]
            out = forward(x[part])
            p = np.exp(out[-1] - out[-1].max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            loss -= float(np.log(np.maximum((p * target[part]).sum(axis=1), 1e-12)).sum())
            back, grads = (p - target[part]) / len(part), [None] * len(params)
            for k in range(layers - 1, -1, -1):
                grads[k], grads[layers + k] = out[k].T @ back, back.sum(axis=0)
                if k:
                    back = (back @ params[k].T) * (out[k] > 0)
            step += 1
            for p_, m, v, g in zip(params, first, second, grads):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        waited = 0 if loss / len(x) < best - 1e-4 else waited + 1
        best = min(best, loss / len(x))
        if waited >= 10:
            break
    return float((forward(held)[-1].argmax(axis=1) == truth).mean())


def _named(**setting) -> str:
    return ", ".join(f"{k}={v}" for k, v in sorted(setting.items()))


def jobs_of(grids: dict[str, dict], folds: int) -> list[tuple[str, dict, int]]:
    """(family, settings of one shared fit, fold). ``maxIter``, ``numTrees`` and a forest's ``maxDepth`` stay lists."""
    shared = {"boosting": ("maxIter",), "random_forest": ("numTrees", "maxDepth"), "neural_network": ()}
    jobs = []
    for kind, grid in grids.items():
        free = [k for k in grid if k not in shared[kind]]
        for values in product(*(grid[k] for k in free)):
            setting = {**dict(zip(free, values)), **{k: list(grid[k]) for k in shared[kind]}}
            jobs += [(kind, setting, fold) for fold in range(folds)]
    return jobs


def run_job(kind: str, setting: dict, fold: int, x: np.ndarray, codes: np.ndarray, y: np.ndarray, folds: np.ndarray, classes: int):
    """(setting, accuracy) of every setting that a job's fit answers."""
    inside = folds != fold
    rows = x if kind == "neural_network" else codes
    train, test = (rows[inside], y[inside]), (rows[~inside], y[~inside])
    if not len(train[1]) or not len(test[1]):
        return []
    if kind == "boosting":
        rate, depth = setting["stepSize"], setting["maxDepth"]
        found = boosting_scores(train, test, classes, setting["maxIter"], rate, depth)
        return [(_named(maxIter=n, stepSize=rate, maxDepth=depth), a) for n, a in found.items()]
    if kind == "random_forest":
        least = setting["minInstancesPerNode"]
        found = forest_scores(train, test, classes, setting["numTrees"], setting["maxDepth"], least, seed=42 + fold)
        return [(_named(numTrees=n, maxDepth=d, minInstancesPerNode=least), a) for (n, d), a in found.items()]
    hidden, rate = tuple(setting["hidden"]), setting["stepSize"]
    return [(_named(hidden=hidden, stepSize=rate), network_score(train, test, classes, hidden, rate, seed=42 + fold))]


def grid_search(df: DataFrame, grids: dict[str, dict], features: list[str], label: str, classes: int, folds: int = 5, fold: str = "fold") -> DataFrame:
    """Mean accuracy and deviation over the folds of every setting of every family, best first.

    ``df`` holds the bounded labelled rows with their fold. Every setting of the grids is tried on every fold; none is dropped early.
    Features that are missing count as 0; rows without a label or fold are left out. Folds without rows give no accuracy.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(label).isNotNull() & F.col(fold).isNotNull())
    rows = rows.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], F.col(label).cast("int"), F.col(fold).cast("int"))
    data = np.array(sorted(map(tuple, rows.collect())), float).reshape(-1, len(features) + 2)  # the same order on every run
    x, y, part = data[:, :-2], data[:, -2].astype(np.int64), data[:, -1].astype(np.int64)
    sent = spark.sparkContext.broadcast((x, binned(x) if len(x) else x.astype(np.int64), y, part))
    jobs = jobs_of(grids, folds)
    # Long jobs first, one task each, so that the last ones to finish are short.
    jobs.sort(key=lambda j: (j[0] != "random_forest", -sum(j[1].get("hidden", ())), -j[1].get("maxDepth", 0) if j[0] == "boosting" else 0))
    table = spark.createDataFrame([(i,) for i in range(len(jobs))], "job int").repartitionByRange(max(1, len(jobs)), "job")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["job"]:
                kind, setting, fold_ = jobs[i]
                found = run_job(kind, setting, fold_, *sent.value, classes)
                yield pd.DataFrame([(kind, s, fold_, a) for s, a in found], columns=["kind", "setting", "fold", "accuracy"])

    scores = table.mapInPandas(run, SCORES)
    out = scores.groupBy("kind", "setting").agg(F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("deviation"))
    return out.orderBy(F.desc("accuracy"), "kind", "setting")

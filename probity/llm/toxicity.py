"""Toxicity by class-conditional Kneser-Ney models.

Both classes have an n-gram model over the letters of words. The class counts of the longest contexts are discounted
and interpolated with one shared model, whose lower orders count continuations over both classes, and counts as
``SHARED`` further occurrences, so an expression that a class has hardly seen keeps near the shared estimate. The score
compares the log-likelihoods of a text under both, normalised by its length, through a fitted logistic curve; a second
term does the same for the part of each word's ratio above ``SURE``, which the drift of whole languages does not reach.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.common import fold_of, ready, slim, stored
from probity.operators.ordered import smallest

ORDER = 6
DISCOUNT = 0.75
SHARED = 20.0
SURE = 2.0
PARTS, HELD_OUT, CALIBRATION = 4, 2, 3
THRESHOLD = 0.3
FIT_ROWS = 20_000  # documented bound of the labelled rows that the logistic curve is fitted on
SENT_LABELS = 1_000_000
SENT_ENTRIES = 1_000_000  # largest ratio table that is sent to the workers; a larger one is joined
KEPT_WORDS = 300_000

WORDS = re.compile(r"[^\W\d_]+")
SCORED = "doc_id long, held_out boolean, n_words long, total double, excess double"


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of labelled texts with their counts per class, in portions of bounded size."""
    counts: dict[str, list[int]] = {}

    def told() -> pa.RecordBatch:
        cols = [pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))]
        return pa.RecordBatch.from_arrays(cols, names=["word", "ordinary", "toxic"])

    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
            for w in words_of(text):
                c = counts.get(w)
                if c is None:
                    c = counts[w] = [0, 0]
                c[label] += 1
        if len(counts) > KEPT_WORDS:
            yield told()
            counts.clear()
    if counts:
        yield told()


def word_counts(labelled: DataFrame) -> DataFrame:
    """Words of all labelled texts with their number in each class."""
    rows = labelled.mapInArrow(_counts, "word string, ordinary long, toxic long")
    return rows.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _whole_grams(words: DataFrame) -> DataFrame:
    """Longest n-grams at every place of every word (with its edges as spaces) and their class counts."""
    w = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    gram = lambda i: F.substring(w, F.greatest(F.lit(1), i - ORDER + 1), F.least(i, F.lit(ORDER)))
    each = words.select(F.explode(F.transform(F.sequence(F.lit(2), F.length(w)), gram)).alias("gram"), "ordinary", "toxic")
    return each.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _context() -> Column:
    return F.substring("gram", F.lit(1), F.length("gram") - 1)


def _suffix() -> Column:
    return F.substring("gram", F.lit(2), F.length("gram") - 1)


def shared_model(whole: DataFrame) -> DataFrame:
    """``gram, p`` for the longest n-grams: interpolated Kneser-Ney over both classes.

    An n-gram that begins at a word's edge, or has the full length, counts its occurrences; any other counts the different letters
    before it. Orders are built from the longest down and estimated from the shortest up, one join each.
    """
    orders: dict[int, DataFrame] = {}
    for k in range(ORDER, 0, -1):
        own = whole.filter(F.length("gram") == k).select("gram", (F.col("ordinary") + F.col("toxic")).alias("n"))
        if k < ORDER:
            own = own.union(orders[k + 1].select(_suffix().alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
        orders[k] = stored(own.groupBy("gram").agg(F.sum("n").alias("n")))
    total = orders[1].agg(F.sum("n")).first()[0] or 1
    symbols = orders[1].count() or 1
    p = orders[1].select("gram", ((F.col("n") + DISCOUNT) / (total + DISCOUNT * symbols)).alias("p"))
    out = []
    for k in range(2, ORDER + 1):
        sums = orders[k].groupBy(_context().alias("c")).agg(F.sum("n").alias("of"), F.count(F.lit(1)).alias("kinds"))
        lower = p.select(F.col("gram").alias("s"), F.col("p").alias("q"))
        rows = orders[k].join(sums, _context() == F.col("c")).join(lower, _suffix() == F.col("s"))
        own = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("q")
        p = stored(rows.select("gram", (own / F.col("of")).alias("p")))
        out.append(p)
    both = out[0]
    for one in out[1:]:
        both = both.union(one)
    return both.join(whole.select("gram"), "gram", "left_semi")


def ratios(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log-likelihood ratios (toxic over ordinary): ``gram, ratio`` and, for unseen continuations, ``context, ratio``."""
    whole = stored(_whole_grams(words))
    classes = ("ordinary", "toxic")
    sums = whole.groupBy(_context().alias("context")).agg(
        *[F.sum(c).alias(f"{c}_n") for c in classes], *[F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in classes]
    )
    sums = stored(sums)
    left = {c: (DISCOUNT * F.col(f"{c}_kinds") + SHARED) / (F.col(f"{c}_n") + SHARED) for c in classes}
    contexts = sums.select("context", (F.log(left["toxic"]) - F.log(left["ordinary"])).alias("ratio"))
    rows = whole.join(shared_model(whole), "gram").join(sums, _context() == F.col("context"))
    kept = {c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / (F.col(f"{c}_n") + SHARED) for c in classes}
    p = {c: kept[c] + left[c] * F.col("p") for c in classes}
    return rows.select("gram", (F.log(p["toxic"]) - F.log(p["ordinary"])).alias("ratio")), contexts


@dataclass
class Model:
    """The stored table of ratios, the same on the workers if it is small enough, and the logistic curve."""

    entries: DataFrame
    sent: Broadcast | None
    curve: np.ndarray


def _entries(words: DataFrame) -> DataFrame:
    """``key, value``: the ratio of each context, and of each n-gram what it differs from its context's."""
    grams, contexts = ratios(words)
    near = contexts.withColumnRenamed("ratio", "base")
    own = grams.join(near, _context() == F.col("context")).select(F.concat(F.lit("g"), "gram").alias("key"), (F.col("ratio") - F.col("base")).alias("value"))
    return stored(own.union(contexts.select(F.concat(F.lit("c"), "context"), F.col("ratio"))))


def _sent(entries: DataFrame) -> Broadcast | None:
    if entries.count() > SENT_ENTRIES:
        return None
    keys, values = (c.to_pylist() for c in entries.toArrow().columns)
    return entries.sparkSession.sparkContext.broadcast(places_of(dict(zip(keys, values))))


def places_of(entries: dict[str, float]) -> dict[str, float]:
    """The value of a place by its n-gram (with that of its context), and by its context alone where the n-gram was not seen."""
    return {k: v + entries.get("c" + k[1:-1], 0.0) if k[0] == "g" else v for k, v in entries.items()}


def _keys(word: str) -> Iterator[str]:
    w = f" {word} "
    for end in range(2, len(w) + 1):
        start = max(0, end - ORDER)
        yield "g" + w[start:end]
        yield "c" + w[start : end - 1]


class WordScores(dict):
    """Ratios of words: the sum over their places. Kept up to a bound."""

    def __init__(self, places: dict[str, float]):
        super().__init__()
        self.places = places

    def __missing__(self, word: str) -> float:
        if len(self) >= KEPT_WORDS:
            self.clear()
        w, get, value = f" {word} ", self.places.get, 0.0
        for end in range(2, len(w) + 1):
            start = end - ORDER if end > ORDER else 0
            found = get("g" + w[start:end])
            value += get("c" + w[start : end - 1], 0.0) if found is None else found
        self[word] = value
        return value


_SCORES: dict[int, WordScores] = {}


def _summed(batches: Iterable[pa.RecordBatch], sent: Broadcast, number: int) -> Iterator[pa.RecordBatch]:
    if number not in _SCORES:
        _SCORES.clear()  # one model per worker
        _SCORES[number] = WordScores(sent.value)
    scores = _SCORES[number]
    for batch in batches:
        counts, totals, above = [], [], []
        for text in batch["text"].to_pylist():
            each = list(map(scores.__getitem__, words_of(text)))
            counts.append(len(each))
            totals.append(math.fsum(each))
            above.append(math.fsum(x - SURE for x in each if x > SURE) if max(each, default=SURE) > SURE else 0.0)
        cols = [batch["doc_id"], batch["held_out"], pa.array(counts, pa.int64()), pa.array(totals, pa.float64()), pa.array(above, pa.float64())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_words", "total", "excess"])


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist()):
            counts = Counter(words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(counts), pa.int64()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["row", "word", "n"])


def _placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(w, k) for w in batch["word"].to_pylist() for k in _keys(w)]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["word", "key"])


def _joined(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """The same sums for a table of any size: every distinct word is scored once by joins, then joined to the texts that have it."""
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    listed = stored(rows.select("row", "text").mapInArrow(_listed, "row long, word string, n long"))
    keys = listed.select("word").distinct().mapInArrow(_placed, "word string, key string")
    words = keys.join(entries, "key").groupBy("word").agg(F.sum("value").alias("value"))
    value = F.coalesce("value", F.lit(0.0))
    sums = listed.join(words, "word", "left").groupBy("row").agg(
        F.sum("n").alias("n_words"), F.sum(F.col("n") * value).alias("total"), F.sum(F.col("n") * F.greatest(value - SURE, F.lit(0.0))).alias("excess")
    )
    none = lambda c, t: F.coalesce(c, F.lit(0)).cast(t).alias(c)
    return rows.join(sums, "row", "left").select("doc_id", "held_out", none("n_words", "long"), none("total", "double"), none("excess", "double"))


def _totals(rows: DataFrame, entries: DataFrame, sent: Broadcast | None) -> DataFrame:
    """Words of every text, the log-likelihood ratio, and the part of its words' ratios above ``SURE``."""
    rows = rows.select("doc_id", "held_out", "text")
    if sent is None:
        return _joined(rows, entries)
    number = sent._jbroadcast.id()
    return rows.mapInArrow(lambda b: _summed(b, sent, number), SCORED)


# Terms of the curve: (column, per word?, factor, bounds).
TERMS = (("total", True, 10.0, 20.0), ("excess", True, 100.0, 50.0), ("excess", False, 1.0, 20.0))


def features(sums) -> np.ndarray:
    n = np.maximum(sums["n_words"].to_numpy(float), 1)
    cols = [np.clip(f * sums[c].to_numpy(float) / (n if per else 1), -most, most) for c, per, f, most in TERMS]
    return np.column_stack([np.ones(len(n)), *cols])


def curve_column(curve: np.ndarray) -> Column:
    n, z = F.greatest(F.col("n_words"), F.lit(1)), F.lit(float(curve[0]))
    for w, (c, per, f, most) in zip(curve[1:], TERMS):
        x = f * F.col(c) / (n if per else 1)
        z = z + float(w) * F.greatest(F.lit(-most), F.least(F.lit(most), x))
    return 1 / (1 + F.exp(-z))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_column="doc_id", text_column="text", label_column="toxic", label_id="doc_id") -> Model:
    """The curve from one fold of the labelled rows under the counts of two others, then counts from all three.

    The held-out fold is never read.

    Rows without text, id or label teach nothing; an id with both labels counts as toxic. With no label of a class the score is 0 or the share of the class.
    """
    ready(docs.sparkSession)
    marks = slim(labels, _id=labels[label_id].cast("long"), label=labels[label_column].cast("int")).filter(F.col("label").isin(0, 1))
    marks = marks.groupBy("_id").agg(F.max("label").alias("label"))
    marks = marks.withColumn("fold", fold_of("_id", PARTS)).filter(F.col("fold") != HELD_OUT)
    rows = slim(docs, doc_id=docs[id_column].cast("long"), text=text_column).filter(F.col("text").isNotNull())
    # Labels are a row of two numbers each: up to a million are sent to the texts, so that those need not move; more are joined.
    marks = stored(marks)
    marks = F.broadcast(marks) if marks.count() <= SENT_LABELS else marks
    rows = stored(rows.join(marks, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label", "fold"))
    counted = [stored(word_counts(rows.filter(part).select("text", "label"))) for part in (F.col("fold") != CALIBRATION, F.col("fold") == CALIBRATION)]
    entries = _entries(counted[0])
    sent = _sent(entries)
    # All rows of the third fold are summed where they are; the bounded choice is among rows of numbers.
    fit = rows.filter(F.col("fold") == CALIBRATION).select("doc_id", (F.col("label") == 1).alias("held_out"), "text")
    sums = stored(_totals(fit, entries, sent))
    found = smallest(sums, F.xxhash64("doc_id"), FIT_ROWS, *sums.columns).toPandas()
    curve = fit_curve(features(found), found["held_out"].to_numpy(float)) if len(found) else np.array([-5.0, 0.0, 0.0, 0.0])
    if sent is not None:
        sent.unpersist()
    words = counted[0].union(counted[1]).groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    entries = _entries(stored(words))
    return Model(entries, _sent(entries), curve)


def score(docs: DataFrame, model: Model, id_column="doc_id", text_column="text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    Null and empty texts, and texts without words, get the score of a ratio of 0. Repeated rows are scored each; a null id
    counts with the empty text's checksum; an empty table gives an empty result. Labels, language and source are not read.
    """
    ready(docs.sparkSession)
    rows = slim(docs, doc_id=docs[id_column].cast("long"), held_out=fold_of(docs[id_column], PARTS) == HELD_OUT, text=text_column)
    out = _totals(rows, model.entries, model.sent).select("doc_id", "held_out", curve_column(model.curve).alias("score"), "n_words")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

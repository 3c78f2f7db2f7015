"""Signals around the text: bursts, coordinated groups, surface rules, metadata hints, similarity."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.constants import CATEGORY_TERMS
from probity.functions import text as X
from probity.operators.profiles import enrich
from probity.operators.shared import PIECE, added, text_id, with_uses
from probity.session import cut_lineage


def burst_scores(df: DataFrame, key: str = "place_id", ts: str = "published_at") -> DataFrame:
    """Per business and day: reviews within one day on either side over its mean daily count.

    Rows are counted per day first, so a window holds one row per day, however many reviews there are.
    """
    days = df.groupBy(key, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = days.withColumn("_d", F.unix_date("day"))
    near = Window.partitionBy(key).orderBy("_d").rangeBetween(-1, 1)
    whole = Window.partitionBy(key)
    return days.select(
        key, "day", "n", (F.sum("n").over(near) / F.avg("n").over(whole)).alias("burst")
    )


def with_burst(df: DataFrame, key: str = "place_id", ts: str = "published_at") -> DataFrame:
    return df.withColumn("day", F.to_date(ts)).join(burst_scores(df, key, ts).drop("n"), [key, "day"], "left")


def coordination_scores(df: DataFrame, min_others: int = 1) -> DataFrame:
    """Per reviewer: share of its (business, stars, day) cells that others hit as well.

    Counts per cell stand in for comparing reviewers with each other, so no pairs are formed.
    """
    seen = (
        df.filter("stars IS NOT NULL")
        .select("reviewer_id", "place_id", "stars", F.to_date("published_at").alias("day"))
        .groupBy("reviewer_id", "place_id", "stars", "day")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    seen = cut_lineage(seen)
    crowd = seen.groupBy("place_id", "stars", "day").agg(F.count(F.lit(1)).alias("reviewers"))
    shared = seen.join(crowd, ["place_id", "stars", "day"])
    return shared.groupBy("reviewer_id").agg(
        F.avg((F.col("reviewers") > min_others).cast("double")).alias("coordination"),
        F.count(F.lit(1)).alias("cells"),
    )


def surface_rules(text: Column) -> dict[str, Column]:
    return {
        "upper_share": X.upper_share(text),
        "exclamations": X.exclamations(text),
        "repeated_word_share": X.repeated_word_share(text),
        "praise_hits": X.praise_hits(text),
    }


def measured_surface() -> dict[str, Column]:
    """:func:`surface_rules` of rows that bring the measures of their text along; a missing text counts as empty."""
    n, n_words, distinct = (F.coalesce(X.measure(m), F.lit(0)) for m in ("length", "words", "distinct"))
    return {
        "upper_share": X.upper_share(F.lit(""), X.measure("upper"), n),
        "exclamations": F.coalesce(X.measure("exclamations"), F.lit(0)),
        "repeated_word_share": F.when(n_words > 0, 1 - distinct / n_words).otherwise(F.lit(0.0)),
        "praise_hits": X.bit_hits(X.measure("topic_bits"), X.PRAISE_PHRASES, X.TOPIC_TERMS),
    }


GENERIC_NAME = r"^[A-Za-z]+_?[0-9]+$"


def metadata_hints(df: DataFrame, same_day_limit: int = 5) -> DataFrame:
    """Helpful ratio, unverified, unknown place, same-day crowd, generic name, rating against text."""
    days = df.groupBy("place_id", F.to_date("published_at").alias("day")).agg(F.count(F.lit(1)).alias("same_day"))
    out = df.withColumn("day", F.to_date("published_at")).join(days, ["place_id", "day"], "left")
    cls, stars = F.col("text_prediction"), F.col("stars")
    mismatch = ((cls == "genuine_negative") & (stars >= 4)) | ((cls == "genuine_positive") & (stars <= 2))
    return out.withColumns(
        {
            "helpful_ratio": F.try_divide(F.col("helpful_votes").cast("double"), F.col("total_votes").cast("double")),
            "unverified": (~F.col("verified_purchase")).cast("int"),
            "unknown_location": (F.coalesce("location", F.lit("Unknown")) == "Unknown").cast("int"),
            "crowded_day": (F.col("same_day") > same_day_limit).cast("int"),
            "generic_name": F.col("reviewer_name").rlike(GENERIC_NAME).cast("int"),
            "rating_mismatch": F.coalesce(mismatch, F.lit(False)).cast("int"),
        }
    )


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """1 for equal names, 0 for names with nothing in common."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(F.lower(a), F.lower(b)) / longest).otherwise(1.0)


def category_cosine(df: DataFrame, text: str = "text", category: str = "category", width: int = 1 << 16) -> DataFrame:
    """TF-IDF cosine of the text with the vocabulary of its category.

    Only the slots of the vocabulary terms are cut from the normalised vectors; the dot product is a
    short expression, and no wide vector leaves its row.
    """
    ready = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    tf = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=width)
    terms = sorted({t for v in CATEGORY_TERMS.values() for t in v})
    slots = sorted({tf.indexOf(t) for t in terms})
    stages = [
        RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"\W+"),
        tf,
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_norm"),
        VectorSlicer(inputCol="_norm", outputCol="_slice", indices=slots),
    ]
    model = Pipeline(stages=stages).fit(ready)
    weights = model.stages[2].idf
    out = model.transform(ready).withColumn("_p", vector_to_array("_slice"))
    chain = None
    for cat, words in CATEGORY_TERMS.items():
        w = {tf.indexOf(t): float(weights[tf.indexOf(t)]) for t in words}
        norm = sum(v * v for v in w.values()) ** 0.5
        dot = F.lit(0.0)
        for slot, v in sorted(w.items()):
            dot = dot + F.get("_p", slots.index(slot)) * (v / norm if norm else 0.0)
        cond = F.col(category) == cat
        chain = F.when(cond, dot) if chain is None else chain.when(cond, dot)
    out = out.withColumn("category_cosine", chain.otherwise(0.0))
    return out.drop("_t", "_w", "_tf", "_idf", "_norm", "_slice", "_p")


WIDTH = 1 << 16
SPREAD = 4096  # slots that travel in one row


class _Counts:
    """Arrow rows of texts as arrays: slots and counts (``owner`` is the text) and uses (``user``), and the counts in some slots by text."""

    def __init__(self, batch: pa.RecordBatch, slots: np.ndarray):
        tf = batch["tf"]  # a sparse vector
        self.n, lists = batch.num_rows, [tf.field("indices"), batch["uses"]]
        self.owner, self.user = (np.repeat(np.arange(self.n), x.value_lengths().to_numpy(zero_copy_only=False)) for x in lists)
        self.slots, self.tf = lists[0].flatten().to_numpy(zero_copy_only=False), tf.field("values").flatten().to_numpy(zero_copy_only=False)
        uses = lists[1].flatten()
        self.place, self.tail, self.units = (uses.field(c).to_numpy(zero_copy_only=False) for c in ("place", "tail", "units"))
        column = np.full(WIDTH, -1)
        column[slots] = np.arange(len(slots))
        there = np.flatnonzero(column[self.slots] >= 0)
        self.among = np.zeros((self.n, len(slots)))
        self.among[self.owner[there], column[self.slots[there]]] = self.tf[there]


def _rows_with_slot(batches: Iterator[pa.RecordBatch], slots: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How many rows have each slot; an ending adds those of its slots that the text has not."""
    found = np.zeros(WIDTH, np.int64)
    for batch in batches:
        for i in range(0, batch.num_rows, PIECE):
            c = _Counts(batch.slice(i, PIECE), slots)
            rows = np.bincount(c.user, c.units, c.n)
            found += np.bincount(c.slots, rows[c.owner], WIDTH).astype(np.int64)
            found[slots] += (((ends[c.tail] > 0) & (c.among == 0)[c.user]) * c.units[:, None]).sum(axis=0)
    for i in range(0, WIDTH, SPREAD):
        yield pa.RecordBatch.from_pydict({"chunk": [i // SPREAD], "sums": [found[i : i + SPREAD].tobytes()]})


def _cosine_sums(batches: Iterator[pa.RecordBatch], slots: np.ndarray, ends: np.ndarray, idf: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Number, sum and largest of the cosines of every category; ``words`` has its normalised vocabulary as a column."""
    number, total, most = np.zeros(words.shape[1], np.int64), np.zeros(words.shape[1]), np.zeros(words.shape[1])
    square = idf[slots] ** 2
    for batch in batches:
        for i in range(0, batch.num_rows, PIECE):
            c = _Counts(batch.slice(i, PIECE), slots)
            size = np.bincount(c.owner, (c.tf * idf[c.slots]) ** 2, c.n)[c.user]
            own, end = c.among[c.user], ends[c.tail]
            size = np.sqrt(size + ((2 * own * end + end * end) * square).sum(axis=1))
            dot = ((own + end) * idf[slots] * words[:, c.place].T).sum(axis=1)
            cosine = np.where(size > 0, dot / np.where(size > 0, size, 1.0), 0.0)
            number += np.bincount(c.place, c.units, len(number)).astype(np.int64)
            total += np.bincount(c.place, c.units * cosine, len(number))
            np.maximum.at(most, c.place, cosine)
    some = np.flatnonzero(number)
    yield pa.RecordBatch.from_pydict({"place": some.astype(np.int32), "n": number[some], "total": total[some], "most": most[some]})


def category_cosine_summary(rows: DataFrame, texts: DataFrame, endings: list[str] = ()) -> DataFrame:
    """``category, n, mean_cosine, max_cosine`` of :func:`category_cosine` for rows that share texts; each text is split once.

    ``rows`` has ``category``, ``_text`` (null: no text) and ``_tail`` (0, or the number of the ending from 1), ``texts`` has ``_text`` and ``text``,
    where a name may repeat with the same text. An ending begins with white space. A row counts however often it comes.
    """
    endings = list(endings)
    if any(not e[0].isspace() for e in endings):
        raise ValueError("an ending begins with white space")
    spark, hashing = rows.sparkSession, HashingTF(inputCol="_w", outputCol="tf", numFeatures=WIDTH)
    split = [[w for w in re.split(r"\W+", e.lower(), flags=re.ASCII) if w] for e in ["", *endings]]
    categories = list(CATEGORY_TERMS)
    slot = {w: hashing.indexOf(w) for w in {w for e in [*split, *CATEGORY_TERMS.values()] for w in e}}
    slots = np.array(sorted(set(slot.values())), np.int64)
    column = {w: int(np.searchsorted(slots, s)) for w, s in slot.items()}
    ends = np.zeros((len(split), len(slots)))
    for j, e in enumerate(split):
        for w in e:
            ends[j, column[w]] += 1

    empty = text_id(F.lit(""))
    place = F.lit(len(categories))
    for i, c in enumerate(categories):
        place = F.when(F.col("category") == c, i).otherwise(place)
    named = F.coalesce("_text", empty)
    units = rows.select(named.alias("_text"), F.when(F.col("_text").isNull(), 0).otherwise(F.col("_tail")).alias("_tail"), place.alias("place"), F.lit(1).cast("long").alias("times"))
    texts = texts.filter("_text IS NOT NULL").select("_text", "text").union(spark.range(1).select(empty, F.lit("")))
    used = with_uses(texts, units)
    tokens = RegexTokenizer(inputCol="whole", outputCol="_w", pattern=r"\W+")
    vectors = cut_lineage(hashing.transform(tokens.transform(used)).select("uses", "tf"))

    n = rows.count()
    counts = np.zeros(WIDTH, np.int64)
    found = vectors.mapInArrow(lambda b: _rows_with_slot(b, slots, ends), "chunk long, sums binary")
    for r in found.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(added, "chunk long, sums binary").toLocalIterator():
        counts[r["chunk"] * SPREAD : (r["chunk"] + 1) * SPREAD] = np.frombuffer(r["sums"], np.int64)
    idf = np.log((n + 1.0) / (counts + 1.0))
    words = np.zeros((len(slots), len(categories) + 1))
    for i, c in enumerate(categories):
        own = sorted({column[w] for w in CATEGORY_TERMS[c]})
        size = float((idf[slots[own]] ** 2).sum() ** 0.5)
        words[own, i] = idf[slots[own]] / size if size else 0.0
    sums = vectors.mapInArrow(lambda b: _cosine_sums(b, slots, ends, idf, words), "place int, n long, total double, most double")
    sums = sums.filter(F.col("place") < len(categories)).groupBy("place").agg(
        F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean_cosine"), F.max("most").alias("max_cosine")
    )
    named = F.get(F.array(*[F.lit(c) for c in categories]), F.col("place"))
    others = rows.filter(F.col("category").isNull() | ~F.col("category").isin(categories)).groupBy("category")
    others = others.agg(F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("mean_cosine"), F.lit(0.0).alias("max_cosine"))
    return sums.select(named.alias("category"), "n", "mean_cosine", "max_cosine").union(others)


def fusion_vector(df: DataFrame) -> DataFrame:
    """The 8 inputs of the calibrated fusion: three probabilities, two products, entropy, burst, coordination."""
    from probity.functions.vectors import entropy

    out = enrich(with_burst(df), coordination_scores(df), "reviewer_id")
    return out.withColumns(
        {
            "text_x_relevancy": F.col("p_bad") * F.col("relevancy"),
            "text_x_metadata": F.col("p_bad") * F.col("enhanced_prob"),
            "entropy": entropy(F.col("probs")),
        }
    )

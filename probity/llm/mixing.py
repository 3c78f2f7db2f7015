"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same fractional number of copies. Two documents with a fraction meet;
words move from one to the other, in a direction drawn so that expectations stay, until one of the two
has a whole number of copies. The other one meets the next document. Words are kept exactly, so a source
ends within half a document of its target. Each leaf of the reduction tree leaves at most one fractional
document per source, and these residuals are combined level by level.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.common import SPACES, range_numbers, ready, shuffle_partitions, slim, stored

WEIGHTS = (5, 2, 1)
EPOCHS = 1.5
MOST_COPIES = 2
LEAF_ROWS = 50_000
FAN_IN = 16
SMALL_SOURCES = 20_000
EPS = 1e-12

ROUND_SCHEMA = "doc_id long, src string, src_null boolean, size long, key long, row_key long, copies long, part double, bucket long"
FIELDS = ["doc_id", "src", "src_null", "size", "key", "row_key", "copies", "part", "bucket"]


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns of a row, nulls told apart; with ``key`` it names a row, and rows that share both are alike."""
    types = dict(docs.dtypes)
    values = [F.to_json(docs[c]) if "map<" in types[c] else docs[c] for c in docs.columns]
    return F.xxhash64(F.lit(1), *[x for v in values for x in (v.isNull(), v)])


def sizes(docs: DataFrame, id_column="doc_id", text_column="text", source_column="source") -> DataFrame:
    """Id, source, words of the whole text and hashes of text and row; nothing of the text itself moves on."""
    text = F.coalesce(docs[text_column], F.lit(""))
    return slim(
        docs,
        doc_id=docs[id_column].cast("long"),
        src=F.coalesce(docs[source_column].cast("string"), F.lit("")),
        src_null=docs[source_column].isNull(),
        size=F.regexp_count(text, F.lit(f"[^{SPACES}]++")).cast("long"),
        key=F.xxhash64(docs[id_column], text),
        row_key=row_key(docs),
    )


def targets(sized: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, most: float = MOST_COPIES) -> DataFrame:
    """One row per source with ``source_size`` and ``target``.

    Sources in code point order, null last, take the weights in turn. A source gets its share by weight, but at most
    ``most`` times its size; the common level of the others rises until the shares add up again. Only four sums
    per step reach the driver.
    """
    sources = sized.groupBy("src_null", "src").agg(F.sum("size").alias("source_size"))
    ranked = stored(range_numbers(sources, [F.col("src_null").asc(), F.col("src").asc()]))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * float(most)
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * epochs
    level, full_before = 0.0, -1
    while True:
        full = cap <= F.col("weight") * level
        row = ranked.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count_if(full).alias("full"),
        ).first()
        if row.full == full_before or not row.open:
            break
        level, full_before = (total - row.capped) / row.open, row.full
    share = F.when(cap <= F.col("weight") * level, cap).otherwise(F.col("weight") * level)
    return ranked.select("src_null", "src", "source_size", F.least(cap, share).alias("target"))


def _uniform(a: int, b: int) -> float:
    """A number in [0, 1) that depends on the two keys only, so that reruns agree."""
    m = (1 << 64) - 1
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + 1) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return ((x ^ (x >> 31)) >> 11) / float(1 << 53)


def meet(a: list, b: list) -> tuple[list, list]:
    """Moves words between two fractional documents; returns the settled one and the one that goes on.

    A document is ``[size, key, copies, part, ...]`` with ``0 < part < 1``. If both end whole, the second has part 0 or 1.
    """
    up = min((1 - a[3]) * a[0], b[3] * b[0])
    down = min(a[3] * a[0], (1 - b[3]) * b[0])
    words = up if _uniform(a[1], b[1]) * (up + down) < down else -down
    a[3] += words / a[0]
    b[3] -= words / b[0]
    for x in (a, b):
        x[3] = 0.0 if x[3] < EPS else 1.0 if x[3] > 1 - EPS else x[3]
    return (a, b) if a[3] in (0.0, 1.0) else (b, a)


def _rounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by source and bucket: one open document at a time, whatever the size of the group."""
    group, open_doc, out = None, None, []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[] for _ in FIELDS]
        types = [pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=FIELDS)

    def settle(d: list) -> None:
        size, key, copies, part, doc, src, null, row, bucket = d
        out.append((doc, src, null, size, key, row, copies, part, bucket))

    for batch in batches:
        c = batch.to_pydict()
        for doc, src, null, size, key, row, copies, part, bucket in zip(*(c[f] for f in FIELDS)):
            if (null, src, bucket) != group:
                if open_doc:
                    settle(open_doc)
                group, open_doc = (null, src, bucket), None
            d = [size, key, copies, part, doc, src, null, row, bucket]
            if open_doc is None:
                open_doc = d
            else:
                done, open_doc = meet(open_doc, d)
                settle(done)
            if open_doc[3] in (0.0, 1.0):
                settle(open_doc)
                open_doc = None
        yield flush()
        out = []
    if open_doc:
        settle(open_doc)
        yield flush()


def rounded(rows: DataFrame, leaf_rows: int = LEAF_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Every row with ``part`` 0 or 1: the reduction tree over (source, bucket), then the nearest whole for the last one."""
    n = shuffle_partitions(rows)
    is_open = (F.col("part") > 0) & (F.col("part") < 1) & (F.col("size") > 0)
    done = [rows.filter(~is_open)]
    rest = rows.filter(is_open)
    buckets = max(1, math.ceil(rows.count() / leaf_rows))
    rest = rest.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    while True:
        order = ["src_null", "src", "bucket"]
        level = rest.repartition(n, *order).sortWithinPartitions(*order, "key", "row_key", "doc_id", "size").select(*FIELDS)
        level = stored(level.mapInArrow(_rounded, ROUND_SCHEMA))
        done.append(level.filter(~is_open))
        rest = level.filter(is_open)
        if buckets == 1:
            break
        buckets = math.ceil(buckets / fan_in)
        rest = rest.withColumn("bucket", F.floor(F.col("bucket") / fan_in))
    done.append(rest.withColumn("part", F.when(F.col("part") >= 0.5, 1.0).otherwise(0.0)))
    out = done[0].select(*FIELDS)
    for d in done[1:]:
        out = out.unionByName(d.select(*FIELDS))
    return out


def mix(
    docs: DataFrame, id_column="doc_id", text_column="text", source_column="source", weights=WEIGHTS, epochs: float = EPOCHS,
    most: float = MOST_COPIES, leaf_rows: int = LEAF_ROWS, fan_in: int = FAN_IN,
) -> DataFrame:
    """Copies of every document so that the words of each source meet its target.

    Returns ``doc_id, key, row_key, size, source_size, target, copies, taken``; ``key`` is a hash of id and text, ``row_key`` one of
    all columns. Copies are whole, at most ``most``. A null source is a source of its own (last in order); null and empty texts have size 0 and
    take nothing; repeated rows are rows of their own; ids may be null or repeated; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    sized = stored(sizes(docs, id_column, text_column, source_column))
    goals = stored(targets(sized, weights, epochs, most))
    # A hot source must not meet in one task: few sources are sent to the rows, many are joined with skew handling.
    small = goals if goals.count() > SMALL_SOURCES else F.broadcast(goals)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.when(F.abs(rate - F.round(rate)) < EPS, F.round(rate)).otherwise(rate)
    rows = sized.join(small, ["src_null", "src"]).withColumns({"copies": F.floor(near), "part": near - F.floor(near), "bucket": F.lit(0).cast("long")})
    ended = rounded(rows.select(*FIELDS), leaf_rows, fan_in)
    copies = F.col("copies") + F.col("part").cast("long") * (F.col("size") > 0).cast("long")
    goals = goals if goals.count() > SMALL_SOURCES else F.broadcast(goals)
    return ended.join(goals, ["src_null", "src"]).select(
        "doc_id", "key", "row_key", "size", F.col("source_size").cast("long"), "target", copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, id_column="doc_id", text_column="text", source_column="source") -> DataFrame:
    """The mix itself: every row as often as its copies say, all columns kept.

    Rows that agree in every column are alike, so theirs are added up; rows that share id and text but not the rest keep their own.
    """
    counts = mix(docs, id_column, text_column, source_column).groupBy(F.col("key").alias("_key"), F.col("row_key").alias("_row_key"))
    counts = counts.agg(F.sum("copies").alias("_copies")).filter("_copies > 0")
    key = F.xxhash64(docs[id_column], F.coalesce(docs[text_column], F.lit("")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), key.alias("_key"), row_key(docs).alias("_row_key"))
    # The rows are dealt by these keys in any case, so nothing is gained by a broadcast.
    taken = rows.join(counts.hint("merge"), ["_key", "_row_key"]).dropDuplicates(["_key", "_row_key"])
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_row.*")

"""Row numbers and running sums over a whole table without a one-task window.

The order axis is cut at quantiles into buckets. A bucket is a function of the row's own values, so a
retried task puts every row where it was before. Work inside a bucket is an ordinary window; the
carry between buckets comes from one small table with a row per bucket.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity.session import cut_lineage

INF = float("inf")


def default_buckets(df: DataFrame) -> int:
    wanted = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(4, min(wanted, 5000))


def quantiles(df: DataFrame, value: Column, buckets: int) -> list[float]:
    """The inner quantile points of a numeric column, repeats kept (at most ``buckets - 1`` numbers)."""
    share = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(value.cast("double"), share, max(10_000, 20 * buckets))).first()
    return sorted(row[0] or [])


def _assign(df: DataFrame, column: str, splits: list[float], out: str) -> DataFrame:
    if not splits:
        return df.withColumn(out, F.lit(0))
    cut = Bucketizer(splits=[-INF, *splits, INF], inputCol=column, outputCol=out)
    return cut.transform(df).withColumn(out, F.col(out).cast("int"))


def tie_number(df: DataFrame, tie: str) -> Column:
    """A number that orders the tie column: itself, or a 64-bit hash when it is text."""
    if isinstance(df.schema[tie].dataType, T.StringType):
        return F.xxhash64(tie)
    return F.col(tie)


def with_buckets(
    df: DataFrame, value: Column, tie: str | None = None, buckets: int | None = None, out: str = "_bucket"
) -> DataFrame:
    """Adds an order-preserving bucket number.

    Buckets follow the quantiles of ``value``. A value that fills whole buckets by itself is split
    further along ``tie``, so one value on a third of all rows still spreads over many buckets. NULL
    sorts first.
    """
    n = buckets or default_buckets(df)
    base = df.withColumn("_v", F.coalesce(value.cast("double"), F.lit(-INF)))
    points = quantiles(base, F.col("_v"), n)
    splits = sorted({p for p in points if p > -INF})
    heavy = sorted({p for i, p in enumerate(points) if i and p == points[i - 1]})
    base = _assign(base, "_v", splits, out)
    if tie is None or not heavy:
        return base.drop("_v")
    base = base.withColumn("_t", tie_number(df, tie).cast("double"))
    hot = F.col("_v").isin(heavy)
    sub_splits = sorted(set(quantiles(base.filter(hot), F.col("_t"), n)))
    base = _assign(base, "_t", sub_splits, "_sub")
    width = len(sub_splits) + 2
    # A split point is the smallest value of its bucket: its rows come before the bucket's others.
    sub = F.when(hot, F.col("_sub")).otherwise(F.lit(width - 1))
    return base.withColumn(out, F.col(out) * width + sub).drop("_v", "_t", "_sub")


def _carry(totals: DataFrame, by: list[str], bucket: str, sums: list[str]) -> DataFrame:
    """Sums over all earlier buckets. ``totals`` has one row per bucket (and group), nothing bigger."""
    part = by or [F.lit(0)]
    before = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *by, bucket, *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_carry_{s}") for s in sums]
    )


def global_row_number(
    df: DataFrame, value: Column, tie: str, out: str = "rn", buckets: int | None = None, stored: bool = False
) -> DataFrame:
    """1-based position of every row in the order (value, tie), both ascending, NULL first.

    The rows are read three times (quantiles, bucket sizes, numbering), so they are written once before
    that, unless ``stored`` says they come from a table already. Hand over only the columns needed.
    """
    cut = with_buckets(df if stored else cut_lineage(df), value, tie, buckets)
    totals = cut.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    carry = _carry(totals, [], "_bucket", ["n"])
    order = [value.asc_nulls_first(), tie_number(df, tie).asc(), F.col(tie).asc()]
    inside = Window.partitionBy("_bucket").orderBy(*order)
    # One carry row per bucket: at most a few thousand rows, whatever the table size.
    return (
        cut.withColumn("_in", F.row_number().over(inside))
        .join(F.broadcast(carry), "_bucket")
        .withColumn(out, (F.col("_in") + F.col("_carry_n")).cast("long"))
        .drop("_in", "_carry_n", "_bucket")
    )


def smallest(df: DataFrame, code: Column, rows: int, *ties: str) -> DataFrame:
    """The ``rows`` rows with the smallest 64-bit hash ``code`` (then by ``ties``), for a ``rows`` that one task can order.

    The hash is spread evenly, so the share of rows wanted is the share of its range that holds them. Rows above that bound go before
    anything is ordered: about ``5 / 4 * rows`` reach the ordering task, however many rows and partitions there are. The bound is
    widened until it holds enough rows. Rows that share a hash pass or go together.
    """
    total = df.count()
    share = (1.25 * rows + 100) / max(total, 1)
    while share < 1:
        near = df.filter(code <= F.lit(int(share * 2**64) - 2**63))
        if near.count() >= rows:
            return near.orderBy(code, *ties).limit(rows)
        share *= 2
    return df.orderBy(code, *ties).limit(rows)


def collapse(df: DataFrame, value: str, sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """One stored row per distinct value (and group) with its sums: the only pass over the input."""
    return cut_lineage(df.groupBy(*(by or []), value).agg(*[c.alias(n) for n, c in sums.items()]))


def running_sums(
    flat: DataFrame,
    value: str,
    names: list[str],
    by: list[str] | None = None,
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Inclusive running sums ``cum_<name>`` over a table from :func:`collapse`."""
    by = by or []
    sign = -F.col(value) if descending else F.col(value)
    cut = with_buckets(flat, sign, None, buckets)
    totals = cut.groupBy(*by, "_bucket").agg(*[F.sum(n).alias(n) for n in names])
    carry = _carry(totals, by, "_bucket", names)
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = (
        Window.partitionBy(*by, "_bucket")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = cut.withColumns({f"_in_{n}": F.sum(n).over(inside) for n in names}).join(
        carry, [*by, "_bucket"]
    )
    return out.select(
        *by, value, *names, *[(F.col(f"_in_{n}") + F.col(f"_carry_{n}")).alias(f"cum_{n}") for n in names]
    )


def global_cumsum(
    df: DataFrame,
    value: str,
    sums: dict[str, Column],
    by: list[str] | None = None,
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Running sums per distinct ``value`` (ties together), optionally inside groups ``by``."""
    return running_sums(collapse(df, value, sums, by), value, list(sums), by, descending, buckets)


def gap_to_previous(df: DataFrame, ts_micros: Column, tie: str, buckets: int | None = None) -> DataFrame:
    """Adds ``prev_micros``: the time of the row before in the order (time, tie) of the whole table."""
    cut = with_buckets(cut_lineage(df.withColumn("_us", ts_micros)), F.col("_us"), tie, buckets)
    inside = Window.partitionBy("_bucket").orderBy(F.col("_us").asc_nulls_first(), tie_number(df, tie), tie)
    ends = cut.groupBy("_bucket").agg(F.max("_us").alias("_last"))
    step = Window.partitionBy(F.lit(0)).orderBy("_bucket")
    ends = ends.select("_bucket", F.lag("_last").over(step).alias("_before"))
    return (
        cut.withColumns({"_prev": F.lag("_us").over(inside), "_first": F.row_number().over(inside) == 1})
        .join(F.broadcast(ends), "_bucket")
        .withColumn("prev_micros", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_prev")))
        .drop("_us", "_prev", "_first", "_before", "_bucket")
    )

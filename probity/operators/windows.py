"""Windows per reviewer (or any key) that hold when one key owns a large share of the table.

Every key is cut along time: each (key, time bucket) is its own window and the carry between buckets is a small
table. One plan serves all keys, so a row's result does not change when its key or the table grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.functions.temporal import DAY_MICROS, micros, whole_days
from probity.operators.ordered import tie_number, with_buckets

def days_since_previous(
    df: DataFrame,
    key: str = "reviewer_id",
    ts: str = "published_at",
    tie: str = "review_id",
    out: str = "days_since_last_review",
    buckets: int | None = None,
) -> DataFrame:
    """Whole days since the key's row before in time; NULL on the first row, and on rows without a key, which have no history."""
    here = micros(F.col(ts))
    lone = df.filter(F.col(key).isNull()).withColumn(out, F.lit(None).cast("long"))
    cut = with_buckets(df.filter(F.col(key).isNotNull()), here, tie, buckets)
    w = Window.partitionBy(key, "_bucket").orderBy(F.col(ts).asc(), tie_number(df, tie).asc(), F.col(tie).asc())
    ends = cut.groupBy(key, "_bucket").agg(F.max(here).alias("_last"))
    step = Window.partitionBy(key).orderBy("_bucket")  # one row per bucket of the key
    ends = ends.select(key, "_bucket", F.lag("_last").over(step).alias("_before"))
    found = (
        cut.withColumns({"_prev": F.lag(here).over(w), "_pos": F.row_number().over(w)})
        .join(ends, [key, "_bucket"])
        .withColumn(out, whole_days(here - F.when(F.col("_pos") == 1, F.col("_before")).otherwise(F.col("_prev"))))
        .drop("_prev", "_pos", "_before", "_bucket")
    )
    return found.unionByName(lone)


def rolling_names(days: int) -> list[str]:
    return [
        f"rolling_{days}d_stars_mean",
        f"rolling_{days}d_stars_count",
        f"rolling_{days}d_stars_std",
        f"rolling_{days}d_review_count",
    ]


STAR_DECIMALS = 6
LIMB = 32


def _spread(n: Column, s1: Column, high: Column, low: Column) -> Column:
    """n times the sum of squared deviations, n * s2 - s1 * s1, taken without rounding; s2 comes in two limbs."""
    s2 = high.cast("decimal(19,0)") * F.lit(2**LIMB).cast("decimal(10,0)") + low.cast("decimal(19,0)")
    exact = n.cast("decimal(12,0)") * s2.cast("decimal(30,0)") - s1.cast("decimal(19,0)") * s1.cast("decimal(19,0)")
    return exact.cast("double") / 10 ** (2 * STAR_DECIMALS)


def rolling_stars(
    df: DataFrame,
    key: str = "reviewer_id",
    ts: str = "published_at",
    stars: str = "stars",
    days=(7, 30),
    buckets: int | None = None,
) -> DataFrame:
    """Past-only rolling statistics in [t - w, t): mean, count, sample deviation and review count.

    Instants are pre-aggregated, and the sum over a span is the difference of two running sums, so a dense key costs no
    more per row than a sparse one. The sums are integers: stars are read to ``STAR_DECIMALS`` decimals, and squares are
    summed as two limbs of 32 bits. Integers leave nothing behind when they cancel, so a span's deviation is exact however many rows of
    the key came before it. Rows without a time or a key get count 0 and NULL statistics. Stars beyond 3000 are an error (overflow).
    """
    part = df.withColumn("_us", micros(F.col(ts)))
    s = F.round(F.col(stars) * 10**STAR_DECIMALS).cast("long")
    sums = {
        "c": F.count(F.lit(1)),
        "n": F.count(s),
        "s1": F.coalesce(F.sum(s), F.lit(0).cast("long")),
        "high": F.coalesce(F.sum(F.shiftright(s * s, LIMB)), F.lit(0).cast("long")),
        "low": F.coalesce(F.sum((s * s).bitwiseAND(F.lit(2**LIMB - 1))), F.lit(0).cast("long")),
    }
    moments = part.filter(F.col("_us").isNotNull() & F.col(key).isNotNull()).groupBy(key, "_us").agg(
        *[c.alias(n) for n, c in sums.items()]
    )
    # Each instant asks for the running sums at its own time and at the start of every span; the
    # difference of two running sums is the sum over the span.
    own = F.struct(F.col("_us").alias("pos"), F.lit(0).alias("span"), *[F.col(n) for n in sums])
    asks = [
        F.struct(
            (F.col("_us") - d * DAY_MICROS).alias("pos"),
            F.lit(d).alias("span"),
            *[F.lit(0).cast("long").alias(n) for n in sums],
        )
        for d in days
    ]
    points = moments.select(key, "_us", F.explode(F.array(own, *asks)).alias("p")).select(
        key, "_us", "p.*"
    )
    cut = with_buckets(points, F.col("pos"), None, buckets)
    totals = cut.groupBy(key, "_bucket").agg(*[F.sum(n).alias(n) for n in sums])
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        key,
        "_bucket",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
    )
    below = (
        Window.partitionBy(key, "_bucket")
        .orderBy("pos")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    running = cut.withColumns(
        {f"_r_{n}": F.coalesce(F.sum(n).over(below), F.lit(0)) for n in sums}
    ).join(carry, [key, "_bucket"])
    spans = [0, *days]
    at = running.groupBy(key, "_us").agg(
        *[
            F.max(F.when(F.col("span") == d, F.col(f"_r_{n}") + F.col(f"_c_{n}"))).alias(f"_{n}_{d}")
            for d in spans
            for n in sums
        ]
    )
    stats: list[Column] = []
    for d in days:
        c, n, s1, high, low = (F.col(f"_{x}_0") - F.col(f"_{x}_{d}") for x in sums)
        mean, count, std, reviews = rolling_names(d)
        stats += [
            F.when(n > 0, s1 / n / 10**STAR_DECIMALS).alias(mean),
            n.alias(count),
            F.when(n > 1, F.sqrt(_spread(n, s1, high, low) / (n.cast("double") * (n - 1)))).alias(std),
            c.alias(reviews),
        ]
    at = at.select(key, "_us", *stats)
    zero = [name for d in days for name in (rolling_names(d)[1], rolling_names(d)[3])]
    return part.join(at, [key, "_us"], "left").drop("_us").na.fill(0, zero)

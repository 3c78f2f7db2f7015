"""The cheapest pair of thresholds among all pairs of scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.operators.metrics import ratio
from probity.operators.ordered import collapse, running_sums
from probity.session import cut_lineage

BUCKETS = 4096


def exact_thresholds(
    df: DataFrame, p: str = "p_final", y: str = "y", c_fp: float = 5.0, c_fn: float = 3.0, c_route: float = 1.0,
    max_route: float = 0.01, min_precision: float = 0.8,
) -> DataFrame:
    """The optimum over every pair low < high of distinct scores: keep p <= low, remove p >= high, route what is between.

    A null ``low`` keeps nothing, a null ``high`` removes nothing (its precision is 0). At most ``max_route`` of the rows may be routed and the
    removed ones must be right at ``min_precision``. Ties go to the smaller low, then the smaller high, null first. One row with the
    counts, or none if no pair is allowed. Rows without score or truth do not count.

    The cost splits into a part of the high threshold and a part ``g`` of the low one, and the route limit says how many rows may lie
    between. So every high asks for the least g in a span of row positions of fixed length. Positions are cut into buckets not wider than the
    span: a span is the end of one bucket, whole buckets and the start of another. The three parts are suffix minima, minima over bucket
    totals (at most ``BUCKETS`` or 1 / max_route rows) and prefix minima; none looks at pairs, and the best of all highs is one aggregate.
    """
    known = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    flat = collapse(known.withColumn(p, F.col(p) + 0.0), p, {"n": F.count(F.lit(1)), "bad": F.sum((F.col(y) == 1).cast("long"))})
    total, bad = flat.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    span = int(max_route * total + 1e-9)
    width = max(1, min(-(-total // BUCKETS), span))
    steps = cut_lineage(running_sums(flat, p, ["n", "bad"]))
    spark = df.sparkSession
    ends = spark.range(1)

    c_fp, c_fn, c_route = float(c_fp), float(c_fn), float(c_route)
    g = F.lit(c_fn) * F.col("cum_bad") - F.lit(c_route) * F.col("cum_n")
    none = F.lit(None).cast("double")
    lows = steps.select(F.col("cum_n").alias("at"), g.alias("g"), F.col(p).alias("low"))
    lows = lows.unionByName(ends.select(F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("g"), none.alias("low")))
    before, bad_before = F.col("cum_n") - F.col("n"), F.col("cum_bad") - F.col("bad")
    highs = steps.select(
        before.alias("at"), (F.lit(total - bad) - (before - bad_before)).alias("fp"), (F.lit(bad) - bad_before).alias("tp"), F.col(p).alias("high")
    )
    zero = F.lit(0).cast("long")
    highs = highs.unionByName(ends.select(F.lit(total).cast("long").alias("at"), zero.alias("fp"), zero.alias("tp"), none.alias("high")))
    highs = highs.filter(ratio(F.col("tp"), F.col("tp") + F.col("fp")) >= min_precision)
    highs = highs.select("at", "high", (F.lit(c_fp) * F.col("fp") + F.lit(c_route) * F.col("at")).alias("h"))

    def bucket(at: Column) -> Column:
        return F.floor(at / width)

    start = F.greatest(F.col("at") - span, zero)
    low, no_low = F.struct("g", "low"), F.lit(None).cast("struct<g:double,low:double>")
    points = lows.select(bucket(F.col("at")).alias("b"), "at", F.lit(0).alias("kind"), low.alias("lo"), F.lit(None).cast("double").alias("h"), none.alias("high"))
    tops = highs.select(bucket(F.col("at")).alias("b"), "at", F.lit(1).alias("kind"), no_low.alias("lo"), "h", "high")
    tails = highs.select(
        bucket(start).alias("b"), start.alias("at"), F.lit(1).alias("kind"), no_low.alias("lo"), "h", "high", bucket(F.col("at")).alias("own")
    )
    tails = tails.filter("b < own").drop("own")
    if span == 0:
        # Nothing may be routed: the low threshold is the score right below the high one.
        parts = [lows.join(highs, "at").select("g", "low", "h", "high")]
    else:
        up = Window.partitionBy("b").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        down = Window.partitionBy("b").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        parts = [
            points.unionByName(side).withColumn("lo", F.min("lo").over(w)).filter("kind = 1 AND lo IS NOT NULL").select("lo.g", "lo.low", "h", "high")
            for side, w in ((tops, up), (tails, down))
        ]
        # Whole buckets: the start of a span lies `far` or `far + 1` buckets back, or at the first row.
        far = span // width
        near = Window.orderBy("b")
        totals = points.groupBy("b").agg(F.min("lo").alias("lo"))
        totals = totals.withColumns(
            {"short": F.min("lo").over(near.rangeBetween(1 - far, -1)) if far > 1 else no_low, "long": F.min("lo").over(near.rangeBetween(-far, -1))}
        )
        wide = (F.col("at") <= span) | (bucket(start) < bucket(F.col("at")) - far)
        own = highs.groupBy(bucket(F.col("at")).alias("b"), wide.alias("wide")).agg(F.min(F.struct("h", "high")).alias("hi"))
        between = own.join(totals, "b").withColumn("lo", F.when(F.col("wide"), F.col("long")).otherwise(F.col("short")))
        parts.append(between.filter("lo IS NOT NULL").select("lo.g", "lo.low", "hi.h", "hi.high"))
    pairs = reduce(DataFrame.unionByName, parts)
    best = pairs.agg(F.min(F.struct((F.col("g") + F.col("h")).alias("cost"), "low", "high")).alias("best")).first()["best"]
    lo, hi = (best["low"], best["high"]) if best else (None, None)
    kept = F.lit(False) if lo is None else F.col(p) <= lo
    gone = F.lit(False) if hi is None else F.col(p) >= hi

    def rows_of(cond: Column, what: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(what))), zero)

    good = flat.withColumn("good", F.col("n") - F.col("bad"))
    counts = good.agg(
        rows_of(gone, "good").alias("fp"), rows_of(gone, "bad").alias("tp"), rows_of(kept, "bad").alias("fn"), rows_of(~kept & ~gone, "n").alias("routes")
    ).filter(F.lit(best is not None))
    return counts.select(
        F.lit(lo).cast("double").alias("low"), F.lit(hi).cast("double").alias("high"), "fp", "tp", "fn", "routes",
        (F.col("fp") * c_fp + F.col("fn") * c_fn + F.col("routes") * c_route).alias("cost"),
        ratio(F.col("routes"), F.lit(total)).alias("route_rate"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )

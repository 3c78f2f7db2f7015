"""Calibration quality, drift, slices and threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity import constants as K
from probity.functions import risk as R
from probity.operators.metrics import ratio
from probity.session import cut_lineage


def score_bin(p: Column, bins: int = 10) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def calibration_error(df: DataFrame, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error from one pass over the rows."""
    per = df.groupBy(score_bin(F.col(p), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(F.col(y).cast("double")).alias("sy"),
        F.sum((F.col(p) - F.col(y)) ** 2).alias("sq"),
    )
    gap = F.abs(F.col("sp") - F.col("sy"))
    return per.agg((F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(gap) / F.sum("n")).alias("ece"))


def stability_index(df: DataFrame, p: str, first: Column, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability index of a score between the rows of ``first`` and the others."""
    a, b = F.sum(first.cast("long")), F.sum((~first).cast("long"))
    per = cut_lineage(df.groupBy(score_bin(F.col(p), bins).alias("bin")).agg(a.alias("a"), b.alias("b")))
    total = per.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b")).alias("t")).scalar()
    per = per.withColumn("_t", total)
    pa = F.greatest(ratio(F.col("a"), F.col("_t.a")), F.lit(floor))
    pb = F.greatest(ratio(F.col("b"), F.col("_t.b")), F.lit(floor))
    return per.agg(F.sum((pa - pb) * F.log(pa / pb)).alias("psi"))


def removal_spikes(df: DataFrame, day: Column, removed: Column, y: str = "y") -> DataFrame:
    """Daily false-positive rate of removals and whether it exceeds mean + 3 deviations of all days."""
    good = F.col(y) == 0
    daily = df.groupBy(day.alias("day")).agg(
        ratio(F.sum((removed & good).cast("long")), F.sum(good.cast("long"))).alias("fpr")
    )
    daily = cut_lineage(daily)
    line = daily.agg((F.avg("fpr") + 3 * F.stddev_samp("fpr")).alias("l")).scalar()
    return daily.withColumn("alert", F.coalesce(F.col("fpr") > line, F.lit(False)))


def sliced_metrics(df: DataFrame, slices: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Accuracy and flag precision over the whole and per slice: grouping sets in one pass."""
    hit = (F.col(y) == F.col(yhat)).cast("double")
    flagged = F.col(yhat) == 1
    cols = [F.col(s) for s in slices]
    out = df.groupingSets([[], *[[c] for c in cols]], *cols).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"),
        ratio(F.sum((flagged & (F.col(y) == 1)).cast("long")), F.sum(flagged.cast("long"))).alias("precision"),
    )
    return out


def disagreement(p_text: Column, p_meta: Column, delta: float = 0.5) -> dict[str, Column]:
    return {
        "stages_disagree": ((p_text >= 0.5) != (p_meta >= 0.5)).cast("int"),
        "wide_gap": (F.abs(p_text - p_meta) >= delta).cast("int"),
    }


def decision_sweep(df: DataFrame, probs: str, settings: dict[str, tuple]) -> DataFrame:
    """Decision shares of several threshold settings beside the target shares; one pass for all."""
    sums, rows = [F.count(F.lit(1)).alias("n")], []
    for i, (name, cuts) in enumerate(settings.items()):
        decided = R.threshold_decision(F.col(probs), *cuts)["final_prediction"]
        for j, d in enumerate(K.DECISIONS):
            sums.append(F.sum((decided == d).cast("long")).alias(f"c{i}_{j}"))
            low, high = K.TARGET_SHARES[d]
            rows.append(f"'{name}', '{d}', c{i}_{j}, CAST({low} AS DOUBLE), CAST({high} AS DOUBLE)")
    long = df.agg(*sums).selectExpr(
        "n AS total", f"stack({len(rows)}, {', '.join(rows)}) AS (setting, decision, n, target_low, target_high)"
    )
    out = long.withColumn("percent", ratio(F.col("n") * 100, F.col("total"))).drop("total")
    return out.withColumn("on_target", F.col("percent").between(F.col("target_low"), F.col("target_high")))


def tier_sweep(df: DataFrame, risk: str, presets: dict[str, tuple] = K.TIER_PRESETS) -> DataFrame:
    sums, rows = [F.count(F.lit(1)).alias("n")], []
    for i, (name, cuts) in enumerate(presets.items()):
        t = R.tier(F.col(risk), cuts)
        for j, d in enumerate(K.TIERS):
            sums.append(F.sum((t == d).cast("long")).alias(f"c{i}_{j}"))
            rows.append(f"'{name}', '{d}', c{i}_{j}")
    long = df.agg(*sums).selectExpr("n AS total", f"stack({len(rows)}, {', '.join(rows)}) AS (preset, tier, n)")
    return long.withColumn("percent", ratio(F.col("n") * 100, F.col("total"))).drop("total")


def foreign_share(df: DataFrame, language: str = "language", home: str = "en", limit: float = 0.2) -> DataFrame:
    share = F.avg((F.col(language) != home).cast("double"))
    return df.agg(share.alias("foreign_share"), (share > limit).alias("red_flag"))

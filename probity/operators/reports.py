"""The tables behind the summaries, reports and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity import constants as K
from probity.functions import risk as R
from probity.functions import text as X
from probity.operators.metrics import ratio
from probity.operators.ordered import global_row_number
from probity.session import cut_lineage

DECISION_COLUMNS = {
    "genuine": "genuine", "suspicious": "suspicious", "low_quality": "low-quality", "spam": "high-confidence-spam",
}


def _n(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))


def batch_summary(df: DataFrame) -> DataFrame:
    """Totals, per-decision counts, errors, shares and means over the rows that were scored."""
    ok = ~F.col("is_error")
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        _n(ok).alias("processed"),
        *[_n(ok & (F.col("final_prediction") == v)).alias(k) for k, v in DECISION_COLUMNS.items()],
        _n(~ok).alias("errors"),
        F.coalesce(F.avg(F.when(ok, F.col("final_confidence"))), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.avg(F.when(ok, F.col("p_bad"))), F.lit(0.0)).alias("avg_risk_score"),
    )
    flagged = F.col("processed") - F.col("genuine")
    return counts.withColumns(
        {
            "genuine_percentage": F.round(ratio(F.col("genuine") * 100, F.col("processed")), 1),
            "flagged_count": flagged,
            "flagged_percentage": F.round(ratio(flagged * 100, F.col("processed")), 1),
        }
    )


def share_table(df: DataFrame, column: str | Column, name: str = "name") -> DataFrame:
    """Count and percent of the total per value. The counts are stored, so the rows are read once."""
    col = F.col(column) if isinstance(column, str) else column
    counts = cut_lineage(df.groupBy(col.alias(name)).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("percent", ratio(F.col("n") * 100, total))


def detailed_stats(df: DataFrame) -> DataFrame:
    """Text-class, confidence, risk and route breakdowns of the valid rows in one long table.

    Each row counts once in every breakdown; the four keys ride on one pass and one shuffle of counts.
    """
    valid = df.filter(~F.col("is_error"))
    keys = F.array(
        F.struct(F.lit("text_prediction").alias("breakdown"), F.col("text_prediction").alias("bin")),
        F.struct(F.lit("confidence").alias("breakdown"), R.confidence_bin(F.col("final_confidence")).alias("bin")),
        F.struct(F.lit("risk").alias("breakdown"), R.risk_bin(F.col("p_bad")).alias("bin")),
        F.struct(F.lit("route").alias("breakdown"), F.col("routing_decision").alias("bin")),
    )
    return valid.select(F.explode(keys).alias("k")).groupBy("k.breakdown", "k.bin").agg(F.count(F.lit(1)).alias("n"))


def running_totals(df: DataFrame) -> DataFrame:
    """Service totals: counts per decision, genuine and flagged share on one decimal."""
    out = df.agg(
        F.count(F.lit(1)).alias("total_processed"),
        *[_n(F.col("final_prediction") == v).alias(f"{k}_count") for k, v in DECISION_COLUMNS.items()],
    )
    total = F.greatest(F.lit(1), F.col("total_processed"))
    return out.withColumns(
        {
            "genuine_percentage": F.round(F.col("genuine_count") / total * 100, 1),
            "flagged_percentage": F.round((total - F.col("genuine_count")) / total * 100, 1),
        }
    )


def text_stage_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        *[_n(F.col("text_prediction") == c).alias(f"n_{c}") for c in K.TEXT_CLASSES],
        _n(F.col("text_binary") == "genuine").alias("n_genuine"),
        _n(F.col("text_binary") != "genuine").alias("n_non_genuine"),
        F.avg("text_confidence").alias("avg_confidence"),
        F.avg("p_bad").alias("avg_quality_risk"),
        _n(F.col("p_bad") > 0.7).alias("high_risk_count"),
    )


def metadata_stage_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("metadata_anomaly_score").alias("avg_anomaly_score"),
        _n(F.col("metadata_is_anomaly")).alias("anomaly_count"),
        *[_n(F.col("metadata_risk_level") == x).alias(f"n_{x}") for x in ("low", "medium", "high")],
    )


def fusion_stage_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        *[_n(F.col("fusion_prediction") == t).alias(f"n_{t}") for t in K.TIERS],
        F.avg("fusion_risk_score").alias("avg_risk_score"),
        F.avg("fusion_confidence").alias("avg_confidence"),
        _n(F.col("fusion_risk_score") > 0.7).alias("high_risk_count"),
    )


def overall_analysis(df: DataFrame) -> DataFrame:
    r = F.col("fusion_risk_score")
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("total_reviews"),
        F.avg(r).alias("avg_risk_score"),
        ratio(_n(r > 0.7) * 100, n).alias("high_risk_percentage"),
        ratio(_n(r < 0.3) * 100, n).alias("low_risk_percentage"),
        *[_n(F.col("fusion_prediction") == t).alias(f"n_{t}") for t in K.TIERS],
    )


def recommendations(overall: DataFrame) -> DataFrame:
    marks = F.array(
        F.when(F.col("high_risk_percentage") > 30, K.RECOMMEND_HIGH_RISK),
        F.when(F.col("avg_risk_score") > 0.6, K.RECOMMEND_MEAN_RISK),
        F.when(F.col("low_risk_percentage") > 70, K.RECOMMEND_LOW_RISK),
    )
    return overall.withColumn("recommendations", F.filter(marks, lambda m: m.isNotNull()))


def genuine_examples(df: DataFrame, k: int = 5) -> DataFrame:
    """The first k genuine rows by key."""
    return df.filter(F.col("final_prediction") == "genuine").orderBy("review_id").limit(k)


def preview(df: DataFrame, k: int = 10, width: int = 150) -> DataFrame:
    return df.orderBy("review_id").limit(k).withColumn("text", X.cut(F.col("text"), width))


def violation_rows(df: DataFrame) -> DataFrame:
    """One row per policy violation."""
    return df.select("*", F.explode(R.violations(F.col("text_prediction"), F.col("p_bad"))).alias("violation"))


def violation_counts(df: DataFrame) -> DataFrame:
    return share_table(violation_rows(df).select("violation"), "violation", "violation")


def heat_map(df: DataFrame) -> DataFrame:
    return df.groupBy(R.heat_bin(F.col("p_bad")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


PERIODS = {"24h": 1, "7d": 7, "30d": 30, "90d": 90}


def violation_filter(
    df: DataFrame, as_of: Column, types: list[str] | None = None, period: str | None = None,
    start=None, end=None, min_confidence: float = 0.0,
) -> DataFrame:
    """Violations of chosen types, in a period before ``as_of`` or a date range, above a confidence."""
    out = df.filter(F.col("final_confidence") >= min_confidence)
    if types:
        out = out.filter(F.col("violation").isin(types))
    ts = F.col("published_at")
    if period:
        out = out.filter((ts > as_of - F.expr(f"INTERVAL {PERIODS[period]} DAYS")) & (ts <= as_of))
    if start is not None:
        out = out.filter(ts >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.filter(ts < F.lit(end).cast("timestamp"))
    return out


def severity_filter(df: DataFrame, wanted: str | None = None) -> DataFrame:
    """Severity from the risk in whole percent."""
    out = df.withColumn("percent", F.floor(F.col("p_bad") * 100).cast("int"))
    out = out.withColumn("severity", R.severity(F.col("percent")))
    return out.filter(F.col("severity") == wanted) if wanted else out


DECISION_FILTERS = {
    "all": lambda p: F.lit(True),
    "flagged": lambda p: p != "genuine",
    "genuine": lambda p: p == "genuine",
    "suspicious": lambda p: p == "suspicious",
}


def page(
    df: DataFrame, number: int, size: int = 10, decision: str = "all", min_confidence: float = 0.0,
    stored: bool = False,
) -> DataFrame:
    """One page of the filtered rows in key order, with shown and total counts.

    The page is cut by global row number, so a late page costs no more than the first.
    """
    kept = df.filter(DECISION_FILTERS[decision](F.col("final_prediction")) & (F.col("final_confidence") >= min_confidence))
    total = kept.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = global_row_number(kept, F.col("review_id"), "review_id", "place", stored=stored)
    low, high = (number - 1) * size, number * size
    out = ranked.filter((F.col("place") > low) & (F.col("place") <= high))
    return out.withColumn("total", total).withColumn("shown_to", F.least(F.lit(high), F.col("total")))


def daily_trend(df: DataFrame, days: int = 30) -> DataFrame:
    """Genuine and flagged counts per day of the last ``days`` days, days without rows as 0."""
    counts = df.groupBy(F.to_date("published_at").alias("day")).agg(
        _n(F.col("final_prediction") == "genuine").alias("genuine"),
        _n(F.col("final_prediction") != "genuine").alias("flagged"),
    )
    counts = cut_lineage(counts)  # one row per day, read for the last day and for the result
    last = counts.agg(F.max("day").alias("d"))
    spine = last.select(F.explode(F.sequence(F.date_sub("d", days - 1), F.col("d"))).alias("day"))
    return spine.join(counts, "day", "left").na.fill(0, ["genuine", "flagged"])


def group_accuracy(df: DataFrame, key: str, truth: str = "truth", predicted: str = "prediction") -> DataFrame:
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy")
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins between minimum and maximum, empty bins included."""
    x = F.col(column)
    ends = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("e")).scalar()
    rows = df.filter(x.isNotNull()).select(x.alias("x")).withColumn("_e", ends)
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    # Bin edges are lo + i * width; rounding keeps a value on an edge in the bin above it.
    at = F.floor(F.round(F.try_divide(F.col("x") - F.col("_e.lo"), width), 9))
    index = F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").na.fill(0, ["n"])


def mean_risk_by_stage(df: DataFrame) -> DataFrame:
    means = df.agg(
        F.avg("p_bad").alias("text"), F.avg("metadata_anomaly_score").alias("metadata"), F.avg("fusion_risk_score").alias("fusion")
    )
    return means.selectExpr("stack(3, 'text', text, 'metadata', metadata, 'fusion', fusion) AS (stage, mean_risk)")


def leader_board(scores: DataFrame) -> DataFrame:
    """Models by accuracy with rank; one row per model, so the order is over a handful of rows."""
    better = scores.agg(F.array_sort(F.collect_list("accuracy")).alias("a")).scalar()
    above = F.size(F.filter(F.col("_a"), lambda a: a > F.col("accuracy")))
    return scores.withColumn("_a", better).withColumn("rank", above + 1).drop("_a")


def anomaly_report(df: DataFrame, categories: dict, features: list[str]) -> DataFrame:
    """The full anomaly report as one JSON document built from bounded summaries."""
    from probity.operators import anomaly as A

    summary = A.category_summary(df, categories)
    tops = A.top_per_feature(df, features)
    text = A.text_summary(df)
    worst = A.top_anomalies(df.select("review_id", "reviewer_id", "ml_anomaly_score", "text_quality_risk"))

    def packed(t: DataFrame, order: str) -> Column:
        rows = F.array_sort(F.collect_list(F.struct(order, *[c for c in t.columns if c != order])))
        return t.agg(rows.alias("r")).scalar()

    head = df.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.sum("ml_anomaly").alias("anomaly_count"),
        F.avg("ml_anomaly").alias("anomaly_rate"),
    )
    doc = F.struct(
        "total_reviews",
        F.struct("anomaly_count", "anomaly_rate", packed(worst, "review_id").alias("top_anomalies")).alias("ml_anomaly_summary"),
        packed(text, "text_prediction").alias("text_summary"),
        packed(summary, "category").alias("anomaly_summary"),
        packed(tops, "feature").alias("top_per_feature"),
    )
    return head.select(F.to_json(doc).alias("report"))


def tester_report(df: DataFrame, input_name: str) -> DataFrame:
    """Test report as one JSON document: info, stage scores, overall analysis, recommendations."""

    def one(t: DataFrame) -> Column:
        return t.agg(F.first(F.struct(*t.columns)).alias("s")).scalar()

    overall = recommendations(overall_analysis(df))
    doc = F.struct(
        F.struct(F.lit(input_name).alias("input_file"), F.col("total_reviews"), F.lit("2.0").alias("pipeline_version")).alias("test_info"),
        F.struct(
            one(text_stage_summary(df)).alias("stage1_text"),
            one(metadata_stage_summary(df)).alias("stage2_metadata"),
            one(fusion_stage_summary(df)).alias("stage3_fusion"),
        ).alias("stage_scores"),
        F.struct(*[c for c in overall.columns if c != "recommendations"]).alias("overall_analysis"),
        F.col("recommendations"),
    )
    return overall.select(F.to_json(doc).alias("report"))


def run_record(df: DataFrame, source: str, mode: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(source).alias("source"), "rows", F.current_timestamp().alias("finished_at"), F.lit(mode).alias("mode")
    )

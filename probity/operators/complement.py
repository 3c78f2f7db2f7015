"""How two stages complement each other on rows with a known truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.constants import COMPLEMENT_REPORT
from probity.operators.metrics import ratio

METRICS = [
    "stage1_coverage", "stage2_coverage", "stage2_recovery_rate", "stage2_unique_catches",
    "stage1_recovery_rate", "stage1_unique_catches", "combined_or_coverage", "combined_and_precision",
    "overall_agreement", "problematic_agreement", "stage2_unique_precision", "stage1_unique_precision",
    "false_negative_reduction", "false_positive_increase", "total_samples", "total_problematic",
    "stage1_flags", "stage2_flags", "combined_flags",
]


def _n(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))


def complement_metrics(df: DataFrame, y: str = "y", s1: str = "stage1", s2: str = "stage2") -> DataFrame:
    """Every count from one pass over the rows, every rate from those counts."""
    bad, a, b = F.col(y) == 1, F.col(s1) == 1, F.col(s2) == 1
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        _n(bad).alias("bad"),
        _n(a).alias("a"),
        _n(b).alias("b"),
        _n(a | b).alias("either"),
        _n(a & b).alias("both"),
        _n(a & bad).alias("a_bad"),
        _n(b & bad).alias("b_bad"),
        _n((a | b) & bad).alias("either_bad"),
        _n(a & b & bad).alias("both_bad"),
        _n(a & ~b & bad).alias("only_a_bad"),
        _n(b & ~a & bad).alias("only_b_bad"),
        _n(a == b).alias("same"),
        _n((a == b) & bad).alias("same_bad"),
    )
    c = {x: F.col(x) for x in counts.columns}
    missed_a, missed_b = c["bad"] - c["a_bad"], c["bad"] - c["b_bad"]
    return counts.select(
        ratio(c["a_bad"], c["bad"]).alias("stage1_coverage"),
        ratio(c["b_bad"], c["bad"]).alias("stage2_coverage"),
        ratio(c["only_b_bad"], missed_a).alias("stage2_recovery_rate"),
        c["only_b_bad"].alias("stage2_unique_catches"),
        ratio(c["only_a_bad"], missed_b).alias("stage1_recovery_rate"),
        c["only_a_bad"].alias("stage1_unique_catches"),
        ratio(c["either_bad"], c["bad"]).alias("combined_or_coverage"),
        ratio(c["both_bad"], c["both"]).alias("combined_and_precision"),
        ratio(c["same"], c["n"]).alias("overall_agreement"),
        ratio(c["same_bad"], c["bad"]).alias("problematic_agreement"),
        ratio(c["only_b_bad"], c["b"] - c["both"]).alias("stage2_unique_precision"),
        ratio(c["only_a_bad"], c["a"] - c["both"]).alias("stage1_unique_precision"),
        ratio(c["either_bad"] - c["a_bad"], missed_a).alias("false_negative_reduction"),
        ratio((c["either"] - c["either_bad"]) - (c["a"] - c["a_bad"]), c["n"]).alias("false_positive_increase"),
        c["n"].alias("total_samples"),
        c["bad"].alias("total_problematic"),
        c["a"].alias("stage1_flags"),
        c["b"].alias("stage2_flags"),
        c["either"].alias("combined_flags"),
    )


def complement_report(metrics: DataFrame) -> DataFrame:
    """(metric, value, description) rows; rates with three decimals, counts as they are."""
    rows = []
    for title, key, text in COMPLEMENT_REPORT:
        value = f"CAST({key} AS STRING)" if key.endswith("catches") else f"format_number({key}, 3)"
        rows.append(f"'{title}', {value}, '{text}'")
    return metrics.selectExpr(f"stack({len(rows)}, {', '.join(rows)}) AS (metric, value, description)")


def breakdown(df: DataFrame) -> DataFrame:
    """Row by row: predictions, agreement, union and who was right."""
    y, a, b = F.col("y"), F.col("stage1"), F.col("stage2")
    either = F.greatest(a, b)
    return df.select(
        F.col("review_id").alias("sample_id"),
        F.col("truth").alias("true_label"),
        y.alias("true_binary"),
        a.alias("stage1_prediction"),
        F.col("stage1_confidence"),
        b.alias("stage2_prediction"),
        F.col("stage2_score"),
        (a == b).cast("int").alias("agreement"),
        either.alias("combined_or"),
        (a == y).cast("int").alias("stage1_correct"),
        (b == y).cast("int").alias("stage2_correct"),
        (either == y).cast("int").alias("combined_correct"),
    )

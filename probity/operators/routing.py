"""Routing under a budget and its costs."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.operators.metrics import ratio
from probity.operators.ordered import collapse, global_row_number, running_sums
from probity.session import cut_lineage


def band(p: Column, low: float, high: float) -> Column:
    return F.when(p <= low, "auto_keep").when(p >= high, "auto_remove").otherwise("grey")


def budgeted(
    df: DataFrame, low: float = 0.3, high: float = 0.9, budget: float = 0.01, meta_gate: float | None = None,
    disagreement: float | None = None, row_key: str = "review_id",
) -> DataFrame:
    """Keep, remove or route. Needs p_final, p_text, p_meta, p_rel, burst.

    At most ``floor(budget * rows)`` rows are routed: rows behind a hard gate first, then the grey band
    by priority. The cut is a global rank over the candidates, so the budget may grow with the table.
    """
    never = F.lit(False)
    gate = never
    if meta_gate is not None:
        gate = gate | (F.col("p_meta") >= meta_gate)
    if disagreement is not None:
        gate = gate | (F.abs(F.col("p_text") - F.col("p_rel")) >= disagreement)
    out = df.withColumns(
        {
            "band": band(F.col("p_final"), low, high),
            "gate": gate.cast("int"),
            "priority": F.greatest("p_final", "p_meta", "burst"),
        }
    )
    out = cut_lineage(out)  # counted, ranked and joined back below
    seats = out.agg(F.floor(F.count(F.lit(1)) * budget).alias("k")).scalar()
    waiting = out.filter((F.col("gate") == 1) | (F.col("band") == "grey")).select(row_key, "gate", "priority")
    ranked = global_row_number(waiting, -(F.col("gate") * 2 + F.col("priority")), row_key, "_place", stored=True)
    routed = ranked.filter(F.col("_place") <= seats).select(row_key, F.lit(True).alias("_routed"))
    out = out.join(routed, row_key, "left")
    return out.withColumn(
        "action",
        F.when(F.col("_routed"), "route")
        .when(F.col("band") == "grey", "keep_unrouted")
        .otherwise(F.col("band")),
    ).drop("_routed")


def queue_metrics(df: DataFrame, y: str = "y") -> DataFrame:
    """How many routed rows are problematic, and which share of the problems was routed."""
    routed = F.col("action") == "route"
    bad = F.col(y) == 1
    n = F.sum(routed.cast("long"))
    hit = F.sum((routed & bad).cast("long"))
    return df.agg(
        n.alias("routed"), ratio(hit, n).alias("queue_precision"),
        ratio(hit, F.sum(bad.cast("long"))).alias("capture_rate"),
    )


GRID = [(lo, hi) for lo, hi in product((0.2, 0.3, 0.4, 0.5), (0.6, 0.7, 0.8, 0.9))]


def cost_grid(
    df: DataFrame, p: str = "p_final", y: str = "y", grid=None, c_fp: float = 5.0, c_fn: float = 3.0,
    c_route: float = 1.0, max_route: float = 0.01, min_precision: float = 0.8,
) -> DataFrame:
    """Expected cost of every (low, high) pair: all counts in one pass, one row per pair at the end."""
    grid = grid or GRID
    x, bad = F.col(p), F.col(y) == 1
    sums, rows = [F.count(F.lit(1)).alias("n")], []

    def n(cond: Column) -> Column:
        return F.sum(cond.cast("long"))

    for i, (lo, hi) in enumerate(grid):
        sums += [
            n((x >= hi) & ~bad).alias(f"fp{i}"), n((x >= hi) & bad).alias(f"tp{i}"),
            n((x <= lo) & bad).alias(f"fn{i}"), n((x > lo) & (x < hi)).alias(f"r{i}"),
        ]
        rows.append(f"CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE), fp{i}, tp{i}, fn{i}, r{i}")
    long = df.agg(*sums).selectExpr("n", f"stack({len(grid)}, {', '.join(rows)}) AS (low, high, fp, tp, fn, routes)")
    out = long.withColumns(
        {
            "cost": F.col("fp") * c_fp + F.col("fn") * c_fn + F.col("routes") * c_route,
            "route_rate": ratio(F.col("routes"), F.col("n")),
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        }
    )
    return out.withColumn(
        "allowed", (F.col("route_rate") <= max_route) & (F.col("precision") >= min_precision)
    ).drop("n")


def best_setting(costs: DataFrame) -> DataFrame:
    """The cheapest allowed pair."""
    return costs.filter("allowed").orderBy("cost", "low", "high").limit(1)


def risk_coverage(df: DataFrame, confidence: str, wrong: Column) -> DataFrame:
    """Error rate among the most confident rows against the share of rows covered."""
    flat = collapse(df, confidence, {"n": F.count(F.lit(1)), "bad": F.sum(wrong.cast("long"))})
    steps = running_sums(flat, confidence, ["n", "bad"], descending=True)
    total = flat.agg(F.sum("n").alias("t")).scalar()
    return steps.withColumn("_t", total).select(
        confidence,
        (F.col("cum_n") / F.col("_t")).alias("coverage"),
        (F.col("cum_bad") / F.col("cum_n")).alias("risk"),
        (F.col("n") / F.col("_t")).alias("gain"),
    )


def risk_coverage_area(curve: DataFrame) -> DataFrame:
    return curve.agg(F.sum(F.col("gain") * F.col("risk")).alias("aurc"))

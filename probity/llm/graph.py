"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import stored


def _starred(edges: DataFrame, least: DataFrame, far: str) -> DataFrame:
    return edges.join(least.hint("merge"), "u").select(F.col(far).alias("u"), F.col("m").alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the node's smallest neighbour (or to the node itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _starred(both.filter("v > u"), least, "v").filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, point to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    return _starred(down, least, "v").union(own).filter("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """What tells two edge tables apart: their number of rows and two sums over hashes of the rows."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h % 1_000_003), F.sum(F.shiftrightunsigned(h, 20) % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of the edges ``u, v``; ``comp`` is the smallest node of its component.

    Groups are reduced to their minimum before rows meet, so no node's neighbours are ever gathered; a hot node is one
    skewed join key, which adaptive execution splits. Each round is written to the shared folder; the
    driver sees three numbers a round. No edges give no rows.
    """
    now = stored(edges.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        now = stored(_small_star(_large_star(now)))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v"), F.col("v"))).distinct()

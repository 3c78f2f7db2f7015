"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.session import cut_lineage, prepare

ARROW_ROWS = 512
SPACES = r"\x20\x09-\x0D"


def ready(spark: SparkSession) -> SparkSession:
    """Session settings for text rows: small Arrow batches, because one row may be a very long text."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder and read back."""
    return cut_lineage(df)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slim(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns under the operator's own names, so clashing extra columns do no harm."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def fold_of(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; null ids count as the empty text."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))) % parts


def range_numbers(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """0-based position of every row in the given order, without a one-task window.

    Range partitions hold neighbouring rows; each numbers its own rows and adds the rows of the
    partitions before it (one row per partition, so the broadcast is bounded by the partition count).
    """
    parts = stored(
        df.repartitionByRange(shuffle_partitions(df), *order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    )
    ends = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    ends = ends.select(
        F.col("_part").alias("_p"),
        "_first",
        F.expr("coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0)").alias("_before"),
    )
    return (
        parts.join(F.broadcast(ends), F.col("_part") == F.col("_p"))
        .withColumn(name, F.col("_before") + F.col("_at") - F.col("_first"))
        .drop("_part", "_p", "_at", "_first", "_before")
    )


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of Arrow batches as columns' Python values, batch by batch."""
    for batch in batches:
        yield from batch.to_pylist()


def code_points(text: str) -> np.ndarray:
    """The text's code points; lone surrogates count as themselves."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))

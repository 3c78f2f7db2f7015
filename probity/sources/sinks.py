"""Writing results, reports and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPORT = {
    "Text": "text",
    "Prediction": "final_prediction",
    "Confidence": "final_confidence",
    "Risk Score": "p_bad",
    "Action": "routing_decision",
    "Text Class": "text_prediction",
}


def export_columns(df: DataFrame) -> DataFrame:
    """The six columns of the result download."""
    return df.select(*[F.col(c).alias(title) for title, c in EXPORT.items()])


def flat(df: DataFrame) -> DataFrame:
    """Maps, arrays and structs as JSON text, for text formats."""
    nested = (T.MapType, T.ArrayType, T.StructType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    )


def write_csv(df: DataFrame, path: str, quote_all: bool = False, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """CSV with a header. Spaces at the ends of a text stay; ``partition_by`` writes a folder per value in the same job."""
    writer = flat(df).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.option("quoteAll", quote_all).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row JSON document."""
    report.select(F.col("report").alias("value")).coalesce(1).write.mode(mode).text(path)


def append_run(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("append").parquet(path)

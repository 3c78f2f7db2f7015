"""Reading review tables. Schemas are given or read from the header; values are cast later, safely."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header; quoted text may hold commas and quotes. All columns are text, or those of the schema.

    A large file is split over many tasks. With ``multi_line`` quoted text may hold line breaks too, at the price
    of one task per file.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_json(spark: SparkSession, path, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """JSON lines, split over many tasks; a line may hold a list of records. ``multi_line`` reads one document per file, in one task."""
    reader = spark.read.option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_parquet(spark: SparkSession, path, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*([path] if isinstance(path, str) else path))


READERS = {
    "csv": read_csv,
    "json": read_json,
    "jsonl": read_json,
    "parquet": read_parquet,
}


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """Reader by file suffix; anything unknown is an error. A given schema saves the pass that looks for one."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path else ""
    if suffix not in READERS:
        raise ValueError(f"unsupported file format: {path}")
    return READERS[suffix](spark, path, schema, multi_line)


def read_many(spark: SparkSession, paths, schema: T.StructType | None = None, multi_line: bool = False, by_folder: bool = False) -> DataFrame:
    """Many CSV files in one plan; ``input_file`` tells them apart, so results group by file.

    An input that a job wrote is a folder of files: with ``by_folder``, ``input_file`` is the name of the folder.
    As in every CSV read here, an empty text comes back as null.
    """
    df = read_csv(spark, paths, schema, multi_line)
    name = F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1) if by_folder else F.col("_metadata.file_name")
    return df.select("*", name.alias("input_file"))

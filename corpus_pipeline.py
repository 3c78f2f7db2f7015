"""From raw documents to token shards: quality rules, near-duplicates, decontamination, mixing, token ids."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm import decontaminate, mixing, neardup, quality, wavelet
from probity.llm.common import ready
from probity.session import checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"


def _same_columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed limits nor the outlier rule reject.

    Null and empty texts have no words, so they go; rows with a null id, language or source are judged like others (null is a group of
    its own); repeated rows are judged each; an empty table stays empty. A text counts whole, however long.
    """
    return _same_columns(quality.judge(docs, keep=docs.columns).filter("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8).

    The row with the smallest id stays (rows with an id before rows without), ties go by hash; a row that repeats id and text stays once.
    Null and empty texts have no shingles and are in no group, so they stay; an empty table stays empty.
    """
    return neardup.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves.

    Null and empty texts have no words and stay; an item without words finds nothing; repeated rows are judged each; an empty
    benchmark leaves every document, an empty table stays empty.
    """
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=docs.columns)
    return _same_columns(decontaminate.judged(found, keep=len(docs.columns)).filter("not contaminated"), docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null and empty texts have no words and are not taken; a null source is a source of its own; a row that occurs n times has n turns
    in the draw, and rows that share id and text but not the rest have their own; an empty table stays empty.
    """
    return mixing.mixed(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Wavelet shards of the token ids; one row per document, read back from the files.

    Null and empty texts are one end id; rows with a null id come first, equal ids follow a hash of
    the text; an empty table gives no rows.
    """
    path = wavelet.write_shards(docs, public_tokenizers.path(TOKENIZER))
    return wavelet.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "part", "shard")


STAGES = [
    ("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontaminate", benchmark_free), ("mix", mixed_sources), ("tokens", token_shards),
]

# Mixing draws at random and the shards are files: SQL cannot say the rows. tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; every stage's rows are written and read again."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs

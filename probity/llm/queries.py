"""Registered queries of the operators of this package, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm import decontaminate, fim, fingerprint, language, mixing, neardup, pii, quality, runs, secrets, sql, toxicity, urls, wavelet
from probity.llm.common import ready, table

TOKENIZER = "byte_bpe_50k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = lambda spark, folder: fn(ready(spark), folder)
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


@query("op1_wavelet_shards")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    path = wavelet.write_shards(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))
    return wavelet.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "part", "shard")


@query("op3_mix_sources")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op4_decontaminate", sql.DECONTAMINATE)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.judged(decontaminate.find(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query("op6_near_duplicates", sql.NEAR_DUPLICATES)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.link(table(spark, folder, "documents"), words=3, percent=85)


@query("op7_quality_rules")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept distance".split()
    return quality.judge(table(spark, folder, "documents")).select(*names)


@query("op9_personal_data", sql.PERSONAL_DATA)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, folder, "documents")))


@query("op2_url_filters", sql.URL_FILTERS)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))


@query("op8_language_id")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.prototypes(language.learned_rows(docs)))


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op5_secret_scan")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents")).drop("findings")


@query("op11_periodic_runs", sql.PERIODIC_RUNS)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.find(runs.with_periods(table(spark, folder, "documents")))
    return runs.digest(found)


@query("op12_fill_in_middle", sql.FILL_IN_MIDDLE)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    changed = fim.transform(table(spark, folder, "documents"))
    restored = fim.restore(changed.withColumn("output_sha256", F.sha2("output", 256)))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    return restored.select(*names, F.sha2("restored", 256).alias("restored_sha256"))


@query("op13_fingerprints")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.digest(fingerprint.beside_next(table(spark, folder, "documents")))

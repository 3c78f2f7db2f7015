"""Labelling reviews in small batches with outside models: prompts, answers, fail-over, resume.

The models themselves are plug-ins: a provider is a name and a function from prompt to answer text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity import constants as K
from probity.functions.text import cut, is_bad
from probity.operators.ordered import global_row_number
from probity.schema import LABEL_ANSWERS, MODEL_RESPONSES
from probity.session import cut_lineage
from probity.sources.normalise import keep_real_text


def in_batches(df: DataFrame, size: int = K.LABEL_BATCH, key: str = "review_id", text: str = "text", instead: list[str] = ()) -> DataFrame:
    """Rows with real text in key order, with batch number and 0-based position in the batch.

    Columns that name the text may be carried ``instead`` of it, so that no text is ordered.
    """
    rows = keep_real_text(df, text).select(key, *instead) if instead else keep_real_text(df.select(key, text), text)
    return numbered(rows, size, key)


def numbered(rows: DataFrame, size: int = K.LABEL_BATCH, key: str = "review_id") -> DataFrame:
    """All rows in key order, with batch number and 0-based position; where the numbers are all that is wanted, hand over no text."""
    out = global_row_number(rows, F.col(key), key, "_rn")
    at = F.col("_rn") - 1
    return out.withColumns(
        {"batch_id": F.floor(at / size).cast("long"), "pos": F.pmod(at, F.lit(size)).cast("int")}
    ).drop("_rn")


def prompts(batches: DataFrame, text: str = "text", limit: int | None = K.PROMPT_REVIEW_CHARS) -> DataFrame:
    """One prompt per batch of at most eight reviews, each cut after ``limit`` characters with ``...``; whole with ``limit=None``."""
    body = F.col(text) if limit is None else cut(F.col(text), limit)
    shown = F.concat(
        F.lit("\n"), (F.col("pos") + 1).cast("string"), F.lit('. "'), body, F.lit('"\n')
    )
    lines = batches.select("batch_id", "pos", shown.alias("line"))
    grouped = lines.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"), F.count(F.lit(1)).alias("expected")
    )
    body = F.concat_ws("", F.transform("lines", lambda x: x["line"]))
    return grouped.select(
        "batch_id", "expected", F.concat(F.lit(K.PROMPT_HEAD), body, F.lit(K.PROMPT_TAIL)).alias("prompt")
    )


def _default(reason: str, confidence: float = 0.0) -> Column:
    return F.struct(
        F.lit("spam").alias("classification"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reasoning")
    )


def parse_response(response: Column, expected: Column) -> Column:
    """Answers of a batch: the text from the first [ to the last ] as a JSON array.

    A wrong length or unreadable JSON gives the default answer for every row of the batch; single bad
    fields get their own defaults.
    """
    items = F.from_json(F.regexp_extract(response, r"(?s)\[.*\]", 0), LABEL_ANSWERS)
    fixed = F.transform(
        items,
        lambda x: F.struct(
            F.when(x["classification"].isin(K.TEXT_CLASSES), x["classification"]).otherwise("spam").alias("classification"),
            F.coalesce(x["confidence"], F.lit(0.5)).alias("confidence"),
            F.coalesce(x["reasoning"], F.lit(K.FIELD_DEFAULT_REASON)).alias("reasoning"),
        ),
    )
    failed = F.array_repeat(_default(K.PARSE_DEFAULT_REASON), expected.cast("int"))
    return F.when(F.coalesce(F.size(items) == expected, F.lit(False)), fixed).otherwise(failed)


def choose_response(responses: DataFrame) -> DataFrame:
    """Per batch the answer of the first provider in rank order that gave one."""
    return (
        responses.filter("ok")
        .groupBy("batch_id")
        .agg(F.min_by(F.struct("provider", "response"), "rank").alias("r"))
        .select("batch_id", "r.provider", "r.response")
    )


def label_rows(batches: DataFrame, responses: DataFrame) -> DataFrame:
    """Answers back on their rows by position; a batch nobody answered gets the default."""
    sizes = batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("expected"))
    chosen = sizes.join(choose_response(responses), "batch_id", "left")
    parsed = F.when(
        F.col("response").isNull(), F.array_repeat(_default(K.PROVIDER_DEFAULT_REASON), F.col("expected").cast("int"))
    ).otherwise(parse_response(F.col("response"), F.col("expected")))
    answers = chosen.select(
        "batch_id", F.coalesce("provider", F.lit("none")).alias("label_provider"), F.posexplode(parsed).alias("pos", "a")
    )
    out = batches.join(answers, ["batch_id", "pos"], "left")
    return out.select(
        *batches.columns,
        F.col("a.classification").alias("label_class"),
        F.col("a.confidence").alias("label_confidence"),
        F.col("a.reasoning").alias("label_reasoning"),
        "label_provider",
        is_bad(F.col("a.classification")).alias("fake_review"),
    )


@dataclass(frozen=True)
class Provider:
    name: str
    ask: Callable[[str], str]


SWITCH_AT_ONCE = ("rate limit", "rate_limit_exceeded", "429", "401", "invalid_api_key", "unauthorized")


def ask_providers(prompt_table: DataFrame, providers: list[Provider]) -> DataFrame:
    """Asks the providers in order until one answers; one retry unless the error says to move on."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for batch_id, prompt in zip(pdf["batch_id"], pdf["prompt"]):
                for rank, p in enumerate(providers):
                    answer = None
                    for attempt in (1, 2):
                        try:
                            answer = p.ask(prompt)
                            break
                        except Exception as e:  # noqa: BLE001 - any failure moves on
                            if attempt == 2 or any(s in str(e).lower() for s in SWITCH_AT_ONCE):
                                break
                    rows.append((batch_id, p.name, rank, answer is not None, answer))
                    if answer is not None:
                        break
            yield pd.DataFrame(rows, columns=["batch_id", "provider", "rank", "ok", "response"])

    return prompt_table.select("batch_id", "prompt").mapInPandas(ask, MODEL_RESPONSES)


def unlabelled(df: DataFrame, labelled: DataFrame, key: str = "review_id") -> DataFrame:
    """Rows not labelled yet, so a run that stopped goes on where it was."""
    return df.join(labelled.select(key), key, "left_anti")


def label_distribution(labelled: DataFrame) -> DataFrame:
    """Classes and providers with count and percent, in one table."""
    keys = F.array(
        F.struct(F.lit("class").alias("kind"), F.col("label_class").alias("name")),
        F.struct(F.lit("provider").alias("kind"), F.col("label_provider").alias("name")),
    )
    counts = labelled.select(F.explode(keys).alias("k")).groupBy("k.kind", "k.name").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)
    total = counts.filter("kind = 'class'").agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("percent", F.col("n") * 100.0 / total)

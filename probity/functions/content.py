"""Per-row content features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions.text import mean_word_length, measure, measured, word_count


def has_image(urls: Column) -> Column:
    return urls.isNotNull().cast("int")


def image_count(urls: Column) -> Column:
    """Length of the list when the value is a list, otherwise 0."""
    return F.when(urls.startswith("["), F.coalesce(F.json_array_length(urls), F.lit(0))).otherwise(0)


def language_match(language: Column, original: Column) -> Column:
    return F.coalesce((language == original).cast("int"), F.lit(0))


def with_content(df: DataFrame) -> DataFrame:
    """Adds the content features. Words are counted once and the count is used by what follows; measures of the text are used if there."""
    text, urls, known = F.col("text"), F.col("review_image_urls"), measured(df, "text")
    out = df.withColumns(
        {
            "has_image": has_image(urls),
            "image_count": image_count(urls),
            "text_length": measure("length") if known else F.length(text),
            "word_count": measure("words") if known else word_count(text),
            "language_match": language_match(F.col("language"), F.col("original_language")),
        }
    )
    solid = measure("solid") if known else None
    return out.withColumn("avg_word_length", mean_word_length(text, F.col("word_count"), solid))


def content_quality(risk: Column, confidence: Column) -> Column:
    return (1 - risk) * confidence


def simplicity_ratio(confidence: Column, n_words: Column) -> Column:
    return confidence / (n_words + 1)


def spam_length_ratio(spam_prob: Column, length: Column) -> Column:
    return spam_prob / (length + 1)


def text_to_word_ratio(length: Column, n_words: Column) -> Column:
    return length / (n_words + 1)

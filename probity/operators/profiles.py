"""Group profiles of reviewers and businesses, and their way back to the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions.text import measure, measured


def _stats(stars: str) -> dict[str, Column]:
    return {
        "avg_rating": F.avg(stars),
        "rating_std": F.stddev_samp(stars),
        "min_rating": F.min(stars),
        "max_rating": F.max(stars),
    }


def reviewer_profile(
    df: DataFrame, key: str = "reviewer_id", stars: str = "stars", text: str = "text", with_risk: bool = False
) -> DataFrame:
    """Review count, star statistics, unique-text ratio and, on request, the risk profile.

    Texts are compared by 128-bit digest, so no text travels through the shuffle. They are counted in a pass of their own: in one with
    the statistics, each reviewer and text would carry a set of statistics through the shuffle.
    """
    texts = df.select(F.col(key).alias("_key"), F.md5(F.col(text)).alias("_digest")).distinct()
    texts = texts.groupBy("_key").agg(F.count("_digest").alias("_texts"))
    out: list[Column] = [F.count(F.lit(1)).alias("user_review_count")]
    out += [c.alias(f"user_{n}") for n, c in _stats(stars).items()]
    if with_risk:
        out += [
            F.avg("text_quality_risk").alias("user_avg_quality_risk"),
            F.max("text_quality_risk").alias("user_max_quality_risk"),
            F.stddev_samp("text_quality_risk").alias("user_std_quality_risk"),
            F.avg("text_confidence").alias("user_avg_confidence"),
            F.min("text_confidence").alias("user_min_confidence"),
            F.avg("text_spam_prob").alias("user_avg_spam_prob"),
        ]
    found = df.groupBy(key).agg(*out).join(texts, F.col(key).eqNullSafe(F.col("_key")))
    found = found.withColumn("user_unique_text_ratio", F.col("_texts") / F.col("user_review_count"))
    names = found.columns
    at = names.index("user_max_rating") + 1
    return found.select(*names[:at], "user_unique_text_ratio", *[n for n in names[at:] if n not in ("_key", "_texts", "user_unique_text_ratio")])


def business_profile(
    df: DataFrame, key: str = "place_id", stars: str = "stars", with_risk: bool = False
) -> DataFrame:
    stats = _stats(stars)
    out = [
        stats["avg_rating"].alias("business_avg_rating"),
        stats["rating_std"].alias("business_rating_std"),
        F.count(stars).alias("business_review_count"),
    ]
    if with_risk:
        out += [
            F.avg("text_quality_risk").alias("business_avg_quality_risk"),
            F.max("text_quality_risk").alias("business_max_quality_risk"),
            F.avg("text_spam_prob").alias("business_avg_spam_prob"),
        ]
    return df.groupBy(key).agg(*out)


def training_profile(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Count, mean and deviation of the rating and mean text length, missing values as 0."""
    prof = df.groupBy(key).agg(
        F.count("stars").cast("double").alias(f"{prefix}_rating_count"),
        F.avg("stars").alias(f"{prefix}_rating_mean"),
        F.stddev_samp("stars").alias(f"{prefix}_rating_std"),
        F.avg(F.coalesce(measure("length") if measured(df) else F.length("text"), F.lit(0))).alias(f"{prefix}_text_length_mean"),
    )
    return prof.na.fill(0.0)


def enrich(df: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """Left join of a profile (one row per key). Spark picks broadcast or sort-merge by size and splits skewed partitions at run time."""
    return df.join(profile, key, "left")


def deviation(value: Column, centre: Column) -> Column:
    return F.abs(value - centre)


def with_profiles(df: DataFrame, with_risk: bool = True) -> DataFrame:
    """Rows with both profiles and the deviations from them."""
    out = enrich(df, reviewer_profile(df, with_risk=with_risk), "reviewer_id")
    out = enrich(out, business_profile(df, with_risk=with_risk), "place_id")
    added = {
        "user_rating_deviation": deviation(F.col("stars"), F.col("user_avg_rating")),
        "business_rating_deviation": deviation(F.col("stars"), F.col("business_avg_rating")),
    }
    if with_risk:
        added["business_quality_risk_deviation"] = deviation(
            F.col("text_quality_risk"), F.col("business_avg_quality_risk")
        )
    return out.withColumns(added)

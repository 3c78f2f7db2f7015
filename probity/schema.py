"""Canonical table schemas. Later steps never guess columns; an absent optional column is a typed NULL."""

from __future__ import annotations

from pyspark.sql import types as T

REVIEW = T.StructType(
    [
        T.StructField("review_id", T.LongType()),
        T.StructField("reviewer_id", T.StringType()),
        T.StructField("place_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("stars", T.DoubleType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("language", T.StringType()),
        T.StructField("original_language", T.StringType()),
        T.StructField("review_image_urls", T.StringType()),
        T.StructField("reviewer_review_count", T.LongType()),
        T.StructField("is_local_guide", T.BooleanType()),
        T.StructField("likes_count", T.LongType()),
        T.StructField("business_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("reviewer_name", T.StringType()),
        T.StructField("helpful_votes", T.LongType()),
        T.StructField("total_votes", T.LongType()),
        T.StructField("verified_purchase", T.BooleanType()),
        T.StructField("location", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)

LABEL_ANSWERS = "array<struct<classification:string,confidence:double,reasoning:string>>"

RAW_LABEL_ANSWERS = "array<struct<classification:string,confidence:string,reasoning:string>>"

MODEL_RESPONSES = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("provider", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("response", T.StringType()),
    ]
)

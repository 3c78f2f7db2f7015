"""Sources, normalisation and table plumbing."""

from __future__ import annotations

from pyspark.sql import functions as F

from probity.operators import scoring as S
from probity.plans import reviews as P
from probity.plans.catalog.sql import sql
from probity.sources import normalise as N


def register(catalog):
    add = catalog.add

    @add("drop_missing_text", "S5", sql("reviews", "SELECT review_id FROM reviews WHERE text IS NOT NULL"))
    def _(spark, folder):
        return N.drop_missing_text(P.reviews(spark, folder)).select("review_id")

    @add("keep_real_text", "S6", sql("reviews", "SELECT review_id, CAST(length(text) AS INT) AS text_length FROM reviews WHERE length(trim(text)) > 0"))
    def _(spark, folder):
        return N.keep_real_text(P.reviews(spark, folder)).select("review_id", F.length("text").alias("text_length"))

    @add("first_rows", "S7", sql("reviews", "SELECT review_id, stars FROM reviews ORDER BY review_id LIMIT 50"))
    def _(spark, folder):
        return N.first_rows(P.reviews(spark, folder), 50).select("review_id", "stars")

    @add("seeded_sample", "S8")
    def _(spark, folder):
        return N.seeded_sample(P.reviews(spark, folder).select("review_id", "stars", "label"), 100)

    @add(
        "safe_casts",
        "S14 S15",
        sql(
            "reviews",
            """SELECT review_id, TRY_CAST(stars_raw AS DOUBLE) AS stars, epoch_us(TRY_CAST(published_raw AS TIMESTAMP)) AS published_micros FROM reviews""",
        ),
    )
    def _(spark, folder):
        df = P.reviews(spark, folder)
        return df.select(
            "review_id",
            N.number(F.col("stars_raw")).alias("stars"),
            F.unix_micros(N.timestamp(F.col("published_raw"))).alias("published_micros"),
        )

    @add(
        "column_aliases",
        "S16",
        sql(
            "reviews",
            """SELECT review_id, TRY_CAST(stars_raw AS DOUBLE) AS stars, epoch_us(TRY_CAST(published_raw AS TIMESTAMP)) AS published_micros, helpful_votes,
            CAST(length(text) AS INT) AS text_length, TRY_CAST(stars_raw AS DOUBLE) AS first_rating, 3.0::DOUBLE AS training_rating FROM reviews""",
        ),
    )
    def _(spark, folder):
        # A table with other people's column names.
        raw = P.reviews(spark, folder).select(
            "review_id", F.col("text").alias("review_text"), F.col("stars_raw").alias("star_rating"),
            F.col("published_raw").alias("created_at"), F.col("helpful_votes").alias("thumbs_up"),
        )
        out = N.to_reviews(raw.withColumn("first_rating", F.col("star_rating")))
        rating = N.rating_column(raw)
        extra = raw.select(F.col("review_id").alias("rid"), N.number(F.col(rating)).alias("first_rating"), N.training_rating(raw).alias("training_rating"))
        out = out.join(extra, out["review_id"] == extra["rid"])
        return out.select(
            "review_id", "stars", F.unix_micros("published_at").alias("published_micros"), "helpful_votes",
            F.length("text").alias("text_length"), "first_rating", "training_rating",
        )

    @add(
        "metadata_fill",
        "S17",
        sql(
            "reviews",
            """SELECT review_id, CASE WHEN place_id % 10 = 0 THEN 'unknown_business' ELSE category END AS place_id,
            CASE WHEN reviewer_id % 3 = 0 THEN 'user_' || CAST(i AS VARCHAR) ELSE CAST(reviewer_id AS VARCHAR) END AS reviewer_id,
            'review_' || CAST(i AS VARCHAR) AS review_key, epoch_us(coalesce(TRY_CAST(published_raw AS TIMESTAMP), TIMESTAMP '2024-01-01')) AS published_micros,
            10::BIGINT AS reviewer_review_count, false AS is_local_guide, 0::BIGINT AS likes_count
            FROM (SELECT *, row_number() OVER (ORDER BY review_id) - 1 AS i FROM reviews)""",
        ),
    )
    def _(spark, folder):
        raw = P.reviews(spark, folder).select(
            "review_id",
            F.when(F.col("reviewer_id") % 3 != 0, F.col("reviewer_id")).alias("reviewer_id"),
            F.when(F.col("place_id") % 10 != 0, F.col("category")).alias("business_name"),
            N.timestamp(F.col("published_raw")).alias("published_at"),
        )
        out = N.fill_metadata(N.with_row_ids(raw, F.col("review_id"), "review_id", "row_number"))
        return out.select(
            "review_id", "place_id", "reviewer_id", "review_key", F.unix_micros("published_at").alias("published_micros"),
            "reviewer_review_count", "is_local_guide", "likes_count",
        )

    @add(
        "scores_on_their_rows",
        "S19",
        sql("ruled", "SELECT review_id, stars, label, text_prediction, round(p_bad, 6) AS p_bad FROM ruled"),
    )
    def _(spark, folder):
        # Scores are columns of the same row; a score table made elsewhere comes back by key.
        rows = P.reviews(spark, folder)
        scores = S.rule_scores(rows).select("review_id", "text_prediction", F.round("p_bad", 6).alias("p_bad"))
        return rows.select("review_id", "stars", "label").join(scores, "review_id", "left")

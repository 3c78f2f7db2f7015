"""Temporal, profile and content features."""

from __future__ import annotations

from pyspark.sql import functions as F

from probity.functions import content as C
from probity.functions import temporal as D
from probity.functions.text import measure
from probity.operators import ordered as O
from probity.operators import profiles as G
from probity.operators import scoring as S
from probity.operators import windows as W
from probity.plans import reviews as P
from probity.plans.catalog.sql import sql
from probity.session import cut_lineage


def rolling_sql(days) -> str:
    cols, wins = [], []
    for d in days:
        cols.append(
            f"round(avg(stars) OVER w{d}, 6) AS rolling_{d}d_stars_mean, count(stars) OVER w{d} AS rolling_{d}d_stars_count, "
            f"round(stddev_samp(stars) OVER w{d}, 6) AS rolling_{d}d_stars_std, count(*) OVER w{d} AS rolling_{d}d_review_count"
        )
        wins.append(
            f"w{d} AS (PARTITION BY reviewer_id ORDER BY published_at RANGE BETWEEN INTERVAL {d} DAYS PRECEDING "
            "AND INTERVAL 1 MICROSECOND PRECEDING)"
        )
    return f"SELECT review_id, {', '.join(cols)} FROM reviews WINDOW {', '.join(wins)}"


def _rounded(df, names):
    return [F.round(n, 6).alias(n) if n.endswith(("mean", "std")) else F.col(n) for n in names]


RISKY = """risky AS (
SELECT review_id, reviewer_id, place_id, stars, text, p_bad AS risk, text_confidence AS conf,
  CASE WHEN text_prediction = 'spam' THEN text_confidence ELSE 0.1 END / (text_confidence + 0.6) AS spam FROM ruled)"""


def risky(spark, folder, stored=False):
    """Numbers only: the text is reduced to its digest before any shuffle by key."""
    df = S.text_features(S.rule_scores(P.reviews(spark, folder)))
    df = df.select(
        "review_id", "reviewer_id", "place_id", "stars", measure("digest").alias("text"),
        "text_quality_risk", "text_confidence", "text_spam_prob",
    )
    return cut_lineage(df) if stored else df


def register(catalog):
    add = catalog.add

    @add(
        "calendar_parts",
        "W1 W2 W3",
        sql(
            "reviews",
            """SELECT review_id, CAST(isodow(published_at) - 1 AS INT) AS review_day_of_week, CAST(hour(published_at) AS INT) AS review_hour_of_day,
            CAST(isodow(published_at) >= 6 AS INT) AS is_weekend FROM reviews""",
        ),
    )
    def _(spark, folder):
        ts = F.col("published_at")
        return P.reviews(spark, folder).select(
            "review_id",
            D.day_of_week(ts).alias("review_day_of_week"),
            D.hour_of_day(ts).alias("review_hour_of_day"),
            D.is_weekend(ts).alias("is_weekend"),
        )

    @add(
        "days_since_last_review",
        "W4 W9",
        sql(
            "reviews",
            """SELECT review_id, CAST(floor((epoch_us(published_at) - lag(epoch_us(published_at)) OVER (PARTITION BY reviewer_id
            ORDER BY published_at, review_id)) / 86400000000.0) AS BIGINT) AS days_since_last_review FROM reviews""",
        ),
    )
    def _(spark, folder):
        df = P.reviews(spark, folder).select("review_id", "reviewer_id", "published_at")
        return W.days_since_previous(df).select("review_id", "days_since_last_review")

    @add(
        "days_since_last_review_anywhere",
        "W5",
        sql(
            "reviews",
            """SELECT review_id, CAST(floor((epoch_us(published_at) - lag(epoch_us(published_at)) OVER (ORDER BY published_at, review_id))
            / 86400000000.0) AS BIGINT) AS days_since_last_review, epoch_us(published_at) - lag(epoch_us(published_at))
            OVER (ORDER BY published_at, review_id) AS gap_micros FROM reviews""",
        ),
    )
    def _(spark, folder):
        df = P.reviews(spark, folder).select("review_id", "published_at")
        here = D.micros(F.col("published_at"))
        gap = here - F.col("prev_micros")
        return O.gap_to_previous(df, here, "review_id").select(
            "review_id", D.whole_days(gap).alias("days_since_last_review"), gap.alias("gap_micros")
        )

    @add("rolling_stars", "W6 W8", sql("reviews", rolling_sql((7, 30))))
    def _(spark, folder):
        df = P.reviews(spark, folder).select("review_id", "reviewer_id", "published_at", "stars")
        names = [n for d in (7, 30) for n in W.rolling_names(d)]
        return W.rolling_stars(df).select("review_id", *_rounded(df, names))

    @add("rolling_stars_three_spans", "W7", sql("reviews", rolling_sql((7, 30, 90))))
    def _(spark, folder):
        from probity.constants import WINDOW_DAYS

        df = P.reviews(spark, folder).select("review_id", "reviewer_id", "published_at", "stars")
        days = tuple(WINDOW_DAYS.values())
        names = [n for d in days for n in W.rolling_names(d)]
        return W.rolling_stars(df, days=days).select("review_id", *_rounded(df, names))

    @add(
        "reviewer_profile",
        "G1 G2",
        sql(
            "reviews",
            """SELECT reviewer_id, count(*) AS user_review_count, round(avg(stars), 6) AS user_avg_rating,
            round(stddev_samp(stars), 6) AS user_rating_std, min(stars) AS user_min_rating, max(stars) AS user_max_rating,
            round(count(DISTINCT text) / CAST(count(*) AS DOUBLE), 6) AS user_unique_text_ratio FROM reviews GROUP BY reviewer_id""",
        ),
    )
    def _(spark, folder):
        p = G.reviewer_profile(P.reviews(spark, folder))
        return p.select(
            "reviewer_id", "user_review_count", "user_min_rating", "user_max_rating",
            *[F.round(c, 6).alias(c) for c in ("user_avg_rating", "user_rating_std", "user_unique_text_ratio")],
        )

    @add(
        "rating_deviation",
        "G3 G6 G9",
        sql(
            "reviews",
            """SELECT review_id, round(abs(stars - avg(stars) OVER (PARTITION BY reviewer_id)), 6) AS user_rating_deviation,
            round(abs(stars - avg(stars) OVER (PARTITION BY place_id)), 6) AS business_rating_deviation FROM reviews""",
        ),
    )
    def _(spark, folder):
        df = P.reviews(spark, folder).select("review_id", "reviewer_id", "place_id", "stars", measure("digest").alias("text"))
        out = G.with_profiles(df, with_risk=False)
        return out.select(
            "review_id",
            F.round("user_rating_deviation", 6).alias("user_rating_deviation"),
            F.round("business_rating_deviation", 6).alias("business_rating_deviation"),
        )

    @add(
        "reviewer_risk_profile",
        "G4",
        sql(
            "ruled",
            """SELECT reviewer_id, round(avg(risk), 6) AS user_avg_quality_risk, round(max(risk), 6) AS user_max_quality_risk,
            round(stddev_samp(risk), 6) AS user_std_quality_risk, round(avg(conf), 6) AS user_avg_confidence,
            round(min(conf), 6) AS user_min_confidence, round(avg(spam), 6) AS user_avg_spam_prob FROM risky GROUP BY reviewer_id""",
            RISKY,
        ),
    )
    def _(spark, folder):
        p = G.reviewer_profile(risky(spark, folder), with_risk=True)
        names = [
            "user_avg_quality_risk", "user_max_quality_risk", "user_std_quality_risk", "user_avg_confidence",
            "user_min_confidence", "user_avg_spam_prob",
        ]
        return p.select("reviewer_id", *[F.round(c, 6).alias(c) for c in names])

    @add(
        "business_profile",
        "G5 G7",
        sql(
            "ruled",
            """SELECT place_id, round(avg(stars), 6) AS business_avg_rating, round(stddev_samp(stars), 6) AS business_rating_std,
            count(stars) AS business_review_count, round(avg(risk), 6) AS business_avg_quality_risk,
            round(max(risk), 6) AS business_max_quality_risk, round(avg(spam), 6) AS business_avg_spam_prob
            FROM risky GROUP BY place_id""",
            RISKY,
        ),
    )
    def _(spark, folder):
        p = G.business_profile(risky(spark, folder), with_risk=True)
        names = [c for c in p.columns if c not in ("place_id", "business_review_count")]
        return p.select("place_id", "business_review_count", *[F.round(c, 6).alias(c) for c in names])

    @add(
        "business_risk_deviation",
        "G8 G9",
        sql(
            "ruled",
            "SELECT review_id, round(abs(risk - avg(risk) OVER (PARTITION BY place_id)), 6) AS business_quality_risk_deviation FROM risky",
            RISKY,
        ),
    )
    def _(spark, folder):
        df = risky(spark, folder, stored=True)  # the rows meet a profile made of themselves
        out = G.enrich(df, G.business_profile(df, with_risk=True), "place_id")
        dev = G.deviation(F.col("text_quality_risk"), F.col("business_avg_quality_risk"))
        return out.select("review_id", F.round(dev, 6).alias("business_quality_risk_deviation"))

    @add(
        "training_profile",
        "G10",
        sql(
            "reviews",
            """SELECT reviewer_id, CAST(count(stars) AS DOUBLE) AS reviewer_rating_count, round(coalesce(avg(stars), 0), 6) AS reviewer_rating_mean,
            round(coalesce(stddev_samp(stars), 0), 6) AS reviewer_rating_std, round(avg(length(coalesce(text, ''))), 6) AS reviewer_text_length_mean
            FROM reviews GROUP BY reviewer_id""",
        ),
    )
    def _(spark, folder):
        p = G.training_profile(P.reviews(spark, folder), "reviewer_id", "reviewer")
        return p.select("reviewer_id", *[F.round(c, 6).alias(c) for c in p.columns[1:]])

    @add(
        "content_features",
        "C1 C2 C3 C4 C5 C6",
        sql(
            "reviews",
            """SELECT review_id, CAST(review_image_urls IS NOT NULL AS INT) AS has_image,
            CAST(CASE WHEN starts_with(review_image_urls, '[') THEN json_array_length(review_image_urls) ELSE 0 END AS INT) AS image_count,
            CAST(length(text) AS INT) AS text_length, CAST(len(w) AS INT) AS word_count,
            round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / CAST(len(w) AS DOUBLE)
                 WHEN text IS NOT NULL THEN 0 END, 6) AS avg_word_length,
            CAST(coalesce(language = original_language, false) AS INT) AS language_match
            FROM (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM reviews)""",
        ),
    )
    def _(spark, folder):
        df = C.with_content(P.reviews(spark, folder))
        return df.select(
            "review_id", "has_image", "image_count", "text_length", "word_count",
            F.round("avg_word_length", 6).alias("avg_word_length"), "language_match",
        )

    words = "len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))"

    @add(
        "content_risk_features",
        "C7 C8 C9 C10",
        sql(
            "ruled",
            f"""SELECT review_id, round((1 - p_bad) * text_confidence, 6) AS content_quality_score,
            round(text_confidence / (n + 1), 6) AS simplicity_confidence_ratio, round(spam / (length(text) + 1), 8) AS spam_length_ratio,
            round(length(text) / CAST(n + 1 AS DOUBLE), 6) AS text_to_word_ratio, round(text_confidence * relevancy, 6) AS confidence_relevancy,
            round(spam + ad, 6) AS spam_signal FROM (SELECT *, {words} AS n,
              CASE WHEN text_prediction = 'spam' THEN text_confidence ELSE 0.1 END / (text_confidence + 0.6) AS spam,
              CASE WHEN text_prediction = 'advertisement' THEN text_confidence ELSE 0.1 END / (text_confidence + 0.6) AS ad FROM ruled)""",
        ),
    )
    def _(spark, folder):
        df = C.with_content(S.text_features(S.rule_scores(P.reviews(spark, folder))))
        conf, n, length = F.col("text_confidence"), F.col("word_count"), F.col("text_length")
        return df.select(
            "review_id",
            F.round(C.content_quality(F.col("text_quality_risk"), conf), 6).alias("content_quality_score"),
            F.round(C.simplicity_ratio(conf, n), 6).alias("simplicity_confidence_ratio"),
            F.round(C.spam_length_ratio(F.col("text_spam_prob"), length), 8).alias("spam_length_ratio"),
            F.round(C.text_to_word_ratio(length, n), 6).alias("text_to_word_ratio"),
            F.round(conf * F.col("relevancy"), 6).alias("confidence_relevancy"),
            F.round(F.col("text_spam_prob") + F.col("text_ad_prob"), 6).alias("spam_signal"),
        )

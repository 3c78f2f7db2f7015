"""Anomaly stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from probity.functions import risk as R
from probity.functions.text import measure
from probity.operators import anomaly as A
from probity.operators import iforest as I
from probity.operators import scoring as S
from probity.plans import reviews as P
from probity.plans.catalog.sql import sql
from probity.session import cut_lineage

WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))"

FEAT = f"""feat AS (
SELECT *, abs(stars - user_avg_rating) AS user_rating_deviation, abs(stars - business_avg_rating) AS business_rating_deviation,
  abs(text_quality_risk - business_avg_quality_risk) AS business_quality_risk_deviation
FROM (SELECT *,
  CAST(floor((epoch_us(published_at) - lag(epoch_us(published_at)) OVER (PARTITION BY reviewer_id ORDER BY published_at, review_id))
     / 86400000000.0) AS BIGINT) AS days_since_last_review,
  avg(stars) OVER w7 AS rolling_7d_stars_mean, count(stars) OVER w7 AS rolling_7d_stars_count,
  avg(stars) OVER w30 AS rolling_30d_stars_mean, count(stars) OVER w30 AS rolling_30d_stars_count,
  count(*) OVER u AS user_review_count, avg(stars) OVER u AS user_avg_rating, stddev_samp(stars) OVER u AS user_rating_std,
  min(stars) OVER u AS user_min_rating, max(stars) OVER u AS user_max_rating,
  count(DISTINCT text) OVER u / CAST(count(*) OVER u AS DOUBLE) AS user_unique_text_ratio,
  avg(text_quality_risk) OVER u AS user_avg_quality_risk, max(text_quality_risk) OVER u AS user_max_quality_risk,
  avg(text_spam_prob) OVER u AS user_avg_spam_prob,
  avg(stars) OVER b AS business_avg_rating, stddev_samp(stars) OVER b AS business_rating_std, count(stars) OVER b AS business_review_count,
  avg(text_quality_risk) OVER b AS business_avg_quality_risk
FROM (SELECT review_id, reviewer_id, place_id, published_at, stars, text,
  CAST(isodow(published_at) - 1 AS INT) AS review_day_of_week, CAST(hour(published_at) AS INT) AS review_hour_of_day,
  CAST(isodow(published_at) >= 6 AS INT) AS is_weekend,
  CAST(review_image_urls IS NOT NULL AS INT) AS has_image,
  CAST(CASE WHEN starts_with(review_image_urls, '[') THEN json_array_length(review_image_urls) ELSE 0 END AS INT) AS image_count,
  CAST(length(text) AS INT) AS text_length, CAST(coalesce(language = original_language, false) AS INT) AS language_match,
  text_confidence, p_bad AS text_quality_risk, 1 - p_bad AS text_high_quality_score,
  (1 - p_bad) * text_confidence AS text_weighted_quality, p_bad * text_confidence AS text_weighted_risk,
  CASE WHEN text_prediction = 'spam' THEN text_confidence ELSE 0.1 END / (text_confidence + 0.6) AS text_spam_prob,
  CASE WHEN text_prediction = 'advertisement' THEN text_confidence ELSE 0.1 END / (text_confidence + 0.6) AS text_ad_prob,
  (1 - p_bad) * text_confidence AS content_quality_score, text_confidence / ({WORDS} + 1) AS simplicity_confidence_ratio,
  CASE WHEN text_prediction = 'spam' THEN text_confidence ELSE 0.1 END / (text_confidence + 0.6) / (length(text) + 1) AS spam_length_ratio
  FROM ruled)
WINDOW u AS (PARTITION BY reviewer_id), b AS (PARTITION BY place_id),
  w7 AS (PARTITION BY reviewer_id ORDER BY published_at RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
  w30 AS (PARTITION BY reviewer_id ORDER BY published_at RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)
))"""

FEATURES = A.all_features(A.EXTENDED)
ZED = (
    "zed AS (SELECT feat.*, "
    + ", ".join(f"abs({f} - m_{f}) / (s_{f} + 1e-6) AS {f}_anomaly" for f in FEATURES)
    + " FROM feat CROSS JOIN (SELECT "
    + ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in FEATURES)
    + " FROM feat))"
)


def _cat_max(cats):
    return ", ".join(
        f"greatest({', '.join(f + '_anomaly' for f in fs)}) AS {c}_max" for c, fs in cats.items()
    )


def register(catalog):
    add = catalog.add
    cats = A.CATEGORIES

    @add(
        "z_anomaly",
        "A1 A2",
        sql("ruled", "SELECT review_id, " + ", ".join(f"round({f}_anomaly, 4) AS {f}_anomaly" for f in FEATURES) + " FROM zed", FEAT, ZED),
    )
    def _(spark, folder):
        df = P.feature_table(spark, folder)
        names = A.all_features(A.resolve(df))
        z = A.z_scores(df, names)
        return z.select("review_id", *[F.round(f"{f}_anomaly", 4).alias(f"{f}_anomaly") for f in names])

    body = " UNION ALL ".join(
        f"""SELECT '{c}' AS category, round(avg({c}_max), 6) AS anomaly_score, count(*) FILTER (WHERE {c}_max > 3) AS anomaly_count,
        {len(fs)} AS feature_count FROM topz"""
        for c, fs in cats.items()
    )

    @add("category_summary", "A3", sql("ruled", body, FEAT, ZED, f"topz AS (SELECT {_cat_max(cats)} FROM zed)"))
    def _(spark, folder):
        df = P.feature_table(spark, folder)
        z = A.z_scores(df, A.all_features(cats))
        return A.category_summary(z).withColumn("anomaly_score", F.round("anomaly_score", 6))

    body = " UNION ALL ".join(
        f"""SELECT '{f}_anomaly' AS feature, round(max(score), 4) AS max_score FROM (SELECT {f}_anomaly AS score FROM zed)
        HAVING max(score) IS NOT NULL"""
        for f in FEATURES
    )

    @add("top_row_per_feature", "A4", sql("ruled", body, FEAT, ZED))
    def _(spark, folder):
        df = P.feature_table(spark, folder)
        names = A.all_features(A.resolve(df))
        top = A.top_per_feature(A.z_scores(df, names), names)
        return top.select("feature", F.round("max_score", 4).alias("max_score"))

    picked = [
        "text_length", "review_hour_of_day", "rolling_7d_stars_count", "spam_length_ratio", "image_count",
        "days_since_last_review",
    ]
    body = " UNION ALL ".join(
        f"""SELECT '{f}_anomaly' AS feature, round(arg_max(score, (score, -review_id)), 4) AS max_score,
        arg_max(review_id, (score, -review_id)) AS review_id, arg_max(reviewer_id, (score, -review_id)) AS reviewer_id,
        arg_max(place_id, (score, -review_id)) AS place_id, round(arg_max(text_quality_risk, (score, -review_id)), 6) AS quality_risk
        FROM (SELECT *, {f}_anomaly AS score FROM zed) WHERE score IS NOT NULL"""
        for f in picked
    )

    @add("top_row_with_ids", "A4", sql("ruled", body, FEAT, ZED))
    def _(spark, folder):
        z = A.z_scores(P.feature_table(spark, folder), picked)
        top = A.top_per_feature(z, picked)
        return top.withColumns(
            {"max_score": F.round("max_score", 4), "quality_risk": F.round("quality_risk", 6)}
        )

    @add(
        "clean_inputs",
        "A6 A17",
        sql(
            "reviews",
            """SELECT review_id, coalesce(stars, 0) AS stars, CAST(coalesce(length(text), 0) AS DOUBLE) AS text_length,
            CAST(CASE WHEN review_id % 7 = 0 THEN 0 ELSE logit0 / (review_id % 7) END AS DOUBLE) AS ratio, 0.0::DOUBLE AS never_seen FROM reviews""",
        ),
    )
    def _(spark, folder):
        df = P.reviews(spark, folder)
        part = F.col("review_id") % 7
        # 1/0, -1/0 and 0/0 as a source may deliver them.
        odd = F.when(part == 0, F.element_at(F.array(F.lit(float("inf")), F.lit(float("-inf")), F.lit(float("nan"))), (F.col("review_id") % 3 + 1).cast("int")))
        df = df.select(
            "review_id", "stars", measure("length").alias("text_length"),
            F.coalesce(odd, F.try_divide(F.col("logit0"), part)).alias("ratio"),
        )
        return A.filled(df, ["stars", "text_length", "ratio", "never_seen"])

    @add(
        "standard_scale",
        "A7",
        sql(
            "reviews",
            """SELECT review_id, round((stars - avg(stars) OVER ()) / stddev_pop(stars) OVER (), 6) AS stars_scaled,
            round((logit0 - avg(logit0) OVER ()) / stddev_pop(logit0) OVER (), 6) AS logit0_scaled FROM reviews""",
        ),
    )
    def _(spark, folder):
        df = A.standardise(P.reviews(spark, folder).select("review_id", "stars", "logit0"), ["stars", "logit0"])
        return df.select("review_id", *[F.round(c, 6).alias(c) for c in ("stars_scaled", "logit0_scaled")])

    def forest_input(spark, folder):
        df = P.feature_table(spark, folder)
        names = A.model_features(df)
        return A.filled(df, names).select("review_id", "reviewer_id", "place_id", *names), names

    @add("isolation_forest", "A5 A8 A9 A13")
    def _(spark, folder):
        df, names = forest_input(spark, folder)
        model = I.IsolationForest(names).fit(df)
        out = model.detect(df)
        return out.select(
            "review_id", "ml_anomaly", F.round("ml_anomaly_score", 6).alias("ml_anomaly_score"),
            F.round(I.stage_probability(F.col("ml_anomaly_score_centred")), 6).alias("metadata_probability"),
        )

    @add("isolation_forest_simple", "A8 A9 A10")
    def _(spark, folder):
        df = P.reviews(spark, folder).select(
            "review_id", "stars", F.hour("published_at").alias("hour_of_day"), F.weekday("published_at").alias("day_of_week"),
            measure("length").alias("text_length"),
        )
        names = ["stars", "hour_of_day", "day_of_week", "text_length"]
        df = cut_lineage(A.standardise(A.filled(cut_lineage(df), names), names))
        scaled = [f"{n}_scaled" for n in names]
        model = I.IsolationForest(scaled, trees=100, contamination=0.1).fit(df)
        return A.anomaly_summary(model.detect(df), scaled)

    @add(
        "contamination_cut",
        "A9 A10",
        sql(
            "reviews",
            """SELECT sum(flag)::BIGINT AS anomaly_count, round(avg(flag), 6) AS anomaly_rate FROM
            (SELECT CAST(logit0 > (SELECT quantile_disc(logit0, 0.92) FROM reviews) AS INT) AS flag FROM reviews)""",
        ),
    )
    def _(spark, folder):
        df = A.flag_share(P.reviews(spark, folder).select("review_id", "logit0"), "logit0", 0.08)
        return A.anomaly_summary(df, ["logit0"]).select("anomaly_count", F.round("anomaly_rate", 6).alias("anomaly_rate"))

    @add(
        "top_flagged_features",
        "A11",
        sql(
            "tested",
            "SELECT feature, round(importance, 6) AS importance FROM ("
            + " UNION ALL ".join(
                f"SELECT '{z}' AS feature, abs(avg({z})) AS importance FROM tested WHERE metadata_is_anomaly"
                for z in [*P.LOGITS, "stars", "enhanced_prob", "relevancy", "p_bad", "text_confidence"]
            )
            + ") ORDER BY importance DESC, feature LIMIT 10",
        ),
    )
    def _(spark, folder):
        df = P.tested(spark, folder).withColumn("ml_anomaly", F.col("metadata_is_anomaly").cast("int"))
        out = A.top_features(df, [*P.LOGITS, "stars", "enhanced_prob", "relevancy", "p_bad", "text_confidence"])
        return out.withColumn("importance", F.round("importance", 6))

    @add(
        "top_anomalies",
        "A12",
        sql(
            "ruled",
            "SELECT review_id, reviewer_id, score, round(p_bad, 6) AS quality_risk FROM (SELECT *, round(logit0 + logit1 + logit2, 6) AS score FROM ruled) ORDER BY score DESC, review_id LIMIT 5",
        ),
    )
    def _(spark, folder):
        df = S.rule_scores(P.reviews(spark, folder)).withColumn("score", F.round(F.expr("logit0 + logit1 + logit2"), 6))
        return A.top_anomalies(df, "score").select("review_id", "reviewer_id", "score", F.round("p_bad", 6).alias("quality_risk"))

    @add(
        "score_to_probability",
        "A13 A15 A16 A20",
        sql(
            "reviews",
            """SELECT review_id, round((s + 1) / 2, 6) AS probability, CASE WHEN p < 0.3 THEN 'low' WHEN p < 0.7 THEN 'medium' ELSE 'high' END AS risk_level,
            CASE WHEN p > 0.7 THEN 'high' WHEN p > 0.4 THEN 'medium' ELSE 'low' END AS display_level,
            round(coalesce(CASE WHEN review_id % 4 <> 0 THEN (s + 1) / 2 END, 0.5), 6) AS with_neutral
            FROM (SELECT review_id, enhanced_prob * 2 - 1 AS s, enhanced_prob AS p FROM reviews)""",
        ),
    )
    def _(spark, folder):
        df = P.reviews(spark, folder)
        p = R.to_probability(F.col("enhanced_prob") * 2 - 1)
        return df.select(
            "review_id",
            F.round(p, 6).alias("probability"),
            R.risk_level(F.col("enhanced_prob")).alias("risk_level"),
            R.display_risk_level(F.col("enhanced_prob")).alias("display_level"),
            F.round(A.neutral_if_missing(F.when(F.col("review_id") % 4 != 0, p)), 6).alias("with_neutral"),
        )

    @add(
        "extreme_rating_rule",
        "A14",
        sql(
            "reviews",
            """SELECT review_id, CASE WHEN stars <= 1 OR stars >= 5 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS metadata_anomaly_score,
            coalesce(stars <= 1 OR stars >= 5, false) AS metadata_is_anomaly,
            CASE WHEN stars <= 1 OR stars >= 5 THEN 'high' ELSE 'medium' END AS metadata_risk_level FROM reviews""",
        ),
    )
    def _(spark, folder):
        df = P.reviews(spark, folder).withColumns(R.rating_rule(F.col("stars")))
        return df.select("review_id", "metadata_anomaly_score", "metadata_is_anomaly", "metadata_risk_level")

    flags = ", ".join(
        f"CAST(coalesce(greatest({', '.join(f + '_anomaly' for f in fs)}) > 0.6, false) AS INT) AS {c}_flag"
        for c, fs in cats.items()
    )

    @add("category_flags", "A18", sql("ruled", f"SELECT review_id, {flags} FROM zed", FEAT, ZED))
    def _(spark, folder):
        z = A.z_scores(P.feature_table(spark, folder), A.all_features(cats))
        return A.category_flags(z, cats).select("review_id", *[f"{c}_flag" for c in cats])

    @add(
        "text_score_summary",
        "A19",
        sql(
            "ruled",
            """SELECT text_prediction, count(*) AS n, round(avg(text_confidence), 6) AS avg_confidence, round(avg(p_bad), 6) AS avg_quality_risk,
            count(*) FILTER (WHERE p_bad > 0.7) AS high_risk FROM ruled GROUP BY text_prediction""",
        ),
    )
    def _(spark, folder):
        out = A.text_summary(S.rule_scores(P.reviews(spark, folder)))
        return out.withColumns({c: F.round(c, 6) for c in ("avg_confidence", "avg_quality_risk")})

"""Fusion scores, decisions and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from probity import constants as K
from probity.functions import risk as R
from probity.functions.text import measure
from probity.operators import decide as D
from probity.operators import fusion as M

from probity.plans import reviews as P
from probity.plans.catalog.sql import sql

FUSED = """SELECT review_id, round(p_bad, 6) AS f_p_bad, round(enhanced_prob, 6) AS f_enhanced_prob, round(relevancy, 6) AS f_relevancy,
CAST(is_relevant AS DOUBLE) AS f_is_relevant, round(confidence, 6) AS f_confidence, round(enhanced_prob, 6) AS f_ensemble_prob,
round(p2, 6) AS f_p_spam, round(p3, 6) AS f_p_advertisement, round(p4, 6) AS f_p_irrelevant, round(p5, 6) AS f_p_fake_rant,
round(p6, 6) AS f_p_inappropriate, round(p_bad * p_bad, 6) AS f_p_bad_sq, round(enhanced_prob * enhanced_prob, 6) AS f_enhanced_prob_sq,
round(relevancy * relevancy, 6) AS f_relevancy_sq, round(p_bad * enhanced_prob, 6) AS f_p_bad_x_enhanced,
round(p_bad * relevancy, 6) AS f_p_bad_x_relevancy, round(enhanced_prob * relevancy, 6) AS f_enhanced_x_relevancy,
round(p_bad * confidence, 6) AS f_p_bad_x_confidence, round(enhanced_prob * confidence, 6) AS f_enhanced_x_confidence,
round(CASE WHEN is_relevant THEN 0 ELSE 2 * (1 - relevancy) END, 6) AS f_irrelevance_penalty FROM probs"""


def decided(spark, folder):
    df = P.with_logits(spark, folder)
    return df.withColumn("decision_probs", R.decision_probs(F.col("probs")))


def cascade(spam, genuine, low):
    return f"""CASE WHEN d_spam >= {spam} THEN 'high-confidence-spam' WHEN d_genuine >= {genuine} THEN 'genuine'
    WHEN d_low >= {low} THEN 'low-quality' ELSE 'suspicious' END"""


def cascade_conf(spam, genuine, low):
    return f"""CASE WHEN d_spam >= {spam} THEN d_spam WHEN d_genuine >= {genuine} THEN d_genuine
    WHEN d_low >= {low} THEN d_low ELSE d_suspicious END"""


ROUTED = """CASE {d} WHEN 'genuine' THEN 'automatic-approval' WHEN 'high-confidence-spam' THEN 'automatic-rejection'
ELSE 'requires-manual-verification' END"""

ARGMAX = """CASE greatest(d_genuine, d_suspicious, d_low, d_spam) WHEN d_genuine THEN 'genuine' WHEN d_suspicious THEN 'suspicious'
WHEN d_low THEN 'low-quality' ELSE 'high-confidence-spam' END"""


def tiers(cuts, col="risk"):
    a, b, c = cuts
    return f"CASE WHEN {col} < {a} THEN 'genuine' WHEN {col} < {b} THEN 'low_risk' WHEN {col} < {c} THEN 'medium_risk' ELSE 'high_risk' END"


def register(catalog):
    add = catalog.add

    @add("fusion_features", "F1", sql("probs", FUSED))
    def _(spark, folder):
        df = M.with_fusion_features(P.with_logits(spark, folder))
        return df.select("review_id", *[F.round(c, 6).alias(c) for c in M.FEATURE_COLUMNS])

    @add(
        "decision_codes",
        "F2 F22 F23",
        sql(
            "served",
            """SELECT review_id, final_prediction AS serving_decision, CASE final_prediction WHEN 'suspicious' THEN 1 WHEN 'low-quality' THEN 2
            WHEN 'high-confidence-spam' THEN 3 ELSE 0 END AS code, final_prediction AS code_back,
            CASE WHEN label IN ('genuine_positive','genuine_negative') THEN 'genuine' WHEN label IN ('spam','advertisement','inappropriate')
              THEN 'high-confidence-spam' WHEN label = 'irrelevant' THEN 'low-quality' ELSE 'suspicious' END AS truth_decision FROM served""",
        ),
    )
    def _(spark, folder):
        df = P.served(spark, folder).withColumn("code", R.decision_code(F.col("final_prediction")))
        return df.select(
            "review_id",
            F.col("final_prediction").alias("serving_decision"),
            "code",
            R.decision_name(F.col("code")).alias("code_back"),
            R.truth_decision(F.col("label")).alias("truth_decision"),
        )

    @add(
        "leading_split",
        "F3",
        sql(
            "reviews",
            """SELECT review_id, rn <= floor(n * 0.8) AS is_train FROM (SELECT review_id, row_number() OVER (ORDER BY published_at, review_id) AS rn,
            count(*) OVER () AS n FROM reviews)""",
        ),
    )
    def _(spark, folder):
        df = P.reviews(spark, folder).select("review_id", "published_at")
        return M.leading_split(df, F.unix_micros("published_at"), "review_id").select("review_id", "is_train")

    @add(
        "argmax_decision",
        "F12 F14",
        sql(
            "probs",
            f"""SELECT review_id, {ARGMAX} AS final_prediction, round(greatest(d_genuine, d_suspicious, d_low, d_spam), 6) AS final_confidence,
            round(d_spam, 6) AS fusion_score, {ROUTED.format(d=ARGMAX)} AS routing_decision FROM probs""",
        ),
    )
    def _(spark, folder):
        df = decided(spark, folder).withColumns(R.argmax_decision(F.col("decision_probs")))
        return df.select(
            "review_id", "final_prediction", F.round("final_confidence", 6).alias("final_confidence"),
            F.round("fusion_score", 6).alias("fusion_score"), R.route(F.col("final_prediction")).alias("routing_decision"),
        )

    @add(
        "threshold_decision",
        "F13 F14 F15",
        sql(
            "probs",
            f"""SELECT *, CASE routing_decision WHEN 'automatic-approval' THEN 'This review can be automatically approved for publication.'
              WHEN 'automatic-rejection' THEN 'This review should be automatically rejected.'
              ELSE 'This review requires human verification before publication.' END AS routing_description
            FROM (SELECT *, {ROUTED.format(d='final_prediction')} AS routing_decision FROM (SELECT review_id,
            {cascade(.35, .25, .15)} AS final_prediction, round({cascade_conf(.35, .25, .15)}, 6) AS final_confidence FROM probs))""",
        ),
    )
    def _(spark, folder):
        df = decided(spark, folder).withColumns(R.threshold_decision(F.col("decision_probs")))
        df = df.withColumn("routing_decision", R.route(F.col("final_prediction")))
        return df.select(
            "review_id", "final_prediction", F.round("final_confidence", 6).alias("final_confidence"), "routing_decision",
            R.route_description(F.col("routing_decision")).alias("routing_description"),
        )

    @add(
        "threshold_settings",
        "F13",
        sql(
            "probs",
            "SELECT review_id, " + ", ".join(f"{cascade(*v)} AS {k}" for k, v in K.DECISION_THRESHOLDS.items()) + " FROM probs",
        ),
    )
    def _(spark, folder):
        df = decided(spark, folder)
        return df.select(
            "review_id",
            *[
                R.threshold_decision(F.col("decision_probs"), *v)["final_prediction"].alias(k)
                for k, v in K.DECISION_THRESHOLDS.items()
            ],
        )

    @add(
        "fusion_training_table",
        "F17",
        sql(
            "probs",
            f"""SELECT review_id, round(p_bad, 6) AS stage1_p_bad, round(enhanced_prob, 6) AS stage2_enhanced_prob, round(relevancy, 6) AS stage3_relevancy,
            CAST(is_relevant AS INT) AS stage3_relevant, round(confidence, 6) AS stage1_confidence, {cascade(.35, .25, .15)} AS final_prediction,
            CASE {cascade(.35, .25, .15)} WHEN 'suspicious' THEN 1 WHEN 'low-quality' THEN 2 WHEN 'high-confidence-spam' THEN 3 ELSE 0 END AS final_code
            FROM probs""",
        ),
    )
    def _(spark, folder):
        df = decided(spark, folder).withColumns(R.threshold_decision(F.col("decision_probs")))
        out = M.training_table(df.withColumn("final_code", R.decision_code(F.col("final_prediction"))))
        return out.withColumns(
            {c: F.round(c, 6) for c in ("stage1_p_bad", "stage2_enhanced_prob", "stage3_relevancy", "stage1_confidence")}
        )

    @add(
        "weighted_fusion",
        "F18 F19 F20",
        sql(
            "tested",
            """SELECT review_id, round(risk, 6) AS fusion_risk_score, tier AS fusion_prediction, round(tier_confidence, 6) AS fusion_confidence FROM tested""",
        ),
    )
    def _(spark, folder):
        return P.tested(spark, folder).select(
            "review_id", F.round("fusion_risk_score", 6).alias("fusion_risk_score"), "fusion_prediction",
            F.round("fusion_confidence", 6).alias("fusion_confidence"),
        )

    @add(
        "tier_presets",
        "F21",
        sql("tested", "SELECT review_id, " + ", ".join(f"{tiers(v)} AS {k}" for k, v in K.TIER_PRESETS.items()) + " FROM tested"),
    )
    def _(spark, folder):
        df = P.tested(spark, folder)
        return df.select("review_id", *[R.tier(F.col("fusion_risk_score"), v).alias(k) for k, v in K.TIER_PRESETS.items()])

    @add(
        "serving_score",
        "F24 F14 F15",
        sql(
            "served",
            """SELECT review_id, text_prediction, final_prediction, final_confidence, round(fusion_score, 6) AS fusion_score,
            0.3::DOUBLE AS metadata_anomaly_score, routing_decision FROM served""",
        ),
    )
    def _(spark, folder):
        return P.served(spark, folder).select(
            "review_id", "text_prediction", "final_prediction", "final_confidence",
            F.round("fusion_score", 6).alias("fusion_score"), "metadata_anomaly_score", "routing_decision",
        )

    @add(
        "combined_spam_score",
        "F25",
        sql("tested", "SELECT review_id, round(p_bad * text_confidence * 0.6 + metadata_anomaly_score * 0.4, 6) AS final_spam_score FROM tested"),
    )
    def _(spark, folder):
        df = P.tested(spark, folder)
        s = R.combined_spam_score(F.col("p_bad"), F.col("text_confidence"), F.col("metadata_anomaly_score"))
        return df.select("review_id", F.round(s, 6).alias("final_spam_score"))

    @add(
        "moderation_rules",
        "F26",
        sql(
            "probs",
            """SELECT review_id, CAST(confidence > 0.8 AND p_bad > 0.7 AS INT) AS flag_for_review,
            CAST(ur > 0.5 AND odd AS INT) AS investigate_user, CAST(br > 0.7 AS INT) AS alert_business
            FROM (SELECT *, coalesce(stars <= 1 OR stars >= 5, false) AS odd, avg(p_bad) OVER (PARTITION BY reviewer_id) AS ur,
            avg(p_bad) OVER (PARTITION BY place_id) AS br FROM probs)""",
        ),
    )
    def _(spark, folder):
        df = P.with_logits(spark, folder).withColumns(R.rating_rule(F.col("stars")))
        out = D.moderation_flags(df, alert=0.7)
        return out.select("review_id", "flag_for_review", "investigate_user", "alert_business")

    @add(
        "fusion_input_fill",
        "F27 F28",
        sql(
            "tested",
            """SELECT review_id, round(coalesce(CASE WHEN text IS NOT NULL THEN p_bad END, 0.5), 6) AS quality_risk,
            coalesce(CASE WHEN text IS NOT NULL THEN text_confidence END, 0.5) AS confidence,
            CASE WHEN stars IS NULL THEN 0.5 ELSE metadata_anomaly_score END AS anomaly_score, 0.5::DOUBLE AS relevancy, true AS is_relevant FROM tested""",
        ),
    )
    def _(spark, folder):
        df = P.tested(spark, folder)
        known = measure("length").isNotNull()
        df = df.select(
            "review_id",
            F.when(known, F.round("p_bad", 6)).alias("quality_risk"),
            F.when(known, F.col("text_confidence")).alias("confidence"),
            F.when(F.col("stars").isNotNull(), F.col("metadata_anomaly_score")).alias("anomaly_score"),
            F.lit(None).cast("double").alias("relevancy"),
            F.lit(None).cast("boolean").alias("is_relevant"),
        )
        return df.na.fill(0.5, ["quality_risk", "confidence", "anomaly_score", "relevancy"]).na.fill(True, ["is_relevant"])

    @add("training_targets", "F29")
    def _(spark, folder):
        df = P.reviews(spark, folder).filter("label IS NOT NULL")
        target = M.target_decision(F.col("label"), F.col("review_id"))
        return df.groupBy("label", target.alias("decision")).agg(F.count(F.lit(1)).alias("n"))

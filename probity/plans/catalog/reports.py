"""Summaries, reports and dashboard tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.constants import RECOMMEND_HIGH_RISK, RECOMMEND_LOW_RISK, RECOMMEND_MEAN_RISK, TEXT_CLASSES, TIERS
from probity.functions.text import measure
from probity.operators import anomaly as A
from probity.operators import metrics as E
from probity.operators import reports as B
from probity.operators import scoring as S
from probity.plans import reviews as P
from probity.plans.catalog.sql import sql
from probity.session import checkpoint_dir, cut_lineage, delete, shuffles_go
from probity.sources.readers import read_many
from probity.sources.sinks import write_csv

BATCH = """batch AS (SELECT *, text IS NULL AS is_error FROM served)"""


def batch(spark, folder):
    return P.served(spark, folder).withColumn("is_error", measure("length").isNull())


def r6(df, names):
    return df.withColumns({n: F.round(n, 6) for n in names})


VIOLATION = """violated AS (SELECT *, unnest(list_filter([CASE text_prediction WHEN 'advertisement' THEN 'Advertisement' WHEN 'spam' THEN 'Spam Content'
  WHEN 'irrelevant' THEN 'Irrelevant' WHEN 'inappropriate' THEN 'Inappropriate' END, CASE WHEN p_bad > 0.7 THEN 'High Risk Score' END],
  lambda x: x IS NOT NULL)) AS violation FROM served)"""


def register(catalog):
    add = catalog.add

    @add(
        "batch_summary",
        "R1 R30",
        sql(
            "served",
            """SELECT total, processed, genuine, suspicious, low_quality, spam, errors, round(avg_confidence, 6) AS avg_confidence, round(avg_risk_score, 6) AS avg_risk_score,
            round(genuine * 100.0::DOUBLE / processed, 1) AS genuine_percentage, processed - genuine AS flagged_count,
            round((processed - genuine) * 100.0::DOUBLE / processed, 1) AS flagged_percentage FROM
            (SELECT count(*) AS total, count(*) FILTER (WHERE NOT is_error) AS processed, count(*) FILTER (WHERE NOT is_error AND final_prediction = 'genuine') AS genuine,
            count(*) FILTER (WHERE NOT is_error AND final_prediction = 'suspicious') AS suspicious, count(*) FILTER (WHERE NOT is_error AND final_prediction = 'low-quality') AS low_quality,
            count(*) FILTER (WHERE NOT is_error AND final_prediction = 'high-confidence-spam') AS spam, count(*) FILTER (WHERE is_error) AS errors,
            avg(final_confidence) FILTER (WHERE NOT is_error) AS avg_confidence, avg(p_bad) FILTER (WHERE NOT is_error) AS avg_risk_score FROM batch)""",
            BATCH,
        ),
    )
    def _(spark, folder):
        return r6(B.batch_summary(batch(spark, folder)), ["avg_confidence", "avg_risk_score"])

    @add(
        "detailed_batch_stats",
        "R2 R3 R4 R5",
        sql(
            "served",
            """SELECT 'text_prediction' AS breakdown, text_prediction AS bin, count(*) AS n FROM batch WHERE NOT is_error GROUP BY 2 UNION ALL
            SELECT 'confidence', CASE WHEN final_confidence >= 0.9 THEN 'high' WHEN final_confidence >= 0.8 THEN 'good' WHEN final_confidence >= 0.7 THEN 'medium' ELSE 'low' END,
              count(*) FROM batch WHERE NOT is_error GROUP BY 2 UNION ALL
            SELECT 'risk', CASE WHEN p_bad < 0.2 THEN 'very_low' WHEN p_bad < 0.4 THEN 'low' WHEN p_bad < 0.6 THEN 'medium' WHEN p_bad < 0.8 THEN 'high' ELSE 'very_high' END,
              count(*) FROM batch WHERE NOT is_error GROUP BY 2 UNION ALL
            SELECT 'route', routing_decision, count(*) FROM batch WHERE NOT is_error GROUP BY 2""",
            BATCH,
        ),
    )
    def _(spark, folder):
        return B.detailed_stats(batch(spark, folder))

    @add(
        "running_totals",
        "R6",
        sql(
            "served",
            """SELECT total_processed, genuine_count, suspicious_count, low_quality_count, spam_count, round(genuine_count / total_processed::DOUBLE * 100, 1) AS genuine_percentage,
            round((total_processed - genuine_count) / total_processed::DOUBLE * 100, 1) AS flagged_percentage FROM (SELECT count(*) AS total_processed,
            count(*) FILTER (WHERE final_prediction = 'genuine') AS genuine_count, count(*) FILTER (WHERE final_prediction = 'suspicious') AS suspicious_count,
            count(*) FILTER (WHERE final_prediction = 'low-quality') AS low_quality_count, count(*) FILTER (WHERE final_prediction = 'high-confidence-spam') AS spam_count FROM served)""",
        ),
    )
    def _(spark, folder):
        return B.running_totals(P.served(spark, folder))

    classes = ", ".join(f"count(*) FILTER (WHERE text_prediction = '{c}') AS n_{c}" for c in TEXT_CLASSES)

    @add(
        "text_stage_summary",
        "R7",
        sql(
            "tested",
            f"""SELECT count(*) AS total_reviews, {classes}, count(*) FILTER (WHERE text_prediction LIKE 'genuine%') AS n_genuine,
            count(*) FILTER (WHERE text_prediction NOT LIKE 'genuine%') AS n_non_genuine, round(avg(text_confidence), 6) AS avg_confidence,
            round(avg(p_bad), 6) AS avg_quality_risk, count(*) FILTER (WHERE p_bad > 0.7) AS high_risk_count FROM tested""",
        ),
    )
    def _(spark, folder):
        return r6(B.text_stage_summary(P.tested(spark, folder)), ["avg_confidence", "avg_quality_risk"])

    @add(
        "metadata_stage_summary",
        "R7",
        sql(
            "tested",
            """SELECT round(avg(metadata_anomaly_score), 6) AS avg_anomaly_score, count(*) FILTER (WHERE metadata_is_anomaly) AS anomaly_count, 0::BIGINT AS n_low,
            count(*) FILTER (WHERE NOT metadata_is_anomaly) AS n_medium, count(*) FILTER (WHERE metadata_is_anomaly) AS n_high FROM tested""",
        ),
    )
    def _(spark, folder):
        return r6(B.metadata_stage_summary(P.tested(spark, folder)), ["avg_anomaly_score"])

    tiers = ", ".join(f"count(*) FILTER (WHERE tier = '{t}') AS n_{t}" for t in TIERS)

    @add(
        "fusion_stage_summary",
        "R8",
        sql(
            "tested",
            f"""SELECT count(*) AS total_reviews, {tiers}, round(avg(risk), 6) AS avg_risk_score, round(avg(tier_confidence), 6) AS avg_confidence,
            count(*) FILTER (WHERE risk > 0.7) AS high_risk_count FROM tested""",
        ),
    )
    def _(spark, folder):
        return r6(B.fusion_stage_summary(P.tested(spark, folder)), ["avg_risk_score", "avg_confidence"])

    overall = f"""SELECT count(*) AS total_reviews, round(avg(risk), 6) AS avg_risk_score, round(count(*) FILTER (WHERE risk > 0.7) * 100.0::DOUBLE / count(*), 6) AS high_risk_percentage,
    round(count(*) FILTER (WHERE risk < 0.3) * 100.0::DOUBLE / count(*), 6) AS low_risk_percentage, {tiers} FROM tested"""

    @add("overall_analysis", "R9 T1 T2 T3 T4 A14 F18 F19 F20", sql("tested", overall))
    def _(spark, folder):
        out = B.overall_analysis(P.tested(spark, folder))
        return r6(out, ["avg_risk_score", "high_risk_percentage", "low_risk_percentage"])

    @add(
        "recommendations",
        "R10",
        sql(
            "probs",
            f"""SELECT category, unnest(list_filter([CASE WHEN high > 30 THEN '{RECOMMEND_HIGH_RISK}' END, CASE WHEN mean > 0.6 THEN '{RECOMMEND_MEAN_RISK}' END,
            CASE WHEN low > 70 THEN '{RECOMMEND_LOW_RISK}' END], lambda x: x IS NOT NULL)) AS recommendation FROM
            (SELECT category, avg(p_bad) AS mean, count(*) FILTER (WHERE p_bad > 0.7) * 100.0 / count(*) AS high,
            count(*) FILTER (WHERE p_bad < 0.3) * 100.0 / count(*) AS low FROM probs GROUP BY category)""",
        ),
    )
    def _(spark, folder):
        per = P.with_logits(spark, folder).groupBy("category").agg(
            F.avg("p_bad").alias("avg_risk_score"),
            (F.avg((F.col("p_bad") > 0.7).cast("double")) * 100).alias("high_risk_percentage"),
            (F.avg((F.col("p_bad") < 0.3).cast("double")) * 100).alias("low_risk_percentage"),
        )
        return B.recommendations(per).select("category", F.explode("recommendations").alias("recommendation"))

    @add(
        "decision_distribution",
        "R11",
        sql(
            "served",
            "SELECT final_prediction AS decision, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM served), 6) AS percent FROM served GROUP BY 1",
        ),
    )
    def _(spark, folder):
        return r6(B.share_table(P.served(spark, folder), "final_prediction", "decision"), ["percent"])

    @add(
        "mean_confidence_and_risk",
        "R12",
        sql("served", "SELECT round(avg(final_confidence), 6) AS avg_confidence, round(avg(p_bad), 6) AS avg_risk FROM served"),
    )
    def _(spark, folder):
        return P.served(spark, folder).agg(
            F.round(F.avg("final_confidence"), 6).alias("avg_confidence"), F.round(F.avg("p_bad"), 6).alias("avg_risk")
        )

    @add(
        "genuine_examples",
        "R13",
        sql("served", "SELECT review_id, substring(text, 1, 200) AS text, final_confidence FROM served WHERE final_prediction = 'genuine' ORDER BY review_id LIMIT 5"),
    )
    def _(spark, folder):
        first = B.genuine_examples(P.scored_table(spark, folder)).select("review_id", "final_confidence")
        # Five rows fetch their text from the reviews.
        out = P.reviews(spark, folder).join(F.broadcast(first), "review_id")
        return out.select("review_id", F.substring("text", 1, 200).alias("text"), "final_confidence")

    @add(
        "result_preview",
        "R14",
        sql(
            "tested",
            """SELECT review_id, CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || '...' ELSE text END AS text, text_prediction, tier AS fusion_prediction,
            round(risk, 6) AS fusion_risk_score FROM tested ORDER BY review_id LIMIT 10""",
        ),
    )
    def _(spark, folder):
        out = B.preview(P.tested(spark, folder))
        return out.select("review_id", "text", "text_prediction", "fusion_prediction", F.round("fusion_risk_score", 6).alias("fusion_risk_score"))

    @add("policy_violations", "R15", sql("served", "SELECT review_id, violation FROM violated", VIOLATION))
    def _(spark, folder):
        return B.violation_rows(P.scored_table(spark, folder)).select("review_id", "violation")

    @add(
        "violation_counts",
        "R16",
        sql(
            "served",
            "SELECT violation, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM violated), 6) AS percent FROM violated GROUP BY violation",
            VIOLATION,
        ),
    )
    def _(spark, folder):
        return r6(B.violation_counts(P.scored_table(spark, folder)), ["percent"])

    @add(
        "risk_heat_map",
        "R17",
        sql(
            "probs",
            "SELECT CASE WHEN p_bad > 0.8 THEN 'critical' WHEN p_bad >= 0.6 THEN 'high' WHEN p_bad >= 0.4 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM probs GROUP BY 1",
        ),
    )
    def _(spark, folder):
        return B.heat_map(P.with_logits(spark, folder))

    @add(
        "violation_filter",
        "R18",
        sql(
            "served",
            """SELECT review_id, violation, final_confidence FROM violated WHERE violation IN ('Advertisement', 'Spam Content') AND final_confidence >= 0.75
            AND published_at > (SELECT max(published_at) FROM served) - INTERVAL 7 DAYS AND published_at >= TIMESTAMP '2024-01-10' AND published_at < TIMESTAMP '2024-01-29'""",
            VIOLATION,
        ),
    )
    def _(spark, folder):
        df = P.scored_table(spark, folder)
        as_of = df.agg(F.max("published_at").alias("t")).scalar()
        rows = B.violation_rows(df).select("review_id", "violation", "final_confidence", "published_at").withColumn("as_of", as_of)
        out = B.violation_filter(
            rows, F.col("as_of"), ["Advertisement", "Spam Content"], "7d", "2024-01-10", "2024-01-29", 0.75
        )
        return out.select("review_id", "violation", "final_confidence")

    @add(
        "severity",
        "R19",
        sql(
            "probs",
            """SELECT review_id, pc AS percent, CASE WHEN pc >= 80 THEN 'high' WHEN pc >= 60 THEN 'medium' ELSE 'low' END AS severity FROM
            (SELECT review_id, CAST(floor(p_bad * 100) AS INT) AS pc FROM probs) WHERE pc >= 60 AND pc < 80""",
        ),
    )
    def _(spark, folder):
        # Stored first: the filter would otherwise be pushed down to the term counts and repeat the softmax for every use of the risk.
        rows = cut_lineage(P.with_logits(spark, folder).select("review_id", "p_bad"))
        return B.severity_filter(rows, "medium").select("review_id", "percent", "severity")

    @add(
        "decision_and_confidence_filter",
        "R20 R33",
        sql("served", "SELECT review_id, final_prediction, final_confidence FROM served WHERE final_prediction <> 'genuine' AND final_confidence >= 0.7"),
    )
    def _(spark, folder):
        df = P.scored_table(spark, folder)
        keep = B.DECISION_FILTERS["flagged"](F.col("final_prediction")) & (F.col("final_confidence") >= 0.7)
        return df.filter(keep).select("review_id", "final_prediction", "final_confidence")

    @add(
        "result_page",
        "R21",
        sql(
            "served",
            """SELECT review_id, final_prediction, place, total, least(30, total) AS shown_to FROM (SELECT review_id, final_prediction,
            row_number() OVER (ORDER BY review_id) AS place, count(*) OVER () AS total FROM served WHERE final_prediction <> 'genuine') WHERE place BETWEEN 21 AND 30""",
        ),
    )
    def _(spark, folder):
        df = P.scored_table(spark, folder).select("review_id", "final_prediction", "final_confidence")
        return B.page(df, 3, decision="flagged", stored=True).select("review_id", "final_prediction", "place", "total", "shown_to")

    @add(
        "daily_trend",
        "R22",
        sql(
            "served",
            """SELECT CAST(d.day AS VARCHAR) AS day, count(*) FILTER (WHERE final_prediction = 'genuine') AS genuine, count(*) FILTER (WHERE final_prediction <> 'genuine') AS flagged
            FROM (SELECT CAST(m - INTERVAL (29 - i) DAYS AS DATE) AS day FROM (SELECT max(CAST(published_at AS DATE)) AS m FROM served) CROSS JOIN range(30) r(i)) d
            LEFT JOIN served s ON CAST(s.published_at AS DATE) = d.day GROUP BY d.day""",
        ),
    )
    def _(spark, folder):
        return B.daily_trend(P.served(spark, folder)).withColumn("day", F.col("day").cast("string"))

    @add(
        "accuracy_by_category",
        "R23",
        sql("judged", "SELECT category, count(*) AS n, round(avg(CAST(truth = prediction AS INT)), 6) AS accuracy FROM judged GROUP BY category"),
    )
    def _(spark, folder):
        return r6(B.group_accuracy(P.judged(spark, folder), "category"), ["accuracy"])

    @add(
        "score_histogram",
        "R24",
        sql(
            "reviews",
            """SELECT CAST(b AS INT) AS bin, count(h.x) AS n FROM range(20) r(b) LEFT JOIN (SELECT enhanced_prob AS x, least(floor(round((enhanced_prob - lo) / ((hi - lo) / 20), 9)), 19) AS at
            FROM reviews CROSS JOIN (SELECT min(enhanced_prob) AS lo, max(enhanced_prob) AS hi FROM reviews)) h ON h.at = r.b GROUP BY b""",
        ),
    )
    def _(spark, folder):
        return B.histogram(P.reviews(spark, folder), "enhanced_prob")

    @add(
        "mean_risk_by_stage",
        "R25",
        sql(
            "tested",
            """SELECT 'text' AS stage, round(avg(p_bad), 6) AS mean_risk FROM tested UNION ALL SELECT 'metadata', round(avg(metadata_anomaly_score), 6) FROM tested
            UNION ALL SELECT 'fusion', round(avg(risk), 6) FROM tested""",
        ),
    )
    def _(spark, folder):
        return r6(B.mean_risk_by_stage(P.tested(spark, folder)), ["mean_risk"])

    @add(
        "stage_analysis",
        "R26",
        sql(
            "served",
            """SELECT review_id, text_prediction AS s1_prediction, text_confidence AS s1_confidence, 0.3::DOUBLE AS s2_anomaly_score, final_prediction AS s3_prediction,
            round(fusion_score, 6) AS s3_fusion_score FROM served""",
        ),
    )
    def _(spark, folder):
        df = P.served(spark, folder).withColumn("stage_analysis", S.stage_analysis())
        s = "stage_analysis."
        return df.select(
            "review_id",
            F.col(s + "stage1_text.prediction").alias("s1_prediction"),
            F.col(s + "stage1_text.confidence").alias("s1_confidence"),
            F.col(s + "stage2_metadata.anomaly_score").alias("s2_anomaly_score"),
            F.col(s + "stage3_fusion.final_prediction").alias("s3_prediction"),
            F.round(s + "stage3_fusion.fusion_score", 6).alias("s3_fusion_score"),
        )

    @add("anomaly_report", "R27")
    def _(spark, folder):
        df = P.feature_table(spark, folder)
        names = A.all_features(A.CATEGORIES)
        z = A.z_scores(df, names)
        # The widest z of the row stands for the model score, its top 8 % for the model flag.
        z = z.withColumn("ml_anomaly_score", F.greatest(*[F.coalesce(f"{f}_anomaly", F.lit(0.0)) for f in names]))
        z = A.flag_share(z, "ml_anomaly_score")
        return B.anomaly_report(z, A.CATEGORIES, names)

    @add("tester_report", "R28 S11")
    def _(spark, folder):
        return B.tester_report(P.tested_table(spark, folder), "reviews")

    @add("run_record", "R32")
    def _(spark, folder):
        return B.run_record(P.served(spark, folder).select("review_id"), "reviews", "batch").drop("finished_at")

    @add(
        "model_leader_board",
        "R34",
        sql(
            "judged rule_judged",
            """SELECT model, round(accuracy, 6) AS accuracy, CAST(rank() OVER (ORDER BY accuracy DESC) AS INT) AS rank FROM
            (SELECT 'logits' AS model, avg(CAST(truth = prediction AS INT)) AS accuracy FROM judged UNION ALL
             SELECT 'rules', avg(CAST(truth = prediction AS INT)) FROM rule_judged UNION ALL
             SELECT 'majority', avg(CAST(truth = 'genuine_positive' AS INT)) FROM judged)""",
        ),
    )
    def _(spark, folder):
        logits, rules = P.judged(spark, folder), P.rule_judged(spark, folder)
        always = logits.withColumn("prediction", F.lit("genuine_positive"))
        rows = None
        for name, df in (("logits", logits), ("rules", rules), ("majority", always)):
            one = E.accuracy(df).select(F.lit(name).alias("model"), "accuracy")
            rows = one if rows is None else rows.unionByName(one)
        return r6(B.leader_board(rows), ["accuracy"])

    @add(
        "result_export",
        "S10 S13",
        sql(
            "served",
            """SELECT text AS "Text", final_prediction AS "Prediction", final_confidence AS "Confidence", round(p_bad, 6) AS "Risk Score",
            routing_decision AS "Action", text_prediction AS "Text Class" FROM served""",
        ),
    )
    def _(spark, folder):
        from probity.sources.sinks import export_columns

        return export_columns(P.served(spark, folder).withColumn("p_bad", F.round("p_bad", 6)))

    @add(
        "results_per_file",
        "S9 R1",
        sql(
            "tested",
            """SELECT 'input=' || coalesce(language, 'none') AS input_file, count(*) AS reviews, count(nullif(text, '')) AS with_text,
            count(*) FILTER (WHERE tier = 'high_risk') AS high_risk, round(avg(risk), 6) AS avg_risk FROM tested GROUP BY ALL""",
        ),
    )
    def _(spark, folder):
        """The reviews written as one CSV input per language, read together, scored, and summed up per input."""
        risk, tier = F.col("fusion_risk_score"), F.col("fusion_prediction")
        docs = P.table(spark, folder, "documents")
        chars = P.reviews(spark, folder).agg(F.sum(measure("length"))).first()[0] or 0
        # A review in a file has its whole text, which many share: a part of the reviews is written and summed up at a time.
        n = P.parts_of(chars, docs.agg(F.sum(F.length("text"))).first()[0] or 0)
        sums = []
        with shuffles_go(spark):
            for i in range(n):
                events = P.table(spark, folder, "events").filter(F.pmod(F.xxhash64("event_id"), F.lit(n)) == i)
                rows = P.as_reviews(events, docs, P.table(spark, folder, "labels"))
                path = f"{checkpoint_dir(spark)}/inputs-{uuid.uuid4().hex}"
                write_csv(rows.select("review_id", "text", "stars", F.coalesce("language", F.lit("none")).alias("input")), path, partition_by=["input"])
                found = read_many(spark, path, "review_id long, text string, stars double", multi_line=True, by_folder=True)
                sums.append(cut_lineage(S.tester_scores(found).groupBy("input_file").agg(
                    F.count(F.lit(1)).alias("reviews"), F.count("text").alias("with_text"), F.count_if(tier == "high_risk").alias("high_risk"),
                    F.sum(risk).alias("risk"), F.count(risk).alias("scored"),
                )))
                delete(spark, path)
        return reduce(DataFrame.union, sums).groupBy("input_file").agg(
            *[F.sum(c).alias(c) for c in ("reviews", "with_text", "high_risk")], F.round(F.try_divide(F.sum("risk"), F.sum("scored")), 6).alias("avg_risk")
        )

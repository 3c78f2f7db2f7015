"""Evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from probity.constants import COMPLEMENT_REPORT, DECISIONS, TEXT_CLASSES
from probity.functions import risk as R
from probity.functions.text import non_genuine_probability
from probity.operators import complement as C
from probity.operators import metrics as E
from probity.plans import reviews as P
from probity.plans.catalog.sql import BAD, long_form, sql
from probity.session import cut_lineage


def r6(df, names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def per_class_sql(source, labels, truth="truth", pred="prediction", name="pc"):
    each = ", ".join(f"('{c}')" for c in labels)
    return f"""{name} AS (SELECT label, tp, support, claimed, precision, recall,
      CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
    FROM (SELECT label, tp, support, claimed, CASE WHEN claimed > 0 THEN tp / claimed::DOUBLE ELSE 0 END AS precision,
      CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS recall
    FROM (SELECT label, (SELECT count(*) FROM {source} WHERE {truth} = label AND {pred} = label) AS tp,
      (SELECT count(*) FROM {source} WHERE {truth} = label) AS support,
      (SELECT count(*) FROM {source} WHERE {pred} = label) AS claimed FROM (VALUES {each}) v(label))))"""


AVERAGES = """SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall,
round(avg(f1), 6) AS macro_f1, round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall,
round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(tp) / sum(claimed)::DOUBLE, 6) AS micro_precision, round(sum(tp) / sum(support)::DOUBLE, 6) AS micro_recall,
round(2 * (sum(tp) / sum(claimed)::DOUBLE) * (sum(tp) / sum(support)::DOUBLE) / (sum(tp) / sum(claimed)::DOUBLE + sum(tp) / sum(support)::DOUBLE), 6) AS micro_f1,
count(*) AS num_classes, sum(support)::BIGINT AS total_samples FROM {pc} WHERE support > 0 OR claimed > 0"""

BIN = """bin AS (SELECT *, tn + fp + fn + tp AS n,
  coalesce(tn / nullif(tn + fn, 0)::DOUBLE, 0) AS npv, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS specificity,
  coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS ppv, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS sensitivity
FROM (SELECT count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn, count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn, count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp FROM {src})),
binm AS (SELECT *, (tp + tn) / n::DOUBLE AS accuracy, npv AS genuine_precision, specificity AS genuine_recall,
  coalesce(2 * npv * specificity / nullif(npv + specificity, 0), 0) AS genuine_f1, ppv AS non_genuine_precision, sensitivity AS non_genuine_recall,
  coalesce(2 * ppv * sensitivity / nullif(ppv + sensitivity, 0), 0) AS non_genuine_f1 FROM bin),
binall AS (SELECT *, (genuine_precision + non_genuine_precision) / 2 AS macro_precision, (genuine_recall + non_genuine_recall) / 2 AS macro_recall,
  (genuine_f1 + non_genuine_f1) / 2 AS macro_f1, (genuine_precision * (tn + fp) + non_genuine_precision * (tp + fn)) / n AS weighted_precision,
  (genuine_recall * (tn + fp) + non_genuine_recall * (tp + fn)) / n AS weighted_recall,
  (genuine_f1 * (tn + fp) + non_genuine_f1 * (tp + fn)) / n AS weighted_f1 FROM binm)"""

BIN_NAMES = [
    "accuracy", "genuine_precision", "genuine_recall", "genuine_f1", "non_genuine_precision", "non_genuine_recall",
    "non_genuine_f1", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1",
]

STEPS = """steps AS (SELECT *, cp - pos AS bp, cn - neg AS bn, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM (SELECT score, pos, neg,
  sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn FROM
  (SELECT score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM {src} GROUP BY score)))"""

RANKING = """rank AS (SELECT sum(neg * (bp + pos / 2) / (p * n)) AS roc_auc, sum(pos / p * cp / (cp + cn)) AS pr_auc,
  sum(neg / n * (bp + cp) / p / 2) AS roc_trapezoid,
  sum(pos / p * (cp / (cp + cn) + CASE WHEN bp + bn > 0 THEN bp / (bp + bn) ELSE 1 END) / 2) AS pr_trapezoid FROM steps)"""

CLASS_AP = (
    "each AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS label, p{i} AS score, CAST(truth = '{c}' AS INT) AS y FROM judged" for i, c in enumerate(TEXT_CLASSES))
    + """), csteps AS (SELECT *, sum(pos) OVER (PARTITION BY label ORDER BY score DESC) AS cp, sum(neg) OVER (PARTITION BY label ORDER BY score DESC) AS cn,
  sum(pos) OVER (PARTITION BY label) AS p FROM (SELECT label, score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM each GROUP BY label, score)),
cap AS (SELECT label, sum(pos / p * cp / (cp + cn)) AS pr_auc, max(p)::BIGINT AS support FROM csteps GROUP BY label HAVING max(p) > 0)"""
)

COMPLEMENT = """cc AS (SELECT count(*) AS n, sum(y) AS bad, sum(a) AS a, sum(b) AS b, count(*) FILTER (WHERE a = 1 OR b = 1) AS either,
  count(*) FILTER (WHERE a = 1 AND b = 1) AS both_, count(*) FILTER (WHERE a = 1 AND y = 1) AS ab, count(*) FILTER (WHERE b = 1 AND y = 1) AS bb,
  count(*) FILTER (WHERE (a = 1 OR b = 1) AND y = 1) AS eb, count(*) FILTER (WHERE a = 1 AND b = 1 AND y = 1) AS xb,
  count(*) FILTER (WHERE a = 1 AND b = 0 AND y = 1) AS oa, count(*) FILTER (WHERE a = 0 AND b = 1 AND y = 1) AS ob,
  count(*) FILTER (WHERE a = b) AS same, count(*) FILTER (WHERE a = b AND y = 1) AS sameb
  FROM (SELECT y, yhat AS a, stage2 AS b FROM rule_judged)),
cm AS (SELECT coalesce(ab / nullif(bad, 0)::DOUBLE, 0) AS stage1_coverage, coalesce(bb / nullif(bad, 0)::DOUBLE, 0) AS stage2_coverage,
  coalesce(ob / nullif(bad - ab, 0)::DOUBLE, 0) AS stage2_recovery_rate, ob AS stage2_unique_catches,
  coalesce(oa / nullif(bad - bb, 0)::DOUBLE, 0) AS stage1_recovery_rate, oa AS stage1_unique_catches,
  coalesce(eb / nullif(bad, 0)::DOUBLE, 0) AS combined_or_coverage, coalesce(xb / nullif(both_, 0)::DOUBLE, 0) AS combined_and_precision,
  same / n::DOUBLE AS overall_agreement, coalesce(sameb / nullif(bad, 0)::DOUBLE, 0) AS problematic_agreement,
  coalesce(ob / nullif(b - both_, 0)::DOUBLE, 0) AS stage2_unique_precision, coalesce(oa / nullif(a - both_, 0)::DOUBLE, 0) AS stage1_unique_precision,
  coalesce((eb - ab) / nullif(bad - ab, 0)::DOUBLE, 0) AS false_negative_reduction, ((either - eb) - (a - ab)) / n::DOUBLE AS false_positive_increase,
  n AS total_samples, bad::BIGINT AS total_problematic, a::BIGINT AS stage1_flags, b::BIGINT AS stage2_flags, either AS combined_flags FROM cc)"""

STAGE_METRICS = ["accuracy", "macro_f1", "weighted_f1", "macro_precision", "macro_recall"]


def stage1(spark, folder):
    pc = E.per_class(P.judged(spark, folder), "truth", "prediction")
    return E.averages(pc).select(F.lit("Stage 1 - Text").alias("stage"), *STAGE_METRICS, "num_classes", "total_samples")


def stage2(spark, folder):
    df = P.rule_judged(spark, folder).select("y", F.col("stage2").alias("yhat"))
    b = E.binary_metrics(df)
    return b.select(
        F.lit("Stage 2 - Metadata").alias("stage"), *STAGE_METRICS, F.lit(2).cast("long").alias("num_classes"),
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("total_samples"),
    )


def fusion_judged(spark, folder):
    df = P.judged(spark, folder).withColumn("dp", R.decision_probs(F.col("probs")))
    df = df.withColumns(R.threshold_decision(F.col("dp")))
    return df.withColumn("decision", R.truth_decision(F.col("truth")))


def stage3(spark, folder):
    pc = E.per_class(fusion_judged(spark, folder), "decision", "final_prediction", DECISIONS)
    return E.averages(pc).select(F.lit("Stage 3 - Fusion").alias("stage"), *STAGE_METRICS, "num_classes", "total_samples")


FUSION_JUDGED = """fj AS (SELECT *, CASE WHEN truth IN ('genuine_positive','genuine_negative') THEN 'genuine' WHEN truth IN ('spam','advertisement','inappropriate')
  THEN 'high-confidence-spam' WHEN truth = 'irrelevant' THEN 'low-quality' ELSE 'suspicious' END AS decision,
  CASE WHEN d_spam >= 0.35 THEN 'high-confidence-spam' WHEN d_genuine >= 0.25 THEN 'genuine' WHEN d_low >= 0.15 THEN 'low-quality' ELSE 'suspicious' END AS final_prediction,
  CASE WHEN d_spam >= 0.35 THEN d_spam WHEN d_genuine >= 0.25 THEN d_genuine WHEN d_low >= 0.15 THEN d_low ELSE d_suspicious END AS final_confidence FROM judged)"""


def _avg(pc, stage):
    return f"""SELECT '{stage}' AS stage, sum(tp) / sum(support)::DOUBLE AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
    avg(precision) AS macro_precision, avg(recall) AS macro_recall, count(*) AS num_classes, sum(support)::BIGINT AS total_samples
    FROM {pc} WHERE support > 0 OR claimed > 0"""


STAGES = f"""stages AS ({_avg('pc', 'Stage 1 - Text')} UNION ALL
SELECT 'Stage 2 - Metadata', accuracy, macro_f1, weighted_f1, macro_precision, macro_recall, 2, n FROM binall UNION ALL
{_avg('pf', 'Stage 3 - Fusion')})"""

STAGE_CTES = (
    FUSION_JUDGED,
    per_class_sql("judged", TEXT_CLASSES),
    per_class_sql("fj", DECISIONS, "decision", "final_prediction", "pf"),
    "s2 AS (SELECT y, stage2 AS yhat FROM rule_judged)",
    BIN.format(src="s2"),
    STAGES,
)


def register(catalog):
    add = catalog.add

    @add(
        "known_labels",
        "E1 E2 E16",
        sql(
            "reviews",
            f"""SELECT v.label, count(r.label) AS n, round(count(r.label) * 100.0::DOUBLE / (SELECT count(*) FROM reviews WHERE text IS NOT NULL AND label IS NOT NULL), 6) AS percent,
            CAST(v.label IN {BAD} AS INT) AS problem FROM (VALUES {", ".join(f"('{c}')" for c in TEXT_CLASSES)}) v(label)
            LEFT JOIN (SELECT label FROM reviews WHERE text IS NOT NULL) r ON r.label = v.label GROUP BY v.label""",
        ),
    )
    def _(spark, folder):
        out = E.class_distribution(E.known_labels(P.reviews(spark, folder)), "label")
        return r6(out, ["percent"]).withColumn("problem", E.problem_label(F.col("label")))

    pc_cols = "label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support"

    @add("per_class_scores", "E3 E4", sql("judged", f"SELECT {pc_cols} FROM pc", per_class_sql("judged", TEXT_CLASSES)))
    def _(spark, folder):
        pc = E.per_class(P.judged(spark, folder), "truth", "prediction")
        return r6(pc, ["precision", "recall", "f1"]).select("label", "precision", "recall", "f1", "support")

    @add("score_averages", "E3 E5", sql("judged", AVERAGES.format(pc="pc"), per_class_sql("judged", TEXT_CLASSES)))
    def _(spark, folder):
        out = E.averages(E.per_class(P.judged(spark, folder), "truth", "prediction"))
        return r6(out, [c for c in out.columns if c not in ("num_classes", "total_samples")])

    @add(
        "confusion_matrix",
        "E7",
        sql(
            "judged",
            "SELECT v.truth, "
            + ", ".join(f"count(*) FILTER (WHERE prediction = '{c}') AS {c}" for c in TEXT_CLASSES)
            + f" FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in TEXT_CLASSES)}) v(truth) LEFT JOIN judged j ON j.truth = v.truth GROUP BY v.truth",
        ),
    )
    def _(spark, folder):
        return E.confusion_matrix(P.judged(spark, folder), "truth", "prediction")

    @add(
        "binary_confusion_matrix",
        "E7 E31",
        sql(
            "judged",
            """SELECT CASE y WHEN 1 THEN 'non_genuine' ELSE 'genuine' END AS truth, count(*) FILTER (WHERE yhat = 0) AS genuine,
            count(*) FILTER (WHERE yhat = 1) AS non_genuine FROM judged GROUP BY y""",
        ),
    )
    def _(spark, folder):
        df = P.judged(spark, folder)
        name = {c: F.when(F.col(c) == 1, "non_genuine").otherwise("genuine") for c in ("y", "yhat")}
        return E.confusion_matrix(df.withColumns(name), "y", "yhat", ["genuine", "non_genuine"])

    cols = ["tn", "fp", "fn", "tp"]
    rates = ["specificity", "sensitivity", "ppv", "npv", *BIN_NAMES]

    @add(
        "binary_metrics",
        "E6 E8",
        sql("judged", "SELECT " + ", ".join([*cols, *[f"round({m}, 6) AS {m}" for m in rates]]) + " FROM binall", BIN.format(src="judged")),
    )
    def _(spark, folder):
        out = E.binary_metrics(P.judged(spark, folder))
        return r6(out, rates).select(*cols, *rates)

    names = ["roc_auc", "pr_auc", "roc_trapezoid", "pr_trapezoid"]

    @add(
        "ranking_metrics",
        "E9 E10 E13",
        sql("judged", "SELECT " + ", ".join(f"round({n}, 6) AS {n}" for n in names) + " FROM rank", STEPS.format(src="judged"), RANKING),
    )
    def _(spark, folder):
        return r6(E.ranking_metrics(P.judged(spark, folder)), names)

    @add(
        "ranking_metrics_with_ties",
        "E9 E10 E13",
        sql(
            "rule_judged",
            "SELECT " + ", ".join(f"round({n}, 6) AS {n}" for n in names) + " FROM rank",
            "tied AS (SELECT round(p_bad, 6) AS score, y FROM rule_judged)",
            STEPS.format(src="tied"),
            RANKING,
        ),
    )
    def _(spark, folder):
        df = P.rule_judged(spark, folder).select(F.round("p_bad", 6).alias("score"), "y")
        return r6(E.ranking_metrics(df), names)

    @add("class_average_precision", "E11", sql("judged", "SELECT label, round(pr_auc, 6) AS pr_auc, support FROM cap", CLASS_AP))
    def _(spark, folder):
        return r6(E.class_average_precision(P.judged(spark, folder), "truth", "probs"), ["pr_auc"])

    @add(
        "average_precision_means",
        "E11",
        sql(
            "judged",
            "SELECT round(avg(pr_auc), 6) AS pr_auc_macro, round(sum(pr_auc * support) / sum(support), 6) AS pr_auc_weighted FROM cap",
            CLASS_AP,
        ),
    )
    def _(spark, folder):
        ap = E.class_average_precision(P.judged(spark, folder), "truth", "probs")
        return r6(E.average_precision_means(ap), ["pr_auc_macro", "pr_auc_weighted"])

    @add(
        "curve_points",
        "E12",
        sql(
            "judged",
            "SELECT score, round(cn / n, 6) AS fpr, round(cp / p, 6) AS tpr, round(cp / (cp + cn), 6) AS precision FROM steps",
            STEPS.format(src="judged"),
        ),
    )
    def _(spark, folder):
        return r6(E.curve_points(P.judged(spark, folder)), ["fpr", "tpr", "precision"])

    cmp_names = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1"]

    def model_rows(pc):
        return f"""SELECT sum(tp) / sum(support)::DOUBLE AS accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
        sum(f1 * support) / sum(support) AS weighted_f1 FROM {pc} WHERE support > 0 OR claimed > 0"""

    @add(
        "model_comparison",
        "E14",
        sql(
            "judged rule_judged",
            """SELECT a.metric, round(a.value, 6) AS model_a, round(b.value, 6) AS model_b,
            round(CASE WHEN b.value > 0 THEN (a.value - b.value) / b.value * 100 ELSE 0 END, 4) AS improvement,
            CASE WHEN a.value > b.value THEN 'model_a' ELSE 'model_b' END AS winner FROM la a JOIN lb b ON a.metric = b.metric""",
            per_class_sql("rule_judged", TEXT_CLASSES, name="pa"),
            per_class_sql("judged", TEXT_CLASSES, name="pb"),
            f"ma AS ({model_rows('pa')})",
            f"mb AS ({model_rows('pb')})",
            f"la AS ({long_form('ma', cmp_names)})",
            f"lb AS ({long_form('mb', cmp_names)})",
        ),
    )
    def _(spark, folder):
        a = E.averages(E.per_class(P.rule_judged(spark, folder), "truth", "prediction"))
        b = E.averages(E.per_class(P.judged(spark, folder), "truth", "prediction"))
        out = E.compare_models(E.melt(a, cmp_names), E.melt(b, cmp_names))
        return out.withColumns(
            {"model_a": F.round("model_a", 6), "model_b": F.round("model_b", 6), "improvement": F.round("improvement", 4)}
        )

    @add(
        "sample_predictions",
        "E15",
        sql(
            "judged",
            f"""SELECT review_id AS sample_id, truth AS true_label_text, y AS true_binary, yhat AS predicted_binary,
            round(CASE WHEN prediction IN {BAD} THEN confidence ELSE 1 - confidence END, 6) AS probability_non_genuine,
            CAST(y = yhat AS INT) AS correct_prediction FROM judged""",
        ),
    )
    def _(spark, folder):
        df = P.judged(spark, folder)
        p = non_genuine_probability(F.col("prediction"), F.col("text_confidence"))
        return E.sample_predictions(df.withColumn("probability_non_genuine", F.round(p, 6)))

    @add(
        "metadata_stage_evaluation",
        "E17",
        sql(
            "rule_judged",
            """SELECT round(accuracy, 6) AS accuracy, round(non_genuine_precision, 6) AS precision, round(non_genuine_recall, 6) AS recall,
            round(non_genuine_f1, 6) AS f1_score, fp + tp AS anomaly_count, round((fp + tp) / n::DOUBLE, 6) AS anomaly_rate,
            round((SELECT avg(metadata_anomaly_score) FROM rule_judged), 6) AS avg_anomaly_score FROM binall""",
            "s2 AS (SELECT y, stage2 AS yhat FROM rule_judged)",
            BIN.format(src="s2"),
        ),
    )
    def _(spark, folder):
        df = cut_lineage(P.rule_judged(spark, folder).withColumn("yhat", F.col("stage2")))
        mean = df.agg(F.avg("metadata_anomaly_score").alias("m")).scalar()
        b = E.binary_metrics(df)
        n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
        flagged = F.col("fp") + F.col("tp")
        out = b.select(
            "accuracy", F.col("non_genuine_precision").alias("precision"), F.col("non_genuine_recall").alias("recall"),
            F.col("non_genuine_f1").alias("f1_score"), flagged.alias("anomaly_count"), (flagged / n).alias("anomaly_rate"),
            mean.alias("avg_anomaly_score"),
        )
        return r6(out, [c for c in out.columns if c != "anomaly_count"])

    @add(
        "fusion_stage_evaluation",
        "E18",
        sql(
            "judged",
            f"SELECT {pc_cols}, (SELECT round(avg(final_confidence), 6) FROM fj) AS avg_confidence FROM pf",
            FUSION_JUDGED,
            per_class_sql("fj", DECISIONS, "decision", "final_prediction", "pf"),
        ),
    )
    def _(spark, folder):
        df = cut_lineage(fusion_judged(spark, folder).select("decision", "final_prediction", "final_confidence"))
        mean = df.agg(F.avg("final_confidence").alias("m")).scalar()
        pc = E.per_class(df, "decision", "final_prediction", DECISIONS)
        out = r6(pc, ["precision", "recall", "f1"]).select("label", "precision", "recall", "f1", "support")
        return out.withColumn("avg_confidence", F.round(mean, 6))

    rounded = ", ".join(f"round({m}, 6) AS {m}" for m in STAGE_METRICS)

    @add(
        "stage_table",
        "E19 E29 S12 S20",
        sql(
            "judged rule_judged",
            f"SELECT stage, {rounded}, num_classes, total_samples FROM (SELECT * FROM stages UNION ALL SELECT 'SUMMARY', {', '.join(f'avg({m})' for m in STAGE_METRICS)}, NULL, NULL FROM stages)",
            *STAGE_CTES,
        ),
    )
    def _(spark, folder):
        stages = stage1(spark, folder).unionByName(stage2(spark, folder)).unionByName(stage3(spark, folder))
        return r6(E.with_summary_row(stages, STAGE_METRICS), STAGE_METRICS)


    @add(
        "stage_complement",
        "E20 E21 E22 E23 E24 E25",
        sql(
            "rule_judged",
            "SELECT " + ", ".join(m if m.startswith(("total", "stage1_flags", "stage2_flags", "combined_flags")) or m.endswith("catches") else f"round({m}, 6) AS {m}" for m in C.METRICS) + " FROM cm",
            COMPLEMENT,
        ),
    )
    def _(spark, folder):
        df = P.rule_judged(spark, folder).withColumn("stage1", F.col("yhat"))
        out = C.complement_metrics(df)
        return r6(out, [f.name for f in out.schema.fields if f.dataType.simpleString() == "double"])

    rows = " UNION ALL ".join(
        f"SELECT '{t}' AS metric, {'CAST(' + k + ' AS VARCHAR)' if k.endswith('catches') else 'printf(' + chr(39) + '%.3f' + chr(39) + ', ' + k + ')'} AS value, '{d}' AS description FROM cm"
        for t, k, d in COMPLEMENT_REPORT
    )

    @add("complement_report", "E26", sql("rule_judged", rows, COMPLEMENT))
    def _(spark, folder):
        df = P.rule_judged(spark, folder).withColumn("stage1", F.col("yhat"))
        return C.complement_report(C.complement_metrics(df))

    @add(
        "stage_breakdown",
        "E27",
        sql(
            "rule_judged",
            """SELECT review_id AS sample_id, truth AS true_label, y AS true_binary, yhat AS stage1_prediction, confidence AS stage1_confidence,
            stage2 AS stage2_prediction, metadata_anomaly_score AS stage2_score, CAST(yhat = stage2 AS INT) AS agreement, greatest(yhat, stage2) AS combined_or,
            CAST(yhat = y AS INT) AS stage1_correct, CAST(stage2 = y AS INT) AS stage2_correct, CAST(greatest(yhat, stage2) = y AS INT) AS combined_correct FROM rule_judged""",
        ),
    )
    def _(spark, folder):
        df = P.rule_judged(spark, folder)
        return C.breakdown(
            df.withColumns(
                {"stage1": F.col("yhat"), "stage1_confidence": F.col("text_confidence"), "stage2_score": F.col("metadata_anomaly_score")}
            )
        )

    def pretty(pc, stage, labels):
        title = " ".join(f"WHEN '{c}' THEN '{c.replace('_', ' ').replace('-', ' ').title()}'" for c in labels)
        return f"""SELECT '{stage}' AS stage, CASE label {title} END AS class, printf('%.3f', precision) AS precision, printf('%.3f', recall) AS recall,
        printf('%.3f', f1) AS f1_score, support FROM {pc}"""

    @add(
        "per_class_report",
        "E28",
        sql(
            "judged",
            pretty("pc", "text", TEXT_CLASSES) + " UNION ALL " + pretty("pf", "fusion", DECISIONS),
            FUSION_JUDGED,
            per_class_sql("judged", TEXT_CLASSES),
            per_class_sql("fj", DECISIONS, "decision", "final_prediction", "pf"),
        ),
    )
    def _(spark, folder):
        def show(pc, stage):
            return pc.select(
                F.lit(stage).alias("stage"), E.title_case(F.col("label")).alias("class"),
                E.three_places(F.col("precision")).alias("precision"), E.three_places(F.col("recall")).alias("recall"),
                E.three_places(F.col("f1")).alias("f1_score"), "support",
            )

        text = E.per_class(P.judged(spark, folder), "truth", "prediction")
        fusion = E.per_class(fusion_judged(spark, folder), "decision", "final_prediction", DECISIONS)
        return show(text, "text").unionByName(show(fusion, "fusion"))

    fifteen = ["accuracy", "roc_auc", "pr_auc", *BIN_NAMES[1:]]

    @add(
        "binary_metric_table",
        "E30",
        sql(
            "judged",
            "SELECT metric, round(value, 6) AS value FROM (" + long_form("allm", fifteen) + ")",
            BIN.format(src="judged"),
            STEPS.format(src="judged"),
            RANKING,
            "allm AS (SELECT binall.*, rank.roc_auc, rank.pr_auc FROM binall CROSS JOIN rank)",
        ),
    )
    def _(spark, folder):
        df = cut_lineage(P.judged(spark, folder).select("score", "y", "yhat"))
        ranks = E.melt(E.ranking_metrics(df), ["roc_auc", "pr_auc"])
        return r6(E.melt(E.binary_metrics(df), BIN_NAMES).unionByName(ranks), ["value"])

    @add(
        "class_counts_both_sides",
        "E31",
        sql(
            "judged",
            """SELECT v.label, (SELECT count(*) FROM judged WHERE truth = v.label) AS true_count, (SELECT count(*) FROM judged WHERE prediction = v.label) AS predicted_count
            FROM (VALUES """
            + ", ".join(f"('{c}')" for c in TEXT_CLASSES)
            + ") v(label)",
        ),
    )
    def _(spark, folder):
        pc = E.per_class(P.judged(spark, folder), "truth", "prediction")
        return pc.select("label", F.col("support").alias("true_count"), F.col("claimed").alias("predicted_count"))

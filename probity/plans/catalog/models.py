"""Trained models with the library's settings, fitted on at most ``fusion.FIT_ROWS`` labelled rows."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from probity.constants import DECISION_CLASS_WEIGHTS
from probity.functions import risk as R
from probity.operators import fusion as M
from probity.operators import metrics as E
from probity.operators import textmodel as T
from probity.plans import reviews as P
from probity.plans.catalog.sql import sql
from probity.session import cut_lineage


def fusion_rows(spark, folder):
    """All labelled reviews with the 20 features and the training decision, stored once for the many passes."""
    df = P.judged(spark, folder).withColumnRenamed("truth", "label")
    df = M.with_fusion_features(df)
    df = df.withColumn("decision", M.target_decision(F.col("label"), F.col("review_id")))
    df = df.withColumn("code", R.decision_code(F.col("decision")).cast("double"))
    return cut_lineage(df.select("review_id", "label", "decision", "code", *M.FEATURE_COLUMNS))


def fit_rows(df):
    """The bounded rows of a fit, stored once."""
    return cut_lineage(M.fit_sample(df))


def split_accuracy(spark, folder, kind, **params):
    """Accuracy over all rows of both sides of the split; only the fit is bounded."""
    df = cut_lineage(M.leading_split(fusion_rows(spark, folder), F.col("review_id"), "review_id"))
    model = M.FusionModel(kind, params).fit(fit_rows(df.filter("is_train")))
    scored = model.predict(df)
    return scored.groupBy("is_train").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("final_prediction") == F.col("decision")).cast("double")), 4).alias("accuracy"),
        F.round(F.avg("final_confidence"), 4).alias("avg_confidence"),
    )


def register(catalog):
    add = catalog.add

    @add("text_model", "T19")
    def _(spark, folder):
        rows = T.with_terms(P.reviews(spark, folder).select("review_id", "text", "label"))
        model = T.train_text_model(rows)
        scored = T.text_model_scores(rows, model)
        pc = E.per_class(scored, "label", "text_prediction")
        return pc.select("label", "support", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"))

    @add("text_model_balanced", "T19")
    def _(spark, folder):
        rows = T.with_terms(P.reviews(spark, folder).select("review_id", "text", "label"))
        model = T.train_text_model(rows, balanced=True)
        scored = T.text_model_scores(rows, model)
        pc = E.per_class(scored, "label", "text_prediction")
        return pc.select("label", "support", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"))

    @add("training_runs", "T20")
    def _(spark, folder):
        rows = T.with_terms(P.reviews(spark, folder).select("text", "label"))
        jobs = {
            "plain": lambda: T.train_text_model(rows),
            "balanced": lambda: T.train_text_model(rows, balanced=True),
        }
        return T.training_runs(spark, jobs).select("model", "success", "path")

    @add("fusion_boosting", "F4 F8 F12")
    def _(spark, folder):
        return split_accuracy(spark, folder, "boosting")

    @add("fusion_forest", "F5 F8")
    def _(spark, folder):
        return split_accuracy(spark, folder, "random_forest")

    @add("fusion_neural_network", "F6 F8")
    def _(spark, folder):
        return split_accuracy(spark, folder, "neural_network")

    @add("fusion_logistic", "F7 F8")
    def _(spark, folder):
        return split_accuracy(spark, folder, "logistic")

    @add("fusion_cross_validation", "F9")
    def _(spark, folder):
        df = fit_rows(fusion_rows(spark, folder))
        ready = Pipeline(stages=M.assembler()).fit(df).transform(df)
        fitted = M.cross_validate(ready, M.make_classifier("random_forest"))
        row = [(float(fitted.avgMetrics[0]), 2 * float(fitted.stdMetrics[0]))]
        return spark.createDataFrame(row, "mean_accuracy double, two_deviations double")

    @add("fusion_grid_search", "F10")
    def _(spark, folder):
        return M.search(fusion_rows(spark, folder))

    @add("fusion_importances", "F11")
    def _(spark, folder):
        model = M.FusionModel("boosting").fit(fit_rows(fusion_rows(spark, folder)))
        return spark.createDataFrame(model.importances(), "feature string, importance double")

    weight = " ".join(f"WHEN '{k}' THEN {v}" for k, v in DECISION_CLASS_WEIGHTS.items())

    @add(
        "class_weights",
        "D27",
        sql(
            "judged",
            f"""SELECT truth AS label, count(*) AS n, round((SELECT count(*) FROM judged) / ((SELECT count(DISTINCT truth) FROM judged) * count(*))::DOUBLE, 6) AS weight,
            CASE CASE WHEN truth LIKE 'genuine%' THEN 'genuine' WHEN truth IN ('spam','advertisement','inappropriate') THEN 'high-confidence-spam'
              WHEN truth = 'irrelevant' THEN 'low-quality' ELSE 'suspicious' END {weight} END::DOUBLE AS decision_weight FROM judged GROUP BY truth""",
        ),
    )
    def _(spark, folder):
        df = P.judged(spark, folder).select("review_id", F.col("truth").alias("label"))
        df = M.class_weights(df, "label")
        df = df.withColumn("decision", R.truth_decision(F.col("label")))
        df = M.class_weights(df, "decision", "decision_weight", DECISION_CLASS_WEIGHTS)
        return df.groupBy("label").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.first("weight"), 6).alias("weight"), F.first("decision_weight").alias("decision_weight")
        )

    @add("class_rebalancing", "D27")
    def _(spark, folder):
        df = P.judged(spark, folder).select("review_id", F.col("truth").alias("label"))
        factors = {"genuine_positive": 1.5, "spam": 2.0, "fake_rant": 0.5}
        return T.rebalance(df, "label", factors).groupBy("label").agg(F.count(F.lit(1)).alias("n"))

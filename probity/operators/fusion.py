"""Fusion features, decision models and their training."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.constants import DECISIONS, FUSION_FEATURES
from probity.functions import risk as R
from probity.functions.vectors import lookup
from probity.operators import boosting, gridsearch
from probity.operators.anomaly import filled, standardise
from probity.operators.ordered import global_row_number, smallest
from probity.session import cut_lineage


def fusion_columns(
    probs: Column, p_bad: Column, enhanced: Column, relevancy: Column, relevant: Column, confidence: Column
) -> dict[str, Column]:
    """The 20 fusion features in order."""
    p = {c: F.element_at(probs, i) for c, i in
         (("spam", 3), ("advertisement", 4), ("irrelevant", 5), ("fake_rant", 6), ("inappropriate", 7))}
    penalty = F.when(relevant, 0.0).otherwise(2 * (1 - relevancy))
    values = [
        p_bad, enhanced, relevancy, relevant.cast("double"), confidence, enhanced,
        *[p[c] for c in p],
        p_bad * p_bad, enhanced * enhanced, relevancy * relevancy,
        p_bad * enhanced, p_bad * relevancy, enhanced * relevancy,
        p_bad * confidence, enhanced * confidence, penalty,
    ]
    return dict(zip((f"f_{n}" for n in FUSION_FEATURES), values))


FEATURE_COLUMNS = [f"f_{n}" for n in FUSION_FEATURES]


def with_fusion_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        fusion_columns(
            F.col("probs"), F.col("p_bad"), F.coalesce("enhanced_prob", F.lit(0.5)),
            F.coalesce("relevancy", F.lit(0.5)), F.coalesce("is_relevant", F.lit(True)), F.col("text_confidence"),
        )
    )


def leading_split(df: DataFrame, value: Column, tie: str, share: float = 0.8) -> DataFrame:
    """Adds ``is_train``: the first ``share`` of the rows in the given order."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = global_row_number(df, value, tie, "_rn")
    return out.withColumn("is_train", F.col("_rn") <= F.floor(total * share)).drop("_rn")


def training_table(df: DataFrame) -> DataFrame:
    """Past pipeline results as training rows."""
    return df.select(
        "review_id",
        F.col("p_bad").alias("stage1_p_bad"),
        F.col("enhanced_prob").alias("stage2_enhanced_prob"),
        F.col("relevancy").alias("stage3_relevancy"),
        F.col("is_relevant").cast("int").alias("stage3_relevant"),
        F.col("text_confidence").alias("stage1_confidence"),
        "final_prediction",
        F.col("final_code"),
    )


def target_decision(label: Column, row_key: Column) -> Column:
    """Training decision from the text class; irrelevant rows are split 60/40 by a hash of the row."""
    draw = F.pmod(F.xxhash64(row_key, F.lit(42)), F.lit(10))
    return (
        F.when(label.startswith("genuine"), DECISIONS[0])
        .when(label.isin("spam", "advertisement", "fake_rant", "inappropriate"), DECISIONS[3])
        .when((label == "irrelevant") & (draw < 6), DECISIONS[2])
        .otherwise(DECISIONS[1])
    )


FIT_ROWS = 20_000  # documented bound of the labelled rows in a fit


def _stable_unit(row_key: str, seed: int = 11) -> Column:
    return F.pmod(F.xxhash64(row_key, F.lit(seed)), F.lit(2**53)).cast("double") / float(2**53)


def fit_sample(df: DataFrame, row_key: str = "review_id", rows: int = FIT_ROWS) -> DataFrame:
    """The labelled rows that a model is fitted on: at most ``rows``, those with the smallest hash."""
    return smallest(df, F.xxhash64(row_key, F.lit(3)), rows, row_key)


def stratified_folds(df: DataFrame, row_key: str, label: str = "code", folds: int = 5, out: str = "fold") -> DataFrame:
    """Fold number in turn over the rows of each class in hash order, so every fold has the same share of it.

    Meant for the bounded rows of :func:`fit_sample`: a class is ordered in one window.
    """
    turn = Window.partitionBy(label).orderBy(F.xxhash64(row_key, F.lit(7)), row_key)
    return df.withColumn(out, ((F.row_number().over(turn) - 1) % folds).cast("int"))


def class_weights(df: DataFrame, label: str, out: str = "weight", given: dict | None = None) -> DataFrame:
    """Inverse class frequency weights, or given ones per class."""
    if given is not None:
        return df.withColumn(out, lookup(given, F.col(label), F.lit(1.0)))
    counts = cut_lineage(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")))
    totals = counts.agg(F.struct(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    weights = counts.withColumn("_t", totals).select(
        label, (F.col("_t.n") / (F.col("_t.k") * F.col("_n"))).alias(out)
    )
    # Rows without a label stay, with weight 1. Spark broadcasts the weights if the labels are few.
    joined = df.join(weights.withColumnRenamed(label, "_label"), F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
    return joined.withColumn(out, F.when(F.col(label).isNull(), 1.0).otherwise(F.col(out)))


def assembler(features=FEATURE_COLUMNS) -> list:
    return [
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
    ]


@dataclass
class OneVsRestBoosting:
    """Four binary boosted ensembles whose positive probabilities are normalised per row."""

    rounds: int = 200
    rate: float = 0.1
    depth: int = 6
    label: str = "code"
    trees: list[dict] = field(default_factory=list)

    def fit(self, df: DataFrame) -> "OneVsRestBoosting":
        rows = fit_sample(df.select("review_id", vector_to_array("features").alias("x"), self.label))
        self.trees = boosting.fit(rows, "x", self.label, len(DECISIONS), self.rounds, self.rate, self.depth)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        probs = boosting.probabilities(df.sparkSession, self.trees, len(DECISIONS), self.depth, vector_to_array("features"))
        return df.withColumn("decision_probs", probs)

    def first(self, rounds: int) -> "OneVsRestBoosting":
        """The ensemble after its first rounds of each class."""
        trees = [t for c in range(len(DECISIONS)) for t in [t for t in self.trees if t["cls"] == c][:rounds]]
        return OneVsRestBoosting(rounds, self.rate, self.depth, self.label, trees)

    def importances(self):
        """Share of the summed gains per feature, the mean over the classes."""
        import numpy as np

        sums = [np.sum([t["gains"] for t in self.trees if t["cls"] == c], axis=0) for c in range(len(DECISIONS))]
        return np.mean([s / max(s.sum(), 1e-12) for s in sums], axis=0)

    def save(self, spark, path: str) -> None:
        rows = [{**t, "number": i, "depth": self.depth} for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, boosting.SCHEMA + ", number int, depth int").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "OneVsRestBoosting":
        rows = [r.asDict() for r in spark.read.parquet(path).orderBy("number").collect()]
        return cls(depth=rows[0]["depth"], trees=rows)


def make_classifier(kind: str, label: str = "code", **params):
    common = {"labelCol": label, "featuresCol": "features"}
    if kind == "random_forest":
        return RandomForestClassifier(**common, seed=42, **{"numTrees": 200, "maxDepth": 10, **params})
    if kind == "neural_network":
        layers = params.pop("layers", [len(FEATURE_COLUMNS), 100, 50, len(DECISIONS)])
        return MultilayerPerceptronClassifier(**common, layers=layers, seed=42, **{"maxIter": 1000, **params})
    if kind == "logistic":
        return LogisticRegression(**common, family="multinomial", **{"maxIter": 1000, **params})
    raise ValueError(f"unknown classifier: {kind}")


@dataclass
class FusionModel:
    """Scaled features and a classifier over the four decisions."""

    kind: str = "boosting"
    params: dict = field(default_factory=dict)
    scaler: PipelineModel | None = None
    model: object | None = None

    def fit(self, df: DataFrame) -> "FusionModel":
        self.scaler = Pipeline(stages=assembler()).fit(df)
        ready = self.scaler.transform(df).select("features", "code", "review_id")
        if self.kind == "boosting":
            self.model = OneVsRestBoosting(**self.params).fit(ready)
        else:
            self.model = make_classifier(self.kind, **self.params).fit(ready)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self.scaler.transform(df))
        if self.kind != "boosting":
            out = out.withColumn("decision_probs", vector_to_array("probability")).drop(
                "rawPrediction", "probability", "prediction"
            )
        return out.drop("_raw", "features")

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.transform(df).withColumns(R.argmax_decision(F.col("decision_probs")))
        return out.withColumn("routing_decision", R.route(F.col("final_prediction")))

    def predict_with_thresholds(self, df: DataFrame, **cuts) -> DataFrame:
        out = self.transform(df).withColumns(R.threshold_decision(F.col("decision_probs"), **cuts))
        return out.withColumn("routing_decision", R.route(F.col("final_prediction")))

    def importances(self, k: int = 10) -> list[tuple[str, float]]:
        values = (
            self.model.importances() if self.kind == "boosting" else self.model.featureImportances.toArray()
        )
        ranked = sorted(zip(FUSION_FEATURES, map(float, values)), key=lambda x: (-x[1], x[0]))
        return ranked[:k]

    def save(self, spark, path: str) -> None:
        self.scaler.write().overwrite().save(f"{path}/scaler")
        if self.kind == "boosting":
            self.model.save(spark, f"{path}/model")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        rows = [("kind", self.kind), *[(k, str(v)) for k, v in self.params.items()],
                ("features", ",".join(FEATURE_COLUMNS))]
        spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")

    @classmethod
    def load(cls, spark, path: str) -> "FusionModel":
        from pyspark.ml.classification import (
            LogisticRegressionModel,
            MultilayerPerceptronClassificationModel,
            RandomForestClassificationModel,
        )

        rows = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/parameters").collect()}
        loaders = {
            "random_forest": RandomForestClassificationModel,
            "neural_network": MultilayerPerceptronClassificationModel,
            "logistic": LogisticRegressionModel,
        }
        kind = rows["kind"]
        model = OneVsRestBoosting.load(spark, f"{path}/model") if kind == "boosting" else loaders[kind].load(f"{path}/model")
        return cls(kind, {}, PipelineModel.load(f"{path}/scaler"), model)


def accuracy(df: DataFrame, predicted: str = "final_prediction", truth: str = "decision") -> DataFrame:
    return df.agg(F.avg((F.col(predicted) == F.col(truth)).cast("double")).alias("accuracy"))


GRIDS = {
    "random_forest": {"numTrees": [100, 200, 300], "maxDepth": [6, 10, 14], "minInstancesPerNode": [2, 5, 10]},
    "boosting": {"maxIter": [100, 200, 300], "stepSize": [0.05, 0.1, 0.2], "maxDepth": [4, 6, 8]},
    "neural_network": {"hidden": [(50,), (100,), (100, 50), (150, 75)], "stepSize": [0.001, 0.01, 0.1]},
}


def cross_validate(df: DataFrame, estimator, grid=None, folds: int = 5, parallelism: int = 4, label: str = "code"):
    """Cross validation on stratified folds. Gives the fitted validator (averages and deviations per setting)."""
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid or ParamGridBuilder().build(),
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
        collectSubModels=False,
    ).fit(cut_lineage(stratified_folds(df, "review_id", label, folds)))


def search(df: DataFrame, grids: dict[str, dict] | None = None, folds: int = 5) -> DataFrame:
    """Every setting of every family in ``grids`` (all of ``GRIDS``) on stratified folds of at most ``FIT_ROWS`` rows, in one job.

    Accuracies are those of the bounded rows, each held out once.
    """
    rows = cut_lineage(stratified_folds(fit_sample(df), "review_id", folds=folds))
    return gridsearch.grid_search(rows, grids or GRIDS, list(FEATURE_COLUMNS), "code", len(DECISIONS), folds)


def population_scaled(df: DataFrame) -> DataFrame:
    return standardise(filled(df, FEATURE_COLUMNS), FEATURE_COLUMNS)

"""A trainable 7-class text classifier and the record of its training runs."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity.constants import TEXT_CLASSES
from probity.functions import vectors as V
from probity.operators.fusion import _stable_unit, class_weights
from probity.operators.metrics import known_labels
from probity.session import cut_lineage

RUNS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("minutes", T.DoubleType()),
        T.StructField("path", T.StringType()),
        T.StructField("finished_at", T.TimestampType()),
    ]
)


def labelled(df: DataFrame, label: str = "label") -> DataFrame:
    code = V.lookup({c: float(i) for i, c in enumerate(TEXT_CLASSES)}, F.col(label), F.lit(None).cast("double"))
    known = df.filter(F.col(label).isin(TEXT_CLASSES)) if TERMS in df.columns else known_labels(df, label)
    return known.withColumn("code", code)


def train_text_model(
    df: DataFrame, balanced: bool = False, label: str = "label", features: int = 1 << 16, iterations: int = 20
) -> PipelineModel:
    """Hashed TF-IDF and multinomial logistic regression; ``balanced`` weighs classes by inverse frequency.

    Texts are read and split once: the frequencies and the regression are fitted on the stored term counts (``df`` may bring them
    along in ``TERMS``, see :func:`with_terms`).
    """
    split = term_stages(features)
    rows = labelled(df, label)
    if TERMS not in df.columns:
        rows = cut_lineage(PipelineModel(split).transform(rows).select(TERMS, label, "code"))
    rows = rows.select(TERMS, label, "code")
    rows = class_weights(rows, label) if balanced else rows.withColumn("weight", F.lit(1.0))
    stages = [
        IDF(inputCol=TERMS, outputCol="features", minDocFreq=2),
        LogisticRegression(
            labelCol="code", featuresCol="features", weightCol="weight", family="multinomial", maxIter=iterations
        ),
    ]
    return PipelineModel([*split, *Pipeline(stages=stages).fit(rows).stages])


TERMS = "_tf"


def term_stages(features: int = 1 << 16) -> list:
    return [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"\W+"),
        HashingTF(inputCol="_words", outputCol=TERMS, numFeatures=features),
    ]


def with_terms(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows with a known label, stored with their term counts in place of the text."""
    rows = known_labels(df, label)
    return cut_lineage(PipelineModel(term_stages()).transform(rows).drop("text", "_words"))


def text_model_scores(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Class probabilities, first largest class, its confidence and bad mass from a trained model.

    Rows that bring their term counts (:func:`with_terms`) are not split again.
    """
    split = TERMS in df.columns
    ready = df if split else df.withColumn("_text", F.col("text")).withColumn("text", F.coalesce("text", F.lit("")))
    probs = vector_to_array("probability")
    # A model trained without the last classes has shorter vectors: they get probability 0.
    padded = F.concat(probs, F.array_repeat(F.lit(0.0), F.lit(len(TEXT_CLASSES)) - F.size(probs)))
    out = (PipelineModel(model.stages[2:]) if split else model).transform(ready).withColumn("probs", padded)
    out = out.drop("text", "_words", "_tf", "features", "rawPrediction", "probability", "prediction")
    p = F.col("probs")
    return out.withColumnRenamed("_text", "text").withColumns(
        {
            "text_prediction": V.argmax_label(p),
            "text_confidence": F.array_max(p),
            "p_bad": F.aggregate(F.slice(p, 3, 5), F.lit(0.0), lambda a, x: a + x),
            "model_type": F.lit("fine_tuned"),
        }
    )


def training_runs(spark: SparkSession, jobs: dict, folder: str | None = None) -> DataFrame:
    """Runs named training jobs and records outcome and duration; a failed job is a row, not an end."""
    rows = []
    for name, job in jobs.items():
        start = time.time()
        path = f"{folder}/{name}" if folder else None
        try:
            model = job()
            if path:
                model.write().overwrite().save(path)
            done = True
        except Exception:  # noqa: BLE001 - recorded as unsuccessful
            done = False
        took = time.time() - start
        rows.append((name, done, took, took / 60, path if done else None, datetime.now(timezone.utc)))
    return spark.createDataFrame(rows, RUNS)


def rebalance(df: DataFrame, label: str, factors: dict[str, float], row_key: str = "review_id") -> DataFrame:
    """Over- and under-sampling: each row of a class is repeated ``factor`` times on average.

    The fractional part is settled by a hash of the row, so the same rows come out on every run.
    """
    factor = V.lookup({k: float(v) for k, v in factors.items()}, F.col(label), F.lit(1.0))
    whole = F.floor(factor)
    copies = (whole + (_stable_unit(row_key) < factor - whole).cast("long")).cast("int")
    out = df.withColumn("_copies", copies).filter("_copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")

"""Text scoring: the rule scorer, scorer choice, pluggable batch model and the tester path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity.constants import TEXT_CLASSES
from probity.functions import risk as R
from probity.functions import text as X
from probity.functions import vectors as V

SCRATCH = [
    "spam_hits", "ad_hits", "extreme_hits", "inappropriate_hits", "positive_hits", "negative_hits",
    "has_link", "rule_length",
]


def rule_scores(df: DataFrame, text: str = "text", keep_signals: bool = False) -> DataFrame:
    """Adds text_prediction, text_confidence, class_probabilities, p_bad and model_type."""
    label, conf = F.col("text_prediction"), F.col("text_confidence")
    out = X.with_rule_class(df, text)
    out = out.withColumn("text_confidence", X.rule_confidence(label))
    out = out.withColumn("probs", X.rule_probs(label, conf))
    out = out.withColumn("class_probabilities", V.as_map(F.col("probs")))
    out = out.withColumns(
        {"p_bad": X.rule_p_bad(label), "model_type": F.lit("rules")}
    )
    return out if keep_signals else out.drop(*SCRATCH)


def text_features(df: DataFrame) -> DataFrame:
    """Confidence, risk and quality columns of the anomaly stage from a scored table."""
    probs = F.col("class_probabilities")
    out = df.withColumns(
        {
            "text_quality_risk": F.col("p_bad"),
            "text_high_quality_score": V.genuine_mass(probs),
            "text_spam_prob": V.class_prob(probs, "spam"),
            "text_ad_prob": V.class_prob(probs, "advertisement"),
        }
    )
    return out.withColumns(
        {
            "text_weighted_quality": F.col("text_high_quality_score") * F.col("text_confidence"),
            "text_weighted_risk": F.col("text_quality_risk") * F.col("text_confidence"),
        }
    )


def logits_scores(df: DataFrame, logits: Column, temperature: float = 1.0) -> DataFrame:
    """Scores from raw class logits: probabilities, first largest class, its confidence, bad mass."""
    probs = F.col("probs")
    out = df.withColumn("probs", V.softmax(logits, temperature))
    return out.withColumns(
        {
            "text_prediction": V.argmax_label(probs),
            "text_confidence": F.array_max(probs),
            "p_bad": V.array_sum(F.slice(probs, 3, 5)),
        }
    )


def zero_shot_scores(df: DataFrame, categories: dict, labels: str = "labels", scores: str = "scores") -> DataFrame:
    out = df.withColumn(
        "class_probabilities", V.zero_shot_map(F.col(labels), F.col(scores), categories)
    )
    return out.withColumns(
        {
            "text_prediction": V.lookup(
                {k: F.lit(v) for k, v in categories.items()}, F.element_at(F.col(labels), 1), F.lit("spam")
            ),
            "text_confidence": F.element_at(F.col(scores), 1),
            "p_bad": V.bad_mass(F.col("class_probabilities")),
            "model_type": F.lit("zero_shot"),
        }
    )


FALLBACKS = {
    # scorer: (prediction, confidence, p_bad, probability of every class, model_type)
    "zero_shot": ("spam", 0.0, 1.0, 0.0, "zero_shot_fallback"),
    "rules": ("genuine_positive", 0.5, 0.5, 1.0 / 7, "basic_fallback"),
    "tester": ("error", 0.0, 0.5, 0.0, "error"),
}


def with_fallback(df: DataFrame, scorer: str) -> DataFrame:
    """Rows whose scorer gave nothing get the scorer's default row, its probabilities and model type, and ``is_error`` true."""
    name, conf, p_bad, each, kind = FALLBACKS[scorer]
    failed = F.col("text_prediction").isNull()
    return df.withColumn("is_error", failed).withColumns(
        {
            "text_prediction": F.coalesce("text_prediction", F.lit(name)),
            "text_confidence": F.when(F.col("is_error"), conf).otherwise(F.col("text_confidence")),
            "p_bad": F.when(F.col("is_error"), p_bad).otherwise(F.col("p_bad")),
            "class_probabilities": F.when(F.col("is_error"), _uniform(each)).otherwise(F.col("class_probabilities")),
            "model_type": F.when(F.col("is_error"), kind).otherwise(F.col("model_type")),
        }
    )


def _uniform(p: float) -> Column:
    """The same probability for every class, as a map."""
    return F.map_from_arrays(V.label_array(), F.array_repeat(F.lit(p), len(TEXT_CLASSES)))


def choose_scorer(fine_tuned: Callable | None = None, zero_shot: Callable | None = None):
    """First available of fine-tuned model, zero-shot model, rules. Chosen when the plan is built."""
    if fine_tuned is not None:
        return "fine_tuned", fine_tuned
    if zero_shot is not None:
        return "zero_shot", zero_shot
    return "rules", rule_scores


def model_scores(df: DataFrame, make_model: Callable, batch_size: int = 16, text: str = "text") -> DataFrame:
    """Scores with any model: ``make_model()`` runs once per Python worker and returns a function
    from an array of texts to an (n, 7) array of logits. Whole texts are handed over."""
    logits = predict_batch_udf(
        make_model, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size
    )
    scored = df.withColumn("_logits", logits(F.coalesce(F.col(text), F.lit(""))))
    scored = logits_scores(scored, F.col("_logits"))
    return scored.drop("_logits").withColumn("model_type", F.lit("fine_tuned"))


def tester_scores(df: DataFrame, text: str = "text", stars: str = "stars") -> DataFrame:
    """The path every review takes: rules, rating rule, weighted fusion, tier."""
    out = X.with_rule_class(df, text).drop(*SCRATCH)
    label, conf = F.col("text_prediction"), F.col("text_confidence")
    out = out.withColumn("text_confidence", X.rule_confidence(label))
    out = out.withColumns(
        {
            "p_bad": X.rule_p_bad(label),
            "text_binary": X.binary_class(label),
            "binary_confidence": X.binary_confidence(label, conf),
            **R.rating_rule(F.col(stars)),
        }
    )
    out = out.withColumn(
        "fusion_risk_score", R.weighted_risk(F.col("p_bad"), F.col("metadata_anomaly_score"))
    )
    return out.withColumns(
        {
            "fusion_prediction": R.tier(F.col("fusion_risk_score")),
            "fusion_confidence": R.tier_confidence(F.col("fusion_risk_score")),
        }
    )


def serving_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """The serving path: rules, class to decision, simple fusion, route and nested breakdown."""
    out = X.with_rule_class(df, text).drop(*SCRATCH)
    label, conf = F.col("text_prediction"), F.col("text_confidence")
    out = out.withColumn("text_confidence", X.rule_confidence(label))
    out = out.withColumns(
        {
            "p_bad": X.rule_p_bad(label),
            "metadata_anomaly_score": F.lit(0.3),
            "final_prediction": R.serving_decision(label),
            "final_confidence": conf,
        }
    )
    out = out.withColumns(
        {
            "fusion_score": R.simple_fusion(F.col("p_bad")),
            "routing_decision": R.route(F.col("final_prediction")),
        }
    )
    return out.withColumn("routing_description", R.route_description(F.col("routing_decision")))


def stage_analysis() -> Column:
    """Nested breakdown of one scored row."""
    return F.struct(
        F.struct(
            F.col("text_prediction").alias("prediction"), F.col("text_confidence").alias("confidence")
        ).alias("stage1_text"),
        F.struct(F.col("metadata_anomaly_score").alias("anomaly_score")).alias("stage2_metadata"),
        F.struct(
            F.col("final_prediction"), F.col("final_confidence"), F.col("fusion_score")
        ).alias("stage3_fusion"),
    )

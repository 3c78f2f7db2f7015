"""Risk scores, tiers, decisions and routes as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from probity.constants import (
    DECISIONS,
    HIGH_RISK_VIOLATION,
    ROUTE_DESCRIPTIONS,
    ROUTES,
    SERVING_DECISION,
    TIER_CUTS,
    TIERS,
    TRUTH_DECISION,
    UNKNOWN_ROUTE,
    VIOLATION_NAMES,
)
from probity.functions.vectors import argmax_index, label_array, let, lookup


def steps(value: Column, cuts, names) -> Column:
    """First name whose upper cut lies above the value; the last name otherwise."""
    chain = None
    for cut, name in zip(cuts, names):
        cond = value < cut
        chain = F.when(cond, name) if chain is None else chain.when(cond, name)
    return chain.otherwise(names[len(cuts)])


def extreme_rating(stars: Column) -> Column:
    return F.coalesce((stars <= 1) | (stars >= 5), F.lit(False))


def rating_rule(stars: Column) -> dict[str, Column]:
    odd = extreme_rating(stars)
    return {
        "metadata_anomaly_score": F.when(odd, 0.7).otherwise(0.3),
        "metadata_is_anomaly": odd,
        "metadata_risk_level": F.when(odd, "high").otherwise("medium"),
    }


def risk_level(score: Column) -> Column:
    return steps(score, (0.3, 0.7), ["low", "medium", "high"])


def display_risk_level(score: Column) -> Column:
    return F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low")


def to_probability(score: Column) -> Column:
    return (score + 1) / 2


def weighted_risk(text_risk: Column, metadata: Column) -> Column:
    return F.coalesce(text_risk, F.lit(0.5)) * 0.7 + F.coalesce(metadata, F.lit(0.3)) * 0.3


def tier(risk: Column, cuts=TIER_CUTS) -> Column:
    return steps(risk, cuts, TIERS)


def tier_confidence(risk: Column) -> Column:
    return F.abs(risk - 0.5) * 2


def decision_code(decision: Column) -> Column:
    return lookup({d: i for i, d in enumerate(DECISIONS)}, decision, F.lit(0))


def decision_name(code: Column) -> Column:
    return F.try_element_at(label_array(DECISIONS), code + 1)


def route(decision: Column) -> Column:
    return lookup(ROUTES, decision, F.lit(None).cast("string"))


def route_description(route_name: Column) -> Column:
    return lookup(
        ROUTE_DESCRIPTIONS, route_name, F.lit(UNKNOWN_ROUTE)
    )


def serving_decision(label: Column) -> Column:
    return lookup(SERVING_DECISION, label, F.lit("suspicious"))


def truth_decision(label: Column) -> Column:
    return lookup(TRUTH_DECISION, label, F.lit("suspicious"))


def argmax_decision(probs: Column) -> dict[str, Column]:
    return {
        "final_prediction": F.element_at(label_array(DECISIONS), argmax_index(probs)),
        "final_confidence": F.array_max(probs),
        "fusion_score": F.element_at(probs, 4),
    }


def threshold_decision(probs: Column, spam=0.35, genuine=0.25, low_quality=0.15) -> dict[str, Column]:
    """Spam first, then genuine, then low quality; whatever is left is suspicious."""

    def cascade(p: Column, values) -> Column:
        return (
            F.when(F.element_at(p, 4) >= spam, values[3])
            .when(F.element_at(p, 1) >= genuine, values[0])
            .when(F.element_at(p, 3) >= low_quality, values[2])
            .otherwise(values[1])
        )

    return {
        "final_prediction": let(probs, lambda p: cascade(p, DECISIONS)),
        "final_confidence": let(probs, lambda p: cascade(p, [F.element_at(p, i) for i in (1, 2, 3, 4)])),
        "fusion_score": F.element_at(probs, 4),
    }


def decision_probs(text_probs: Column) -> Column:
    """4 decision masses from 7 class probabilities, by the evaluation map of classes."""

    def masses(v: Column) -> Column:
        p = [F.element_at(v, i + 1) for i in range(7)]
        return F.array(p[0] + p[1], p[5], p[4], p[2] + p[3] + p[6])

    return let(text_probs, masses)


def simple_fusion(p_bad: Column, anomaly: float = 0.3) -> Column:
    return (p_bad + anomaly) / 2


def combined_spam_score(risk: Column, confidence: Column, anomaly: Column) -> Column:
    return risk * confidence * 0.6 + anomaly * 0.4


def four_stage_score(text_risk: Column, metadata: Column, relevancy: Column, relevant: Column) -> Column:
    mixed = 0.4 * text_risk + 0.3 * metadata + 0.3 * (1 - relevancy)
    return F.when(relevant, mixed).otherwise(0.95)


def four_stage_tier(score: Column) -> Column:
    return steps(score, (0.4, 0.6, 0.8), DECISIONS)


def vote(a: Column, b: Column, c: Column) -> Column:
    """Two of three models that say genuine or spam win; anything else is suspicious."""

    def two(name):
        return (a == name).cast("int") + (b == name).cast("int") + (c == name).cast("int") >= 2

    return (
        F.when(two(DECISIONS[0]), DECISIONS[0])
        .when(two(DECISIONS[3]), DECISIONS[3])
        .otherwise(DECISIONS[1])
    )


def violations(label: Column, p_bad: Column) -> Column:
    named = lookup(VIOLATION_NAMES, label, F.lit(None).cast("string"))
    marks = F.array(named, F.when(p_bad > 0.7, HIGH_RISK_VIOLATION))
    return F.filter(marks, lambda m: m.isNotNull())


def confidence_bin(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.9, "high")
        .when(confidence >= 0.8, "good")
        .when(confidence >= 0.7, "medium")
        .otherwise("low")
    )


def risk_bin(risk: Column) -> Column:
    return steps(risk, (0.2, 0.4, 0.6, 0.8), ["very_low", "low", "medium", "high", "very_high"])


def heat_bin(risk: Column) -> Column:
    return (
        F.when(risk > 0.8, "critical")
        .when(risk >= 0.6, "high")
        .when(risk >= 0.4, "medium")
        .otherwise("low")
    )


def severity(percent: Column) -> Column:
    return F.when(percent >= 80, "high").when(percent >= 60, "medium").otherwise("low")

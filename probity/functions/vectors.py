"""Class-probability vectors as ``array<double>`` in canonical class order, and label maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from probity.constants import BAD_CLASSES, GENUINE_CLASSES, TEXT_CLASS_WEIGHTS, TEXT_CLASSES


def label_array(labels=TEXT_CLASSES) -> Column:
    return F.array(*[F.lit(x) for x in labels])


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[x if isinstance(x, Column) else F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: dict, key: Column, default) -> Column:
    """Value of ``key`` in a small fixed mapping, ``default`` where absent or NULL.

    The key is named once: a CASE would repeat it per entry, and the whole text rule with it when a
    filter on the result is pushed down.
    """
    return F.coalesce(F.try_element_at(literal_map(mapping), key), default)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value named once, however often the body uses it.

    Filters pushed below a projection repeat every named column in full; a lambda variable is evaluated
    once per row instead.
    """
    return F.get(F.transform(F.array(value), body), 0)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, e: acc + e)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    def raised(v: Column, top: Column) -> Column:
        return F.transform(v, lambda z: F.exp((z - top) / F.lit(float(temperature))))

    def normalised(r: Column) -> Column:
        return let(array_sum(r), lambda total: F.transform(r, lambda e: e / total))

    return let(logits, lambda v: let(F.array_max(v), lambda top: let(raised(v, top), normalised)))


def argmax_index(probs: Column) -> Column:
    """1-based position of the largest entry; the first one on ties."""
    return let(probs, lambda p: F.array_position(p, F.array_max(p)).cast("int"))


def argmax_label(probs: Column, labels=TEXT_CLASSES) -> Column:
    return F.element_at(label_array(labels), argmax_index(probs))


def as_map(probs: Column, labels=TEXT_CLASSES) -> Column:
    return F.map_from_arrays(label_array(labels), probs)


def class_prob(prob_map: Column, label: str) -> Column:
    return F.coalesce(F.element_at(prob_map, F.lit(label)), F.lit(0.0))


def _total(columns) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def bad_mass(prob_map: Column) -> Column:
    return _total([class_prob(prob_map, c) for c in BAD_CLASSES])


def genuine_mass(prob_map: Column) -> Column:
    return _total([class_prob(prob_map, c) for c in GENUINE_CLASSES])


def class_weighted_score(probs: Column, weights=TEXT_CLASS_WEIGHTS) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return array_sum(F.zip_with(probs, w, lambda p, q: p * q))


def entropy(probs: Column) -> Column:
    return F.aggregate(
        probs,
        F.lit(0.0),
        lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0)),
    )


def wide_columns(prob_map: Column, prefix: str = "prob_", labels=TEXT_CLASSES) -> list[Column]:
    return [class_prob(prob_map, c).alias(f"{prefix}{c}") for c in labels]


def top_classes(prob_map: Column, k: int = 3) -> Column:
    """The k most probable classes as an array of (label, p); ties in name order."""
    entries = F.transform(
        F.map_entries(prob_map),
        lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("label")),
    )
    ordered = F.slice(F.array_sort(entries), 1, k)
    return F.transform(
        ordered, lambda e: F.struct(e["label"].alias("label"), (-e["neg"]).alias("p"))
    )


def zero_shot_map(labels: Column, scores: Column, categories: dict) -> Column:
    """7-class map from ranked (labels, scores); unknown names count as spam, absent classes 0.

    When two names fall on the same class the later one stays, so entries are folded in order.
    """
    named = F.transform(labels, lambda x: lookup(categories, x, F.lit("spam")))
    return F.map_from_arrays(
        label_array(),
        F.transform(
            label_array(),
            lambda c: F.coalesce(
                F.try_element_at(
                    F.filter(
                        F.zip_with(named, scores, lambda n, s: F.when(n == c, s)),
                        lambda s: s.isNotNull(),
                    ),
                    F.lit(-1),
                ),
                F.lit(0.0),
            ),
        ),
    )

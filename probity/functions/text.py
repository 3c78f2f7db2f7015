"""Text measures and the rule-based text class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from probity.constants import (
    AD_TERMS,
    BAD_CLASSES,
    CATEGORY_TERMS,
    EXTREME_TERMS,
    GENUINE_CLASSES,
    INAPPROPRIATE_TERMS,
    NEGATIVE_TERMS,
    OFF_TOPIC_TERMS,
    POSITIVE_TERMS,
    PRAISE_PHRASES,
    RULE_BASE_MASS,
    RULE_CONFIDENCE,
    SPAM_TERMS,
    TEXT_CLASSES,
)
from probity.functions.vectors import label_array, let, lookup


def lexicon_hits(lowered: Column, terms) -> Column:
    """How many of the terms occur in the lower-cased text (each counted once)."""
    total = F.lit(0)
    for term in terms:
        total = total + F.contains(lowered, F.lit(term)).cast("int")
    return total


# Every term of the rules and of the topics, each with a bit of its own in its list.
RULE_TERMS = list(
    dict.fromkeys([*SPAM_TERMS, *AD_TERMS, *EXTREME_TERMS, *INAPPROPRIATE_TERMS, *POSITIVE_TERMS, *NEGATIVE_TERMS, *OFF_TOPIC_TERMS])
)
TOPIC_TERMS = list(dict.fromkeys([*PRAISE_PHRASES, *[t for terms in CATEGORY_TERMS.values() for t in terms]]))

# Columns with these names hold what is known of the column ``text`` of the same rows (see ``plans.reviews``).
MEASURES = [
    f"text_measure_{n}"
    for n in ("rule_bits", "topic_bits", "words", "length", "solid", "upper", "exclamations", "distinct", "digest", "names_location")
]


def term_bits(lowered: Column, terms: list[str]) -> Column:
    """The terms (at most 63) that occur in the lower-cased text, a bit for each; null for no text.

    The terms are an array that is gone through, with the text named once: written out as a sum, the text is lower-cased again for every
    term, and the method that Spark makes of it is too long to be compiled.
    """
    bits = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(1 << i).cast("long").alias("bit")) for i, t in enumerate(terms)])

    def found(low: Column) -> Column:
        return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, t: acc + F.contains(low, t["term"]).cast("long") * t["bit"])

    return let(lowered, found)


def bit_mask(terms, among: list[str]) -> int:
    return sum(1 << among.index(t) for t in set(terms))


def bit_hits(bits: Column, terms, among: list[str]) -> Column:
    """How many of the terms have their bit set."""
    return F.bit_count(bits.bitwiseAND(F.lit(bit_mask(terms, among)).cast("long")))


def measure(name: str) -> Column:
    return F.col(f"text_measure_{name}")


def measured(df, text: str = "text") -> bool:
    """Do the rows bring measures of this column along?"""
    return text == "text" and set(MEASURES) <= set(df.columns)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


# Unicode white space, as the word pattern sees it.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def word_count(text: Column) -> Column:
    """White-space separated words."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def solid_length(text: Column) -> Column:
    """Characters outside white space."""
    return F.length(F.translate(text, WHITE_SPACE, ""))


def mean_word_length(text: Column, n_words: Column, solid: Column | None = None) -> Column:
    """Characters outside white space (``solid``, if known) over words; 0 for a text without words."""
    solid = solid_length(text) if solid is None else solid
    return F.coalesce(F.try_divide(solid, n_words), F.when(n_words.isNotNull(), F.lit(0.0)))


def has_upper(text: Column) -> Column:
    return text.rlike(r"\p{Lu}").cast("int")


def has_digit(text: Column) -> Column:
    return text.rlike(r"\d").cast("int")


def rule_signals(df, text: str = "text"):
    """Adds the hit counts the rule class needs, so that the text is lower-cased once per row; taken from its measures if the rows have them."""
    if measured(df, text):
        hits = {
            "spam_hits": SPAM_TERMS, "ad_hits": AD_TERMS, "extreme_hits": EXTREME_TERMS, "inappropriate_hits": INAPPROPRIATE_TERMS,
            "positive_hits": POSITIVE_TERMS, "negative_hits": NEGATIVE_TERMS,
        }
        found = {k: bit_hits(measure("rule_bits"), terms, RULE_TERMS) for k, terms in hits.items()}
        link = bit_hits(measure("rule_bits"), ["http"], RULE_TERMS) > 0
        return df.withColumns({**found, "has_link": link, "rule_length": F.coalesce(measure("length"), F.lit(0))})
    filled = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_lower", F.lower(filled))
    low = F.col("_lower")
    return df.withColumns(
        {
            "spam_hits": lexicon_hits(low, SPAM_TERMS),
            "ad_hits": lexicon_hits(low, AD_TERMS),
            "extreme_hits": lexicon_hits(low, EXTREME_TERMS),
            "inappropriate_hits": lexicon_hits(low, INAPPROPRIATE_TERMS),
            "positive_hits": lexicon_hits(low, POSITIVE_TERMS),
            "negative_hits": lexicon_hits(low, NEGATIVE_TERMS),
            "has_link": F.contains(low, F.lit("http")),
            "rule_length": F.length(filled),
        }
    ).drop("_lower")


def rule_class(text: str = "text", n_words: Column | None = None) -> Column:
    """Ordered cascade over the columns of :func:`rule_signals`.

    Words are counted only for a text with three extreme terms, unless their number is given.
    """
    short = (word_count(F.coalesce(F.col(text), F.lit(""))) if n_words is None else n_words) < 20
    return (
        F.when((F.col("spam_hits") >= 2) | F.col("has_link"), "spam")
        .when(F.col("ad_hits") >= 2, "advertisement")
        .when((F.col("extreme_hits") >= 3) & short, "fake_rant")
        .when(F.col("rule_length") < 10, "irrelevant")
        .when(F.col("inappropriate_hits") >= 1, "inappropriate")
        .when(F.col("negative_hits") > F.col("positive_hits"), "genuine_negative")
        .otherwise("genuine_positive")
    )


def with_rule_class(df, text: str = "text"):
    """Adds the columns of :func:`rule_signals` and ``text_prediction``."""
    n_words = F.coalesce(measure("words"), F.lit(0)) if measured(df, text) else None
    return rule_signals(df, text).withColumn("text_prediction", rule_class(text, n_words))


def rule_confidence(label: Column) -> Column:
    return lookup({c: RULE_CONFIDENCE[c] for c in BAD_CLASSES}, label, F.lit(RULE_CONFIDENCE["genuine"]))


def rule_p_bad(label: Column) -> Column:
    """Bad mass of the rule vector by class: (c + 4 base) / (c + 6 base) for a bad class of confidence c."""
    rest = RULE_BASE_MASS * 4
    total = RULE_BASE_MASS * 6
    bad = {c: (RULE_CONFIDENCE[c] + rest) / (RULE_CONFIDENCE[c] + total) for c in BAD_CLASSES}
    genuine = RULE_BASE_MASS * 5 / (RULE_CONFIDENCE["genuine"] + total)
    return lookup(bad, label, F.lit(genuine))


def rule_probs(label: Column, confidence: Column) -> Column:
    """Base mass for every class, the confidence for the chosen one, normalised to sum 1."""
    total = confidence + F.lit(RULE_BASE_MASS * (len(TEXT_CLASSES) - 1))
    return F.transform(
        label_array(),
        lambda c: F.when(c == label, confidence).otherwise(F.lit(RULE_BASE_MASS)) / total,
    )


def binary_class(label: Column) -> Column:
    return F.when(label.isin(GENUINE_CLASSES), "genuine").otherwise("non_genuine")


def binary_confidence(label: Column, confidence: Column) -> Column:
    return F.when(label.isin(GENUINE_CLASSES), confidence).otherwise(1 - confidence)


def non_genuine_probability(label: Column, confidence: Column) -> Column:
    return F.when(label.isin(GENUINE_CLASSES), 1 - confidence).otherwise(confidence)


def is_bad(label: Column) -> Column:
    return F.coalesce(label.isin(BAD_CLASSES), F.lit(False)).cast("int")


def cut(text: Column, limit: int) -> Column:
    """The first ``limit`` characters, with ``...`` when something was left out (for display)."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def upper_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^A-Z]", ""))


def upper_share(text: Column, upper: Column | None = None, length: Column | None = None) -> Column:
    """Share of the letters A-Z; both counts may be given."""
    n = F.length(text) if length is None else length
    upper = upper_letters(text) if upper is None else upper
    return F.when(n > 0, upper / n).otherwise(F.lit(0.0))


def exclamations(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))


def repeated_word_share(text: Column) -> Column:
    w = words(F.lower(text))
    return F.when(F.size(w) > 0, 1 - F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(0.0))


def spelled(found: Column, among: list[str]) -> Column:
    """Number of distinct words, and a bit for each of ``among`` that is one of them."""
    bits = lambda w: sum((F.array_contains(w, x).cast("long") * F.lit(1 << i).cast("long") for i, x in enumerate(among)), F.lit(0).cast("long"))
    return let(F.array_distinct(found), lambda w: F.struct(F.size(w).alias("distinct"), bits(w).alias("bits")))


def praise_hits(text: Column) -> Column:
    return lexicon_hits(F.lower(text), PRAISE_PHRASES)


def relevancy_parts(df, text: str = "text", category: str = "category", name: str = "business_name"):
    """Category vocabulary hits, business-name mention, off-topic marks and the score made of them.

    Score = 0.4 + 0.15 per vocabulary hit + 0.2 for the name - 0.3 per off-topic mark, in [0, 1].
    """
    if measured(df, text) and name == "location":
        found = lambda terms: bit_hits(measure("topic_bits"), terms, TOPIC_TERMS)
        off_topic = bit_hits(measure("rule_bits"), OFF_TOPIC_TERMS, RULE_TERMS)
        named = measure("names_location").cast("int")
    else:
        df = df.withColumn("_lower", F.lower(F.coalesce(F.col(text), F.lit(""))))
        low = F.col("_lower")
        found = lambda terms: lexicon_hits(low, terms)
        off_topic = found(OFF_TOPIC_TERMS)
        named = F.coalesce(F.contains(low, F.lower(F.col(name))), F.lit(False)).cast("int")
    hits = None
    for cat, terms in CATEGORY_TERMS.items():
        cond = F.col(category) == cat
        value = found(terms)
        hits = F.when(cond, value) if hits is None else hits.when(cond, value)
    df = df.withColumns(
        {
            "category_hits": hits.otherwise(F.lit(0)),
            "name_mention": named,
            "off_topic_hits": off_topic,
        }
    ).drop("_lower")
    raw = (
        0.4
        + 0.15 * F.col("category_hits")
        + 0.2 * F.col("name_mention")
        - 0.3 * F.col("off_topic_hits")
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return df.withColumn("relevancy_score", score).withColumn(
        "relevancy_flag", F.col("relevancy_score") >= 0.4
    )

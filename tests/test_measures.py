"""Measures of a review's text, made from its document and tail, against the same rules on the text itself."""

from datetime import datetime

from pyspark.sql import functions as F

from probity.functions import content as C
from probity.functions import text as X
from probity.operators import signals as G
from probity.plans import reviews as P

TEXTS = [
    "Great food, BUY NOW and good love", None, "", "   ", "bad poor\tbad poor", "not", "ends in Web", "deal, deal, lowest", "ΑΣ", "Unknown! great", "İstanbul SALE",
    "call now http", "x see a", "never again worst awful terrible", "here buy Click",
]


def rows(spark):
    docs = [(i, t, "en", [None, "", "web", "Web", "en", "poor", "ΑΣ"][i % 7]) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    events = [(i, datetime(2024, 1, 1), 1, "view", 2.5, '{"k": 1}') for i in [*range(40 * len(TEXTS)), -3, None]]
    events = spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    return P.as_reviews(events, docs, labels)


def test_measures_equal_the_rules(spark):
    measured = rows(spark)
    plain = measured.drop(*X.MEASURES)
    assert X.measured(measured) and not X.measured(plain)
    t = F.coalesce("text", F.lit(""))
    checks = [
        lambda df: X.with_rule_class(df).select("review_id", *P.SIGNALS, "text_prediction"),
        lambda df: X.relevancy_parts(df, name="location").select("review_id", "category_hits", "name_mention", "off_topic_hits", "relevancy_score"),
        lambda df: C.with_content(df).select("review_id", "text_length", "word_count", "avg_word_length"),
        lambda df: df.select("review_id", (X.measure("digest") if X.measured(df) else F.md5("text")).alias("digest")),
        lambda df: df.select("review_id", *[c.alias(k) for k, c in (G.measured_surface() if X.measured(df) else G.surface_rules(t)).items()]),
    ]
    for check in checks:
        a, b = (sorted(map(str, check(df).collect())) for df in (measured, plain))
        assert a == b


def test_no_text_goes_through_the_join(spark):
    for df in (rows(spark).select("review_id", "logit0", "relevancy"), P.text_part(rows(spark)), rows(spark).select(*X.MEASURES)):
        plan = df._jdf.queryExecution().optimizedPlan()
        join = next(iter_joins(plan))
        assert "text" not in [a.name() for a in java_list(join.output())]


def java_list(seq):
    return [seq.apply(i) for i in range(seq.size())]


def iter_joins(plan):
    if plan.nodeName() == "Join":
        yield plan
    for child in java_list(plan.children()):
        yield from iter_joins(child)

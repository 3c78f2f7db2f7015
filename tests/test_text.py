import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probity.constants import BAD_CLASSES, TEXT_CLASSES, TIERS, ZERO_SHOT_CATEGORIES
from probity.functions import content as C
from probity.functions import risk as R
from probity.functions import text as X
from probity.functions import vectors as V
from probity.operators import scoring as S

# text, stars, class, tier of the tester path
SAMPLES = [
    ("Buy now! Best price ever! Click here for discount!", 5.0, "spam", "high_risk"),
    ("meh", 3.0, "irrelevant", "medium_risk"),
    (None, None, "irrelevant", "medium_risk"),
    ("worst terrible awful visit", 1.0, "fake_rant", "high_risk"),
    ("The soup was not good and the staff were poor at their work", 3.0, "genuine_negative", "low_risk"),
    ("A great place with wonderful people", 3.0, "genuine_positive", "low_risk"),
    ("A great place with wonderful people", 5.0, "genuine_positive", "low_risk"),
    ("lowest price and a special offer every day", 3.0, "advertisement", "medium_risk"),
    ("see http://x.example for more", 3.0, "spam", "medium_risk"),
    ('He said "vulgar" things,\nthen left', 3.0, "inappropriate", "medium_risk"),
    ("use promocode today, it is a promo", 3.0, "advertisement", "medium_risk"),
]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _, _) in enumerate(SAMPLES)], "review_id long, text string, stars double")
    return {r.review_id: r for r in S.tester_scores(df).collect()}


@pytest.mark.parametrize("i", range(len(SAMPLES)))
def test_samples(scored, i):
    assert (scored[i].text_prediction, scored[i].fusion_prediction) == SAMPLES[i][2:]


def test_hand_values(scored):
    by_class = {"spam": 0.857143, "advertisement": 0.851852, "fake_rant": 0.846154, "inappropriate": 0.846154,
                "irrelevant": 0.84, "genuine_positive": 0.416667, "genuine_negative": 0.416667}
    for r in scored.values():
        assert r.p_bad == pytest.approx(by_class[r.text_prediction], abs=1e-6)
    assert scored[0].fusion_risk_score == pytest.approx(0.81)
    assert scored[5].fusion_risk_score == pytest.approx(0.381667, abs=1e-6)
    assert scored[6].fusion_risk_score == pytest.approx(0.501667, abs=1e-6)


def test_rule_vector_and_closed_form_agree(spark):
    df = spark.createDataFrame([(t,) for t, *_ in SAMPLES], "text string")
    out = S.rule_scores(df).withColumn("m", V.bad_mass(F.col("class_probabilities"))).withColumn("g", V.genuine_mass(F.col("class_probabilities")))
    for r in out.collect():
        assert r.m == pytest.approx(r.p_bad) and r.m + r.g == pytest.approx(1)
        assert sum(r.probs) == pytest.approx(1) and len(r.probs) == 7
        assert r.text_prediction == TEXT_CLASSES[r.probs.index(max(r.probs))]


def test_aggressive_preset_reaches_genuine(spark):
    r = spark.range(1).select(R.tier(F.lit(0.381667), (0.45, 0.65, 0.85)).alias("t")).first()
    assert r.t == "genuine"


def test_content_edges(spark):
    rows = [
        (None, None, "en", None), ("", "http://x/1.jpg", "en", "fr"), ("a bb  ccc\n", '["u1","u2"]', "en", "en"),
        ("a b", "[broken", None, None),
    ]
    df = spark.createDataFrame(rows, "text string, review_image_urls string, language string, original_language string")
    got = [tuple(r) for r in C.with_content(df).select("has_image", "image_count", "text_length", "word_count", "avg_word_length", "language_match").collect()]
    assert got == [(0, 0, None, None, None, 0), (1, 0, 0, 0, 0.0, 0), (1, 2, 10, 3, 2.0, 1), (1, 0, 3, 2, 1.0, 0)]


def test_zero_shot_names(spark):
    names = list(ZERO_SHOT_CATEGORIES)
    df = spark.createDataFrame([(1, ["unheard of", names[0]], [0.7, 0.3])], "review_id long, labels array<string>, scores array<double>")
    r = S.zero_shot_scores(df, ZERO_SHOT_CATEGORIES).first()
    assert r.text_prediction == "spam" and r.text_confidence == 0.7
    assert r.class_probabilities == {**{c: 0.0 for c in TEXT_CLASSES}, "spam": 0.7, "genuine_positive": 0.3}
    assert r.p_bad == pytest.approx(0.7)


def test_scorer_choice():
    assert S.choose_scorer()[0] == "rules"
    assert S.choose_scorer(zero_shot=len)[0] == "zero_shot"
    assert S.choose_scorer(len, len)[0] == "fine_tuned"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.floats(-20, 20), min_size=7, max_size=7), min_size=1, max_size=20))
def test_softmax_sums_to_one(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "review_id long, z array<double>")
    for r in S.logits_scores(df, F.col("z")).collect():
        assert sum(r.probs) == pytest.approx(1)
        assert r.text_prediction == TEXT_CLASSES[r.z.index(max(r.z))] or r.text_confidence == pytest.approx(max(r.probs))
        assert r.p_bad == pytest.approx(sum(r.probs[2:]))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=2, max_size=50))
def test_tiers_grow_with_risk(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", R.tier(F.col("v")).alias("t")).orderBy("v")
    places = [TIERS.index(r.t) for r in df.collect()]
    assert places == sorted(places)


def test_single_equals_batch(spark):
    rows = [(i, t, s) for i, (t, s, _, _) in enumerate(SAMPLES)]
    schema = "review_id long, text string, stars double"
    batch = {r.review_id: r for r in S.tester_scores(spark.createDataFrame(rows, schema)).collect()}
    for row in rows[:3]:
        assert S.tester_scores(spark.createDataFrame([row], schema)).first() == batch[row[0]]


def test_lookup_names_key_once(spark):
    df = spark.createDataFrame([("spam",), ("unknown",), (None,)], "c string")
    assert [r[0] for r in df.select(R.serving_decision(F.col("c"))).collect()] == ["high-confidence-spam", "suspicious", "suspicious"]
    assert all(c in TEXT_CLASSES for c in BAD_CLASSES)
    assert [r[0] for r in df.select(R.route_description(F.col("c"))).collect()] == ["Unknown routing decision"] * 3
    assert X.cut is not None


def test_terms_name_the_text_once(spark):
    """Written out as a sum, the text was lower-cased for every term."""
    df = spark.createDataFrame([("Buy NOW, www.x http",), ("",), (None,)], "text string")
    got = df.select(X.term_bits(F.lower("text"), X.RULE_TERMS).alias("bits"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("lower(text") == 1
    want = X.bit_mask([t for t in X.RULE_TERMS if t in "buy now, www.x http"], X.RULE_TERMS)
    assert [r.bits for r in got.collect()] == [want, 0, None]


def test_long_methods_are_not_generated(spark):
    """The JVM interprets methods of more than 8,000 bytes."""
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"

"""Building blocks of the check SQL (DuckDB dialect). Written apart from the DataFrame code."""

from __future__ import annotations

from probity.constants import (
    AD_TERMS,
    CATEGORY_TERMS,
    EXTREME_TERMS,
    INAPPROPRIATE_TERMS,
    NEGATIVE_TERMS,
    OFF_TOPIC_TERMS,
    POSITIVE_TERMS,
    SPAM_TERMS,
    TEXT_CLASSES,
)

EVENTS = """event_reviews AS (
SELECT
  e.event_id AS review_id,
  e.user_id AS reviewer_id,
  CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) AS place_id,
  CAST(e.ts AS TIMESTAMP) AS published_at,
  CASE WHEN e.event_id % 41 = 0 THEN 'not a date' ELSE CAST(e.ts AS STRING) END AS published_raw,
  CASE WHEN e.event_id % 50 = 0 THEN NULL
       ELSE CAST(1 + CAST(floor(e.value) AS BIGINT) % 5 AS DOUBLE) END AS stars,
  CASE WHEN e.event_id % 37 = 0 THEN 'n/a'
       ELSE CAST(1 + CAST(floor(e.value) AS BIGINT) % 5 AS STRING) END AS stars_raw,
  CASE (e.event_id + e.event_id // dc.n) % 20
    WHEN 0 THEN d.text || ' buy now click here'
    WHEN 1 THEN d.text || ' best deal, lowest price'
    WHEN 2 THEN 'worst terrible awful visit'
    WHEN 3 THEN 'meh'
    WHEN 4 THEN d.text || ' see http://x.example'
    WHEN 5 THEN d.text || ' offensive'
    WHEN 6 THEN d.text || ' bad poor'
    WHEN 7 THEN d.text || ' great love'
    WHEN 8 THEN d.text || ' not good'
    WHEN 9 THEN '   '
    WHEN 10 THEN NULL
    ELSE d.text END AS text,
  d.lang AS language,
  CASE WHEN e.event_id % 5 = 0 THEN 'en' WHEN e.event_id % 7 = 0 THEN NULL ELSE d.lang END AS original_language,
  CASE e.event_id % 4
    WHEN 0 THEN '["http://x.example/1.jpg","http://x.example/2.jpg"]'
    WHEN 1 THEN '["http://x.example/1.jpg"]'
    WHEN 2 THEN 'http://x.example/3.jpg'
    ELSE NULL END AS review_image_urls,
  CASE CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) % 4
    WHEN 0 THEN 'Restaurant' WHEN 1 THEN 'Hotel' WHEN 2 THEN 'Cafe' ELSE 'Shopping Mall' END AS category,
  'user_' || CAST(e.user_id AS STRING) AS reviewer_name,
  e.event_id % 13 AS helpful_votes,
  e.event_id % 13 + e.event_id % 6 AS total_votes,
  e.event_type = 'purchase' AS verified_purchase,
  CASE WHEN e.event_id % 9 = 0 THEN 'Unknown' ELSE d.source END AS location,
  CASE WHEN l.doc_id IS NULL THEN NULL
       WHEN e.event_id % 13 = 0 THEN 'advertisement'
       WHEN e.event_id % 17 = 0 THEN 'irrelevant'
       WHEN e.event_id % 19 = 0 THEN 'fake_rant'
       WHEN l.toxic = 1 THEN 'inappropriate'
       WHEN l.quality = 0 THEN 'spam'
       WHEN floor(e.value) % 5 >= 2 THEN 'genuine_positive'
       ELSE 'genuine_negative' END AS label
FROM events e
CROSS JOIN (SELECT count(*) AS n FROM documents) dc
LEFT JOIN documents d ON d.doc_id = e.event_id % dc.n
LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


def hits(column: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, '{t}') AS INT)" for t in terms) + ")"


_CATEGORY_HITS = " ".join(f"WHEN '{c}' THEN {hits('low', terms)}" for c, terms in CATEGORY_TERMS.items())

# Logits, metadata probability and relevancy, each from the review's own text, stars and time.
REVIEWS = f"""reviews AS (
SELECT * EXCLUDE (low, n_words, h_pos, h_neg, h_spam, h_ad, h_ext, h_bad, h_cat),
  1.0::DOUBLE + 0.9::DOUBLE * h_pos - 0.3::DOUBLE * h_neg AS logit0,
  0.7::DOUBLE + 0.9::DOUBLE * h_neg - 0.3::DOUBLE * h_pos AS logit1,
  1.3::DOUBLE * h_spam + 1.6::DOUBLE * CAST(contains(low, 'http') AS INT) AS logit2,
  0.05::DOUBLE + 1.3::DOUBLE * h_ad AS logit3,
  2.0::DOUBLE - 3.0::DOUBLE * (n_words / (n_words + 20.0::DOUBLE)) AS logit4,
  0.1::DOUBLE + 1.1::DOUBLE * h_ext AS logit5,
  0.15::DOUBLE + 1.7::DOUBLE * h_bad AS logit6,
  coalesce(0.6::DOUBLE * (CASE WHEN stars <= 1 OR stars >= 5 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END)
    + 0.2::DOUBLE * CAST(isodow(published_at) >= 6 AS INT) + 0.2::DOUBLE * (hour(published_at) / 23.0::DOUBLE), 0.5::DOUBLE) AS enhanced_prob,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, h_cat)) AS relevancy, greatest(0.0::DOUBLE, least(1.0::DOUBLE, h_cat)) >= 0.4::DOUBLE AS is_relevant
FROM (SELECT *, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS n_words,
    {hits('low', POSITIVE_TERMS)} AS h_pos, {hits('low', NEGATIVE_TERMS)} AS h_neg, {hits('low', SPAM_TERMS)} AS h_spam, {hits('low', AD_TERMS)} AS h_ad,
    {hits('low', EXTREME_TERMS)} AS h_ext, {hits('low', INAPPROPRIATE_TERMS)} AS h_bad,
    0.4::DOUBLE + 0.15::DOUBLE * (CASE category {_CATEGORY_HITS} ELSE 0 END)
      + 0.2::DOUBLE * CAST(coalesce(contains(low, lower(location)), false) AS INT) - 0.3::DOUBLE * {hits('low', OFF_TOPIC_TERMS)} AS h_cat
  FROM (SELECT *, lower(coalesce(text, '')) AS low FROM event_reviews))
)"""


BAD = "('spam','advertisement','irrelevant','fake_rant','inappropriate')"
GENUINE = "('genuine_positive','genuine_negative')"

# Hit counts, text class, confidence, bad mass.
HITS = f"""hits AS (
SELECT *, {hits('low', SPAM_TERMS)} AS spam_hits, {hits('low', AD_TERMS)} AS ad_hits,
  {hits('low', EXTREME_TERMS)} AS extreme_hits, {hits('low', INAPPROPRIATE_TERMS)} AS inappropriate_hits,
  {hits('low', POSITIVE_TERMS)} AS positive_hits, {hits('low', NEGATIVE_TERMS)} AS negative_hits,
  length(filled) AS rule_length,
  len(list_filter(string_split_regex(filled, '\\s+'), lambda w: w <> '')) AS rule_words
FROM (SELECT *, coalesce(text, '') AS filled, lower(coalesce(text, '')) AS low FROM reviews)
)"""

RULED = f"""ruled AS (
SELECT *,
  CASE WHEN text_prediction IN {BAD} THEN (text_confidence + 0.4) / (text_confidence + 0.6)
       ELSE 0.5 / (text_confidence + 0.6) END AS p_bad
FROM (SELECT *,
  CASE text_prediction WHEN 'spam' THEN 0.8::DOUBLE WHEN 'advertisement' THEN 0.75::DOUBLE WHEN 'fake_rant' THEN 0.7::DOUBLE
    WHEN 'irrelevant' THEN 0.65::DOUBLE WHEN 'inappropriate' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS text_confidence
  FROM (SELECT *,
    CASE WHEN spam_hits >= 2 OR contains(low, 'http') THEN 'spam'
      WHEN ad_hits >= 2 THEN 'advertisement'
      WHEN extreme_hits >= 3 AND rule_words < 20 THEN 'fake_rant'
      WHEN rule_length < 10 THEN 'irrelevant'
      WHEN inappropriate_hits > 0 THEN 'inappropriate'
      WHEN negative_hits > positive_hits THEN 'genuine_negative'
      ELSE 'genuine_positive' END AS text_prediction
    FROM hits))
)"""

TESTED = f"""tested AS (
SELECT *,
  CASE WHEN risk < 0.35 THEN 'genuine' WHEN risk < 0.55 THEN 'low_risk' WHEN risk < 0.8 THEN 'medium_risk'
       ELSE 'high_risk' END AS tier,
  abs(risk - 0.5) * 2 AS tier_confidence
FROM (SELECT *,
    p_bad * 0.7 + metadata_anomaly_score * 0.3 AS risk
  FROM (SELECT *,
      CASE WHEN stars <= 1 OR stars >= 5 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS metadata_anomaly_score,
      coalesce(stars <= 1 OR stars >= 5, false) AS metadata_is_anomaly
    FROM ruled))
)"""

SERVED = """served AS (
SELECT *,
  text_confidence AS final_confidence, (p_bad + 0.3) / 2 AS fusion_score,
  CASE final_prediction WHEN 'genuine' THEN 'automatic-approval'
    WHEN 'high-confidence-spam' THEN 'automatic-rejection' ELSE 'requires-manual-verification' END AS routing_decision
FROM (SELECT *,
  CASE WHEN text_prediction IN ('genuine_positive','genuine_negative') THEN 'genuine'
       WHEN text_prediction IN ('spam','inappropriate') THEN 'high-confidence-spam'
       WHEN text_prediction = 'irrelevant' THEN 'low-quality' ELSE 'suspicious' END AS final_prediction
  FROM ruled)
)"""

_E = ", ".join(f"exp(logit{i} - zmax) AS e{i}" for i in range(7))
_S = " + ".join(f"e{i}" for i in range(7))
_P = ", ".join(f"e{i} / es AS p{i}" for i in range(7))
_ARG = " ".join(f"WHEN logit{i} = zmax THEN '{c}'" for i, c in enumerate(TEXT_CLASSES))

PROBS = f"""probs AS (
SELECT *, p2 + p3 + p4 + p5 + p6 AS p_bad, greatest(p0,p1,p2,p3,p4,p5,p6) AS confidence,
  CASE {_ARG} END AS prediction,
  p0 + p1 AS d_genuine, p5 AS d_suspicious, p4 AS d_low, p2 + p3 + p6 AS d_spam
FROM (SELECT *, {_P} FROM (SELECT *, {_S} AS es FROM (SELECT *, {_E}
  FROM (SELECT *, greatest(logit0,logit1,logit2,logit3,logit4,logit5,logit6) AS zmax FROM reviews))))
)"""

# Labelled rows with both predictors and the score.
JUDGED = f"""judged AS (
SELECT review_id, category, language, label AS truth, prediction, confidence, p_bad AS score,
  CAST(label IN {BAD} AS INT) AS y, CAST(prediction IN {BAD} AS INT) AS yhat,
  p0,p1,p2,p3,p4,p5,p6, d_genuine, d_suspicious, d_low, d_spam, p_bad, enhanced_prob, relevancy, is_relevant,
  stars, published_at
FROM probs WHERE text IS NOT NULL AND label IS NOT NULL
)"""

RULE_JUDGED = f"""rule_judged AS (
SELECT review_id, label AS truth, text_prediction AS prediction, text_confidence AS confidence,
  CAST(label IN {BAD} AS INT) AS y, CAST(text_prediction IN {BAD} AS INT) AS yhat,
  CAST(metadata_is_anomaly AS INT) AS stage2, metadata_anomaly_score, p_bad
FROM tested WHERE text IS NOT NULL AND label IS NOT NULL
)"""

DEPENDS = {
    "event_reviews": [], "reviews": ["event_reviews"], "hits": ["reviews"], "ruled": ["hits"], "tested": ["ruled"], "served": ["ruled"],
    "probs": ["reviews"], "judged": ["probs"], "rule_judged": ["tested"],
}
TEXTS = {
    "event_reviews": EVENTS, "reviews": REVIEWS, "hits": HITS, "ruled": RULED, "tested": TESTED, "served": SERVED,
    "probs": PROBS, "judged": JUDGED, "rule_judged": RULE_JUDGED,
}


def _needs(names) -> list[str]:
    out: list[str] = []
    for n in names:
        for d in _needs(DEPENDS.get(n, [])):
            if d not in out:
                out.append(d)
        if n not in out:
            out.append(n)
    return out


def sql(base: str, body: str, *more: str) -> str:
    """``body`` over the named base views (space separated), with more CTEs of its own."""
    parts = [TEXTS[n] for n in _needs(base.split())]
    return "WITH " + ",\n".join([*parts, *more]) + "\n" + body


def long_form(source: str, columns, name: str = "metric", value: str = "value") -> str:
    """One row per column of a one-row view."""
    rows = [f"SELECT '{c}' AS {name}, CAST({c} AS DOUBLE) AS {value} FROM {source}" for c in columns]
    return " UNION ALL ".join(rows)

"""Text stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from probity.constants import TEXT_CLASSES, ZERO_SHOT_CATEGORIES
from probity.functions import text as X
from probity.functions import vectors as V
from probity.operators import linear as L
from probity.operators import scoring as S
from probity.operators import textmodel as T
from probity.plans import reviews as P
from probity.plans.catalog.sql import BAD, GENUINE, sql
from probity.session import cut_lineage

ZERO_SHOT_NAMES = [*ZERO_SHOT_CATEGORIES, "something else"]


def _wide(prefix="prob_"):
    return ", ".join(f"round(p{i}, 6) AS {prefix}{c}" for i, c in enumerate(TEXT_CLASSES))


def register(catalog):
    add = catalog.add

    @add(
        "lexicon_hits",
        "T1",
        sql(
            "hits",
            "SELECT review_id, spam_hits, ad_hits, extreme_hits, inappropriate_hits, positive_hits, negative_hits FROM hits",
        ),
    )
    def _(spark, folder):
        return X.rule_signals(P.reviews(spark, folder)).select(
            "review_id", "spam_hits", "ad_hits", "extreme_hits", "inappropriate_hits", "positive_hits", "negative_hits"
        )

    @add(
        "rule_class",
        "T2",
        sql("ruled", "SELECT review_id, text_prediction, text_confidence FROM ruled"),
    )
    def _(spark, folder):
        return S.rule_scores(P.reviews(spark, folder)).select("review_id", "text_prediction", "text_confidence")

    probs = ", ".join(
        f"round(CASE WHEN text_prediction = '{c}' THEN text_confidence ELSE 0.1 END / (text_confidence + 0.6), 6) AS prob_{c}"
        for c in TEXT_CLASSES
    )

    @add("rule_probabilities", "T3", sql("ruled", f"SELECT review_id, {probs} FROM ruled"))
    def _(spark, folder):
        df = S.rule_scores(P.reviews(spark, folder))
        return df.select(
            "review_id",
            *[F.round(V.class_prob(F.col("class_probabilities"), c), 6).alias(f"prob_{c}") for c in TEXT_CLASSES],
        )

    @add(
        "bad_and_genuine_mass",
        "T4 T5",
        sql("ruled", "SELECT review_id, round(p_bad, 6) AS p_bad, round(1 - p_bad, 6) AS high_quality_score FROM ruled"),
    )
    def _(spark, folder):
        df = S.rule_scores(P.reviews(spark, folder))
        m = F.col("class_probabilities")
        return df.select(
            "review_id",
            F.round(V.bad_mass(m), 6).alias("p_bad"),
            F.round(V.genuine_mass(m), 6).alias("high_quality_score"),
        )

    @add("softmax_probabilities", "T6 T13", sql("probs", f"SELECT review_id, {_wide()} FROM probs"))
    def _(spark, folder):
        df = P.with_logits(spark, folder)
        wide = V.wide_columns(V.as_map(F.col("probs")))
        out = df.select("review_id", *wide)
        return out.select("review_id", *[F.round(f"prob_{c}", 6).alias(f"prob_{c}") for c in TEXT_CLASSES])

    @add(
        "argmax_class",
        "T7",
        sql("probs", "SELECT review_id, prediction, round(confidence, 6) AS confidence, round(p_bad, 6) AS p_bad FROM probs"),
    )
    def _(spark, folder):
        return P.with_logits(spark, folder).select(
            "review_id",
            F.col("text_prediction").alias("prediction"),
            F.round("text_confidence", 6).alias("confidence"),
            F.round("p_bad", 6).alias("p_bad"),
        )

    @add("model_scoring", "T8")
    def _(spark, folder):
        rows = cut_lineage(P.reviews(spark, folder).select("review_id", "text", "label"))
        df = L.sparse_scores(rows, T.train_text_model(rows, iterations=10))
        return df.groupBy("text_prediction", "model_type").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.avg("p_bad"), 4).alias("avg_p_bad")
        )

    # Ranked answers of a zero-shot model: the seven category names (and an unknown one) by logit.
    zs_wide = ", ".join(
        (
            # 'something else' takes the place of the last category on every third review.
            "round(CASE WHEN odd AND p6 < p2 THEN p6 ELSE p2 END, 6) AS prob_spam"
            if c == "spam"
            else "round(CASE WHEN odd THEN 0 ELSE p6 END, 6) AS prob_inappropriate"
            if c == "inappropriate"
            else f"round(p{i}, 6) AS prob_{c}"
        )
        for i, c in enumerate(TEXT_CLASSES)
    )

    @add(
        "zero_shot_mapping",
        "T9",
        sql(
            "probs",
            f"""SELECT review_id, CASE WHEN odd AND prediction = 'inappropriate' THEN 'spam' ELSE prediction END AS prediction,
            round(confidence, 6) AS confidence, {zs_wide} FROM (SELECT *, review_id % 3 = 0 AS odd FROM probs)""",
        ),
    )
    def _(spark, folder):
        df = P.with_logits(spark, folder)
        odd = F.col("review_id") % 3 == 0
        names = F.array(
            *[F.lit(n) for n in ZERO_SHOT_NAMES[:6]],
            F.when(odd, ZERO_SHOT_NAMES[7]).otherwise(ZERO_SHOT_NAMES[6]),
        )
        ranked = F.array_sort(
            F.transform(
                F.sequence(F.lit(0), F.lit(6)),
                lambda i: F.struct(
                    (-F.get(F.col("probs"), i)).alias("neg"), i.alias("i"), F.get(names, i).alias("label")
                ),
            )
        )
        df = df.withColumn("_r", ranked).withColumns(
            {
                "labels": F.transform("_r", lambda e: e["label"]),
                "scores": F.transform("_r", lambda e: -e["neg"]),
            }
        )
        out = S.zero_shot_scores(df, ZERO_SHOT_CATEGORIES)
        wide = V.wide_columns(F.col("class_probabilities"))
        out = out.select(
            "review_id",
            F.col("text_prediction").alias("prediction"),
            F.round("text_confidence", 6).alias("confidence"),
            *wide,
        )
        return out.select(
            "review_id", "prediction", "confidence", *[F.round(f"prob_{c}", 6).alias(f"prob_{c}") for c in TEXT_CLASSES]
        )

    @add(
        "scorer_fallback",
        "T11",
        sql(
            "ruled",
            """SELECT review_id, text IS NULL AS is_error, CASE WHEN text IS NULL THEN 'error' ELSE text_prediction END AS text_prediction,
            CASE WHEN text IS NULL THEN 0.0 ELSE text_confidence END::DOUBLE AS text_confidence,
            round(CASE WHEN text IS NULL THEN 0.5 ELSE p_bad END, 6) AS p_bad,
            CASE WHEN text IS NULL THEN 'unknown' WHEN text_prediction IN ('genuine_positive','genuine_negative')
              THEN 'genuine' ELSE 'non_genuine' END AS text_binary FROM ruled""",
        ),
    )
    def _(spark, folder):
        df = S.rule_scores(P.reviews(spark, folder))
        lost = X.measure("length").isNull()
        df = df.withColumns(
            {c: F.when(~lost, F.col(c)) for c in ("text_prediction", "text_confidence", "p_bad")}
        )
        df = S.with_fallback(df, "tester")
        return df.select(
            "review_id",
            "is_error",
            "text_prediction",
            "text_confidence",
            F.round("p_bad", 6).alias("p_bad"),
            F.when(F.col("is_error"), "unknown")
            .otherwise(X.binary_class(F.col("text_prediction")))
            .alias("text_binary"),
        )

    ids = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(TEXT_CLASSES))

    @add(
        "label_ids",
        "T12",
        sql("reviews", f"SELECT review_id, label, CASE label {ids} END AS label_id, label AS label_back FROM reviews"),
    )
    def _(spark, folder):
        code = V.lookup({c: F.lit(i) for i, c in enumerate(TEXT_CLASSES)}, F.col("label"), F.lit(None).cast("int"))
        df = P.reviews(spark, folder).select("review_id", "label", code.alias("label_id"))
        back = F.try_element_at(V.label_array(), F.col("label_id") + 1)
        return df.withColumn("label_back", back)

    @add(
        "binary_class",
        "T14 T15",
        sql(
            "ruled",
            f"""SELECT review_id, CASE WHEN text_prediction IN {GENUINE} THEN 'genuine' ELSE 'non_genuine' END AS text_binary,
            round(CASE WHEN text_prediction IN {GENUINE} THEN text_confidence ELSE 1 - text_confidence END, 6) AS binary_confidence,
            round(CASE WHEN text_prediction IN {BAD} THEN text_confidence ELSE 1 - text_confidence END, 6) AS p_non_genuine
            FROM ruled""",
        ),
    )
    def _(spark, folder):
        df = S.rule_scores(P.reviews(spark, folder))
        a = (F.col("text_prediction"), F.col("text_confidence"))
        return df.select(
            "review_id",
            X.binary_class(a[0]).alias("text_binary"),
            F.round(X.binary_confidence(*a), 6).alias("binary_confidence"),
            F.round(X.non_genuine_probability(*a), 6).alias("p_non_genuine"),
        )

    ranked = " UNION ALL ".join(
        f"SELECT review_id, '{c}' AS label, p{i} AS p FROM probs" for i, c in enumerate(TEXT_CLASSES)
    )

    @add(
        "top_classes",
        "T16",
        sql(
            "probs",
            """SELECT review_id, CAST(rn AS INT) AS place, label, round(p, 6) AS p FROM
            (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY p DESC, label) AS rn FROM r) WHERE rn <= 3""",
            f"r AS ({ranked})",
        ),
    )
    def _(spark, folder):
        df = P.with_logits(spark, folder)
        top = V.top_classes(V.as_map(F.col("probs")), 3)
        out = df.select("review_id", F.posexplode(top).alias("i", "t"))
        return out.select(
            "review_id", (F.col("i") + 1).alias("place"), F.col("t.label").alias("label"), F.round("t.p", 6).alias("p")
        )

    @add(
        "confidence_weighted_scores",
        "T17",
        sql(
            "ruled",
            """SELECT review_id, round((1 - p_bad) * text_confidence, 6) AS text_weighted_quality,
            round(p_bad * text_confidence, 6) AS text_weighted_risk FROM ruled""",
        ),
    )
    def _(spark, folder):
        df = S.text_features(S.rule_scores(P.reviews(spark, folder)))
        return df.select(
            "review_id",
            F.round("text_weighted_quality", 6).alias("text_weighted_quality"),
            F.round("text_weighted_risk", 6).alias("text_weighted_risk"),
        )

    @add(
        "class_weighted_score",
        "T18",
        sql(
            "probs",
            "SELECT review_id, round(p0 + p1 - 2 * p2 - 1.5 * p3 - p4 - 2 * p5 - 2 * p6, 6) AS weighted_score FROM probs",
        ),
    )
    def _(spark, folder):
        df = P.with_logits(spark, folder)
        return df.select("review_id", F.round(V.class_weighted_score(F.col("probs")), 6).alias("weighted_score"))

    @add(
        "text_shape",
        "T21",
        sql(
            "reviews",
            """SELECT review_id, CAST(regexp_matches(t, '\\p{Lu}') AS INT) AS has_upper, CAST(regexp_matches(t, '[0-9]') AS INT) AS has_digit,
            CAST(length(t) AS INT) AS text_length, CAST(len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) AS INT) AS word_count
            FROM (SELECT review_id, coalesce(text, '') AS t FROM reviews)""",
        ),
    )
    def _(spark, folder):
        df = P.reviews(spark, folder).select("review_id", F.coalesce("text", F.lit("")).alias("t"))
        t = F.col("t")
        return df.select(
            "review_id",
            X.has_upper(t).alias("has_upper"),
            X.has_digit(t).alias("has_digit"),
            F.length(t).alias("text_length"),
            X.word_count(t).alias("word_count"),
        )

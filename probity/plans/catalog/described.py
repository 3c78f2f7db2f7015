"""Operators known from descriptions only; their definitions are fixed in the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from probity import constants as K
from probity.constants import CATEGORY_TERMS, DECISIONS, OFF_TOPIC_TERMS, PRAISE_PHRASES
from probity.functions import risk as R
from probity.functions import text as X
from probity.operators import calibration as C
from probity.operators import collusion as N
from probity.operators import monitoring as M
from probity.operators import routing as B
from probity.operators import signals as G
from probity.operators import similarity as Y
from probity.operators import thresholds as H
from probity.operators.anomaly import z_scores
from probity.operators.profiles import enrich
from probity.plans import reviews as P
from probity.plans.catalog.fusion import cascade, decided, tiers
from probity.plans.catalog.sql import hits, sql
from probity.session import cut_lineage

ROUTED_SRC = "(SELECT review_id, p_bad AS p_final, p_bad AS p_text, enhanced_prob AS p_meta, relevancy AS p_rel, relevancy * 0.5 AS burst, y FROM judged)"


def r6(df, names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def routing_input(spark, folder):
    return P.judged(spark, folder).select(
        "review_id", F.col("p_bad").alias("p_final"), F.col("p_bad").alias("p_text"), F.col("enhanced_prob").alias("p_meta"),
        F.col("relevancy").alias("p_rel"), (F.col("relevancy") * 0.5).alias("burst"), "y",
    )


def routed_sql(gate: str) -> str:
    return f"""routed AS (SELECT review_id, y, band, gate, priority, CASE WHEN (gate = 1 OR band = 'grey') AND place <= k THEN 'route'
      WHEN band = 'grey' THEN 'keep_unrouted' ELSE band END AS action FROM
    (SELECT *, row_number() OVER (PARTITION BY gate = 1 OR band = 'grey' ORDER BY gate * 2 + priority DESC, review_id) AS place, floor(count(*) OVER () * 0.05) AS k FROM
    (SELECT *, CASE WHEN p_final <= 0.3 THEN 'auto_keep' WHEN p_final >= 0.9 THEN 'auto_remove' ELSE 'grey' END AS band, CAST({gate} AS INT) AS gate,
      greatest(p_final, p_meta, burst) AS priority FROM {ROUTED_SRC})))"""


BURST = """days AS (SELECT place_id, CAST(published_at AS DATE) AS day, count(*) AS n FROM reviews GROUP BY 1, 2),
bursts AS (SELECT place_id, day, sum(n) OVER (PARTITION BY place_id ORDER BY day RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY FOLLOWING)
  / avg(n) OVER (PARTITION BY place_id) AS burst FROM days)"""
COORD = """seen AS (SELECT DISTINCT reviewer_id, place_id, stars, CAST(published_at AS DATE) AS day FROM reviews WHERE stars IS NOT NULL),
coord AS (SELECT reviewer_id, avg(CAST(c > 1 AS INT)) AS coordination, count(*) AS cells FROM
  (SELECT *, count(*) OVER (PARTITION BY place_id, stars, day) AS c FROM seen) GROUP BY reviewer_id)"""


def register(catalog):
    add = catalog.add

    four = """CASE WHEN is_relevant THEN 0.4 * p_bad + 0.3 * enhanced_prob + 0.3 * (1 - relevancy) ELSE 0.95 END"""
    four_tier = "CASE WHEN s < 0.4 THEN 'genuine' WHEN s < 0.6 THEN 'suspicious' WHEN s < 0.8 THEN 'low-quality' ELSE 'high-confidence-spam' END"

    @add(
        "four_stage_score",
        "D1 D2",
        sql(
            "probs",
            f"""SELECT review_id, round(s, 6) AS score, {four_tier} AS decision, CASE WHEN s < 0.4 THEN 'automatic-approval' WHEN s < 0.8 THEN 'requires-manual-verification'
            ELSE 'automatic-rejection' END AS routing_decision FROM (SELECT review_id, {four} AS s FROM probs)""",
        ),
    )
    def _(spark, folder):
        df = P.with_logits(spark, folder)
        s = R.four_stage_score(F.col("p_bad"), F.col("enhanced_prob"), F.col("relevancy"), F.col("is_relevant"))
        df = df.select("review_id", s.alias("s")).withColumn("decision", R.four_stage_tier(F.col("s")))
        return df.select("review_id", F.round("s", 6).alias("score"), "decision", R.route(F.col("decision")).alias("routing_decision"))

    @add(
        "shifted_calibration",
        "D3",
        sql(
            "probs",
            """SELECT review_id, round(greatest(0, least(1, p_bad * 0.7 - 0.3)) * CASE WHEN bn < 100 THEN 0.6 ELSE 1 END * CASE WHEN un = 1 THEN 0.7 ELSE 1 END, 6) AS calibrated
            FROM (SELECT *, count(*) OVER (PARTITION BY place_id) AS bn, count(*) OVER (PARTITION BY reviewer_id) AS un FROM probs)""",
        ),
    )
    def _(spark, folder):
        df = P.with_logits(spark, folder).select("review_id", "reviewer_id", "place_id", "p_bad")
        users = df.groupBy("reviewer_id").agg(F.count(F.lit(1)).alias("un"))
        places = df.groupBy("place_id").agg(F.count(F.lit(1)).alias("bn"))
        df = enrich(enrich(df, users, "reviewer_id"), places, "place_id")
        c = C.shifted(F.col("p_bad"), F.col("bn") < 100, F.col("un") == 1)
        return df.select("review_id", F.round(c, 6).alias("calibrated"))

    e = ", ".join(f"exp((logit{i} - zmax) / 2) AS e{i}" for i in range(7))
    total = " + ".join(f"e{i}" for i in range(7))

    @add(
        "temperature_scaling",
        "D4",
        sql(
            "reviews",
            f"""SELECT review_id, round((e2 + e3 + e4 + e5 + e6) / ({total}), 6) AS p_text FROM (SELECT review_id, {e} FROM
            (SELECT *, greatest(logit0,logit1,logit2,logit3,logit4,logit5,logit6) AS zmax FROM reviews))""",
        ),
    )
    def _(spark, folder):
        from probity.operators.scoring import logits_scores

        df = logits_scores(P.reviews(spark, folder), F.array(*[F.col(z) for z in P.LOGITS]), temperature=2.0)
        return df.select("review_id", F.round("p_bad", 6).alias("p_text"))

    @add("platt_scaling", "D5")
    def _(spark, folder):
        df = P.judged(spark, folder).select("review_id", "score", "y")
        return C.platt(df, "score", "y").select("review_id", "score", F.round("p_platt", 6).alias("p_platt"))

    @add(
        "quantile_mapping",
        "D6",
        sql("judged", "SELECT review_id, score, round(percent_rank() OVER (ORDER BY score), 6) AS percentile FROM judged"),
    )
    def _(spark, folder):
        df = P.judged(spark, folder).select("review_id", "score")
        return C.quantile_map(df, "score").select("review_id", "score", F.round("percentile", 6).alias("percentile"))

    @add(
        "isotonic_calibration",
        "D7",
        sql(
            "judged",
            """SELECT review_id, score, round(p, 6) AS p_isotonic FROM judged JOIN
            (SELECT i, max(least_mean) AS p FROM (SELECT j, k AS i, min(mean) OVER (PARTITION BY j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS least_mean FROM means) GROUP BY i)
            ON i = (SELECT r.n FROM ranks r WHERE r.score = judged.score)""",
            """steps AS (SELECT score, row_number() OVER (ORDER BY score) AS n, count(*) AS w, sum(y)::DOUBLE AS s FROM judged GROUP BY score),
            ranks AS (SELECT score, n FROM steps),
            sums AS (SELECT n, sum(w) OVER (ORDER BY n) AS cw, sum(s) OVER (ORDER BY n) AS cs, w, s FROM steps),
            means AS (SELECT a.n AS j, b.n AS k, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS mean FROM sums a JOIN sums b ON b.n >= a.n)""",
        ),
    )
    def _(spark, folder):
        df = P.judged(spark, folder).select("review_id", "score", "y")
        return C.isotonic(df, "score", "y").select("review_id", "score", F.round("p_isotonic", 6).alias("p_isotonic"))

    ent = " + ".join(f"CASE WHEN p{i} > 0 THEN -p{i} * ln(p{i}) ELSE 0 END" for i in range(7))

    @add(
        "fusion_vector",
        "D8",
        sql(
            "probs",
            f"""SELECT review_id, round(p_bad, 6) AS p_text, round(relevancy, 6) AS p_rel, round(enhanced_prob, 6) AS p_meta, round(p_bad * relevancy, 6) AS text_x_relevancy,
            round(p_bad * enhanced_prob, 6) AS text_x_metadata, round({ent}, 6) AS entropy, round(burst, 6) AS burst, round(coordination, 6) AS coordination
            FROM probs p LEFT JOIN bursts b ON b.place_id = p.place_id AND b.day = CAST(p.published_at AS DATE) LEFT JOIN coord c ON c.reviewer_id = p.reviewer_id""",
            BURST,
            COORD,
        ),
    )
    def _(spark, folder):
        df = P.with_logits(spark, folder).drop("text")
        out = G.fusion_vector(df).withColumnsRenamed({"p_bad": "p_text", "relevancy": "p_rel", "enhanced_prob": "p_meta"})
        names = ["p_text", "p_rel", "p_meta", "text_x_relevancy", "text_x_metadata", "entropy", "burst", "coordination"]
        return out.select("review_id", *[F.round(n, 6).alias(n) for n in names])

    @add("burst_score", "D9", sql("reviews", "SELECT place_id, CAST(day AS VARCHAR) AS day, round(burst, 6) AS burst FROM bursts", BURST))
    def _(spark, folder):
        out = G.burst_scores(P.reviews(spark, folder))
        return out.select("place_id", F.col("day").cast("string").alias("day"), F.round("burst", 6).alias("burst"))

    @add(
        "coordination_score",
        "D10",
        sql("reviews", "SELECT reviewer_id, round(coordination, 6) AS coordination, cells FROM coord", COORD),
    )
    def _(spark, folder):
        return r6(G.coordination_scores(P.reviews(spark, folder)), ["coordination"])

    @add(
        "collusion_score",
        "D10",
        sql(
            "reviews",
            """SELECT reviewer_id, coalesce(partners, 0) AS partners, businesses, round(coalesce(partners, 0) / businesses::DOUBLE, 6) AS collusion FROM
            (SELECT reviewer_id, count(DISTINCT place_id) AS businesses FROM own GROUP BY reviewer_id) LEFT JOIN
            (SELECT reviewer_id, count(*) AS partners FROM (SELECT a.reviewer_id, b.reviewer_id AS other FROM own a JOIN own b USING (place_id, stars)
              WHERE a.reviewer_id <> b.reviewer_id GROUP BY 1, 2 HAVING count(DISTINCT a.place_id) >= 2) GROUP BY reviewer_id) USING (reviewer_id)""",
            "own AS (SELECT DISTINCT reviewer_id, place_id, stars FROM reviews WHERE reviewer_id IS NOT NULL AND place_id IS NOT NULL AND stars IS NOT NULL)",
        ),
    )
    def _(spark, folder):
        return r6(N.partner_counts(P.reviews(spark, folder)), ["collusion"])

    @add("budgeted_routing", "D11", sql("judged", "SELECT review_id, band, priority, action FROM routed", routed_sql("false")))
    def _(spark, folder):
        return B.budgeted(routing_input(spark, folder), budget=0.05).select("review_id", "band", "priority", "action")

    gates = "p_meta >= 0.98 OR abs(p_text - p_rel) >= 0.9"

    @add("gated_routing", "D12", sql("judged", "SELECT review_id, gate, action FROM routed", routed_sql(gates)))
    def _(spark, folder):
        out = B.budgeted(routing_input(spark, folder), budget=0.05, meta_gate=0.98, disagreement=0.9)
        return out.select("review_id", "gate", "action")

    grid = " UNION ALL ".join(
        f"""SELECT {lo}::DOUBLE AS low, {hi}::DOUBLE AS high, count(*) FILTER (WHERE p_bad >= {hi} AND y = 0) AS fp, count(*) FILTER (WHERE p_bad >= {hi} AND y = 1) AS tp,
        count(*) FILTER (WHERE p_bad <= {lo} AND y = 1) AS fn, count(*) FILTER (WHERE p_bad > {lo} AND p_bad < {hi}) AS routes, count(*) AS n FROM judged"""
        for lo, hi in B.GRID
    )

    @add(
        "cost_grid",
        "D13",
        sql(
            "judged",
            """SELECT low, high, fp, tp, fn, routes, fp * 5.0::DOUBLE + fn * 3.0::DOUBLE + routes AS cost, round(routes / n::DOUBLE, 6) AS route_rate,
            round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision,
            routes / n::DOUBLE <= 0.35 AND coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) >= 0.4 AS allowed FROM grid""",
            f"grid AS ({grid})",
        ),
    )
    def _(spark, folder):
        df = routing_input(spark, folder)
        return r6(B.cost_grid(df, max_route=0.35, min_precision=0.4), ["route_rate", "precision"])

    @add(
        "exact_thresholds",
        "D13",
        sql(
            "judged",
            """SELECT low, high, fp, tp, fn, routes, fp * 5.0::DOUBLE + fn * 3.0::DOUBLE + routes AS cost, round(routes / n::DOUBLE, 6) AS route_rate,
            round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision FROM
            (SELECT low, high, fn, tp, gone - tp AS fp, n - kept - gone AS routes, n FROM lows, highs, (SELECT count(*) AS n FROM judged) WHERE low < high OR low IS NULL OR high IS NULL)
            WHERE routes / n::DOUBLE <= 0.35 AND coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) >= 0.4 ORDER BY cost, low NULLS FIRST, high NULLS FIRST LIMIT 1""",
            "steps AS (SELECT round(p_bad, 6) AS s, count(*) AS n, sum(y) AS bad FROM judged GROUP BY 1)",
            """lows AS (SELECT s AS low, (sum(n) OVER (ORDER BY s))::BIGINT AS kept, (sum(bad) OVER (ORDER BY s))::BIGINT AS fn FROM steps UNION ALL SELECT NULL, 0, 0),
            highs AS (SELECT s AS high, (sum(n) OVER (ORDER BY s DESC))::BIGINT AS gone, (sum(bad) OVER (ORDER BY s DESC))::BIGINT AS tp FROM steps UNION ALL SELECT NULL, 0, 0)""",
        ),
    )
    def _(spark, folder):
        df = routing_input(spark, folder).withColumn("p_final", F.round("p_final", 6))
        return r6(H.exact_thresholds(df, max_route=0.35, min_precision=0.4), ["route_rate", "precision"])

    @add(
        "best_thresholds",
        "D13",
        sql(
            "judged",
            """SELECT low, high, fp * 5.0::DOUBLE + fn * 3.0::DOUBLE + routes AS cost FROM grid WHERE routes / n::DOUBLE <= 0.5
            AND coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) >= 0.2 ORDER BY 3, 1, 2 LIMIT 1""",
            f"grid AS ({grid})",
        ),
    )
    def _(spark, folder):
        costs = B.cost_grid(routing_input(spark, folder), max_route=0.5, min_precision=0.2)
        return B.best_setting(costs).select("low", "high", "cost")

    curve = """steps AS (SELECT c, n, sum(n) OVER (ORDER BY c DESC) AS cn, sum(bad) OVER (ORDER BY c DESC) AS cb, sum(n) OVER () AS t FROM
    (SELECT round(confidence, 4) AS c, count(*)::DOUBLE AS n, sum(CAST(truth <> prediction AS INT))::DOUBLE AS bad FROM judged GROUP BY 1))"""

    def rc(spark, folder):
        df = P.judged(spark, folder).withColumn("c", F.round("text_confidence", 4))
        return B.risk_coverage(df, "c", F.col("truth") != F.col("prediction"))

    @add(
        "risk_coverage_curve",
        "D14",
        sql("judged", "SELECT c AS confidence, round(cn / t, 6) AS coverage, round(cb / cn, 6) AS risk FROM steps", curve),
    )
    def _(spark, folder):
        return r6(rc(spark, folder), ["coverage", "risk"]).select(F.col("c").alias("confidence"), "coverage", "risk")

    @add("risk_coverage_area", "D14", sql("judged", "SELECT round(sum(n / t * cb / cn), 6) AS aurc FROM steps", curve))
    def _(spark, folder):
        return r6(B.risk_coverage_area(rc(spark, folder)), ["aurc"])

    @add(
        "calibration_error",
        "D15",
        sql(
            "judged",
            """SELECT round(sum(sq) / sum(n), 6) AS brier, round(sum(abs(sp - sy)) / sum(n), 6) AS ece FROM (SELECT count(*) AS n, sum(p_bad) AS sp, sum(y) AS sy,
            sum((p_bad - y) * (p_bad - y)) AS sq FROM judged GROUP BY least(floor(p_bad * 10), 9))""",
        ),
    )
    def _(spark, folder):
        return r6(M.calibration_error(P.judged(spark, folder), "p_bad"), ["brier", "ece"])

    @add(
        "queue_metrics",
        "D16",
        sql(
            "judged",
            """SELECT count(*) FILTER (WHERE action = 'route') AS routed, round(count(*) FILTER (WHERE action = 'route' AND y = 1) / nullif(count(*) FILTER (WHERE action = 'route'), 0)::DOUBLE, 6) AS queue_precision,
            round(count(*) FILTER (WHERE action = 'route' AND y = 1) / sum(y)::DOUBLE, 6) AS capture_rate FROM routed""",
            routed_sql(gates),
        ),
    )
    def _(spark, folder):
        out = B.budgeted(routing_input(spark, folder), budget=0.05, meta_gate=0.98, disagreement=0.9)
        return r6(B.queue_metrics(out), ["queue_precision", "capture_rate"])

    @add(
        "score_drift",
        "D17",
        sql(
            "judged",
            """SELECT round(sum((a - b) * ln(a / b)), 6) AS psi FROM (SELECT greatest(x / sum(x) OVER (), 1e-6) AS a, greatest(z / sum(z) OVER (), 1e-6) AS b FROM
            (SELECT count(*) FILTER (WHERE published_at < TIMESTAMP '2024-01-16')::DOUBLE AS x, count(*) FILTER (WHERE published_at >= TIMESTAMP '2024-01-16')::DOUBLE AS z
            FROM judged GROUP BY least(floor(p_bad * 10), 9)))""",
        ),
    )
    def _(spark, folder):
        first = F.col("published_at") < F.lit("2024-01-16").cast("timestamp")
        return r6(M.stability_index(P.judged(spark, folder), "p_bad", first), ["psi"])

    @add(
        "removal_spikes",
        "D17",
        sql(
            "judged",
            """SELECT CAST(day AS VARCHAR) AS day, round(fpr, 6) AS fpr, coalesce(fpr > (SELECT avg(fpr) + 3 * stddev_samp(fpr) FROM daily), false) AS alert FROM daily""",
            """daily AS (SELECT CAST(published_at AS DATE) AS day, coalesce(count(*) FILTER (WHERE p_bad >= 0.9 AND y = 0) / nullif(count(*) FILTER (WHERE y = 0), 0)::DOUBLE, 0) AS fpr
            FROM judged GROUP BY 1)""",
        ),
    )
    def _(spark, folder):
        out = M.removal_spikes(P.judged(spark, folder), F.to_date("published_at"), F.col("p_bad") >= 0.9)
        return out.select(F.col("day").cast("string").alias("day"), F.round("fpr", 6).alias("fpr"), "alert")

    @add(
        "sliced_metrics",
        "D18",
        sql(
            "judged",
            """SELECT category, language, count(*) AS n, round(avg(CAST(y = yhat AS INT)), 6) AS accuracy,
            round(coalesce(count(*) FILTER (WHERE yhat = 1 AND y = 1) / nullif(count(*) FILTER (WHERE yhat = 1), 0)::DOUBLE, 0), 6) AS precision
            FROM judged GROUP BY GROUPING SETS ((), (category), (language))""",
        ),
    )
    def _(spark, folder):
        return r6(M.sliced_metrics(P.judged(spark, folder), ["category", "language"]), ["accuracy", "precision"])

    @add(
        "stage_disagreement",
        "D19",
        sql(
            "probs",
            """SELECT review_id, CAST((p_bad >= 0.5) <> (enhanced_prob >= 0.5) AS INT) AS stages_disagree, CAST(abs(p_bad - enhanced_prob) >= 0.5 AS INT) AS wide_gap FROM probs""",
        ),
    )
    def _(spark, folder):
        df = P.with_logits(spark, folder).withColumns(M.disagreement(F.col("p_bad"), F.col("enhanced_prob")))
        return df.select("review_id", "stages_disagree", "wide_gap")

    cat_hits = " ".join(f"WHEN '{c}' THEN {hits('low', t)}" for c, t in CATEGORY_TERMS.items())

    @add(
        "relevancy_score",
        "D20",
        sql(
            "reviews",
            f"""SELECT review_id, category_hits, name_mention, off_topic_hits, round(greatest(0, least(1, 0.4 + 0.15 * category_hits + 0.2 * name_mention - 0.3 * off_topic_hits))::DOUBLE, 6) AS relevancy_score
            FROM (SELECT review_id, CASE category {cat_hits} END AS category_hits, CAST(contains(low, lower(language)) AS INT) AS name_mention, {hits('low', OFF_TOPIC_TERMS)} AS off_topic_hits
            FROM (SELECT *, lower(coalesce(text, '')) AS low FROM reviews))""",
        ),
    )
    def _(spark, folder):
        # The tables name no business; the language code stands for the name to be mentioned.
        df = P.reviews(spark, folder).withColumn("business_name", F.col("language"))
        out = X.relevancy_parts(df)
        return out.select("review_id", "category_hits", "name_mention", "off_topic_hits", F.round("relevancy_score", 6).alias("relevancy_score"))

    @add("category_similarity", "D21")
    def _(spark, folder):
        return r6(G.category_cosine_summary(*P.review_parts(spark, folder)), ["mean_cosine", "max_cosine"])

    @add(
        "business_similarity",
        "D21",
        sql(
            "reviews",
            """SELECT r.review_id, round(s.cosine, 6) AS business_similarity FROM reviews r LEFT JOIN
            (SELECT review_id, CASE WHEN vv > 0 AND others > 1e-9 * cc THEN least(1, greatest(0, vc - vv) / sqrt(vv * others)) ELSE 0 END AS cosine FROM
              (SELECT review_id, vc, vv, cc, cc - 2 * vc + vv AS others FROM
                (SELECT review_id, place_id, sum(w * c) AS vc, sum(w * w) AS vv FROM weighted JOIN centre USING (place_id, term) GROUP BY ALL)
                JOIN (SELECT place_id, sum(c * c) AS cc FROM centre GROUP BY ALL) USING (place_id))) s USING (review_id)""",
            """counted AS (SELECT review_id, place_id, term, count(*) AS tf FROM
              (SELECT review_id, place_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM reviews WHERE place_id IS NOT NULL) GROUP BY ALL)""",
            """weights AS (SELECT term, ln(((SELECT count(DISTINCT review_id) FROM counted) + 1)::DOUBLE / (count(*) + 1)::DOUBLE) AS idf FROM counted GROUP BY term)""",
            "weighted AS (SELECT review_id, place_id, term, tf * idf AS w FROM counted JOIN weights USING (term))",
            "centre AS (SELECT place_id, term, sum(w) AS c FROM weighted GROUP BY ALL)",
        ),
    )
    def _(spark, folder):
        rows, texts, endings = P.review_parts(spark, folder)
        rows = rows.select(F.col("review_id").alias("_row"), F.col("place_id").alias("_key"), "_text", "_tail")
        out = rows.select("_row", "_key").join(Y.shared_similarity(rows, texts, endings), ["_row", "_key"], "left")
        return out.select(F.col("_row").alias("review_id"), F.round("score", 6).alias("business_similarity"))

    @add(
        "name_links",
        "D21",
        """WITH names AS (SELECT doc_id, nullif(trim(regexp_replace(lower(regexp_extract(text, '^[^.,\\n]{0,80}')), '[^a-z0-9]+', ' ', 'g')), '') AS name FROM documents),
        classes AS (SELECT name, min(doc_id) AS name_class FROM names WHERE name IS NOT NULL GROUP BY name)
        SELECT doc_id, name_class, coalesce(n, 0) AS links FROM names LEFT JOIN classes USING (name) LEFT JOIN
        (SELECT a.name, count(*) AS n FROM classes a JOIN classes b ON a.name <> b.name AND abs(length(a.name) - length(b.name)) <= 0.2 * greatest(length(a.name), length(b.name)) + 1e-9
          AND levenshtein(a.name, b.name) <= 0.2::DOUBLE * greatest(length(a.name), length(b.name)) + 1e-9 GROUP BY a.name) USING (name)""",
    )
    def _(spark, folder):
        # No table names businesses under several spellings; the opening phrase of a document stands for such a name.
        return Y.name_links(P.table(spark, folder, "documents"), "doc_id", F.regexp_extract("text", r"^[^.,\n]{0,80}", 0))

    @add(
        "fuzzy_name_match",
        "D21",
        sql(
            "reviews",
            "SELECT review_id, round(1 - levenshtein(lower(location), lower(category)) / greatest(length(location), length(category))::DOUBLE, 6) AS ratio FROM reviews",
        ),
    )
    def _(spark, folder):
        return P.reviews(spark, folder).select(
            "review_id", F.round(G.fuzzy_ratio(F.col("location"), F.col("category")), 6).alias("ratio")
        )

    @add(
        "surface_rules",
        "D23",
        sql(
            "reviews",
            f"""SELECT review_id, round(CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^A-Z]', '', 'g')) / length(t)::DOUBLE ELSE 0 END, 6) AS upper_share,
            CAST(length(t) - length(replace(t, '!', '')) AS INT) AS exclamations, round(CASE WHEN len(w) > 0 THEN 1 - len(list_distinct(w)) / len(w)::DOUBLE ELSE 0 END, 6) AS repeated_word_share,
            {hits('lower(t)', PRAISE_PHRASES)} AS praise_hits,
            CAST(coalesce(abs(length(t) - avg(length(t)) OVER ()) / (stddev_samp(length(t)) OVER () + 1e-6) > 3, false) AS INT) AS length_outlier
            FROM (SELECT review_id, coalesce(text, '') AS t, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM reviews)""",
        ),
    )
    def _(spark, folder):
        # The rules written once: the statistics of the lengths make a pass of their own over them.
        df = P.reviews(spark, folder)
        df = df.select("review_id", F.coalesce(X.measure("length"), F.lit(0)).alias("n"), *[c.alias(k) for k, c in G.measured_surface().items()])
        z = z_scores(cut_lineage(df), ["n"])
        return z.select(
            "review_id", F.round("upper_share", 6).alias("upper_share"), "exclamations", F.round("repeated_word_share", 6).alias("repeated_word_share"),
            "praise_hits", (F.col("n_anomaly") > 3).cast("int").alias("length_outlier"),
        )

    @add(
        "metadata_hints",
        "D24",
        sql(
            "ruled",
            """SELECT review_id, round(helpful_votes / nullif(total_votes, 0)::DOUBLE, 6) AS helpful_ratio, CAST(NOT verified_purchase AS INT) AS unverified,
            CAST(location = 'Unknown' AS INT) AS unknown_location, CAST(count(*) OVER (PARTITION BY place_id, CAST(published_at AS DATE)) > 5 AS INT) AS crowded_day,
            CAST(regexp_full_match(reviewer_name, '[A-Za-z]+_?[0-9]+') AS INT) AS generic_name,
            CAST(coalesce((text_prediction = 'genuine_negative' AND stars >= 4) OR (text_prediction = 'genuine_positive' AND stars <= 2), false) AS INT) AS rating_mismatch FROM ruled""",
        ),
    )
    def _(spark, folder):
        from probity.operators.scoring import rule_scores

        df = rule_scores(P.reviews(spark, folder)).drop("text", "probs", "class_probabilities")
        out = G.metadata_hints(df)
        return out.select(
            "review_id", F.round("helpful_ratio", 6).alias("helpful_ratio"), "unverified", "unknown_location", "crowded_day",
            "generic_name", "rating_mismatch",
        )

    serving = "CASE prediction WHEN 'genuine_positive' THEN 'genuine' WHEN 'genuine_negative' THEN 'genuine' WHEN 'spam' THEN 'high-confidence-spam' WHEN 'inappropriate' THEN 'high-confidence-spam' WHEN 'irrelevant' THEN 'low-quality' ELSE 'suspicious' END"

    @add(
        "model_vote",
        "D25",
        sql(
            "probs",
            f"""SELECT review_id, CASE WHEN CAST(a = 'genuine' AS INT) + CAST(b = 'genuine' AS INT) + CAST(c = 'genuine' AS INT) >= 2 THEN 'genuine'
            WHEN CAST(a = 'high-confidence-spam' AS INT) + CAST(b = 'high-confidence-spam' AS INT) + CAST(c = 'high-confidence-spam' AS INT) >= 2 THEN 'high-confidence-spam'
            ELSE 'suspicious' END AS decision FROM (SELECT review_id, {serving} AS a, {cascade(.35, .25, .15)} AS b, {four_tier.replace('s <', four + ' <')} AS c FROM probs)""",
        ),
    )
    def _(spark, folder):
        df = decided(spark, folder)
        s = R.four_stage_score(F.col("p_bad"), F.col("enhanced_prob"), F.col("relevancy"), F.col("is_relevant"))
        df = df.select(
            "review_id",
            R.serving_decision(F.col("text_prediction")).alias("a"),
            R.threshold_decision(F.col("decision_probs"))["final_prediction"].alias("b"),
            R.four_stage_tier(s).alias("c"),
        )
        return df.select("review_id", R.vote(F.col("a"), F.col("b"), F.col("c")).alias("decision"))

    sweep = " UNION ALL ".join(
        f"""SELECT '{name}' AS setting, '{d}' AS decision, count(*) FILTER (WHERE {cascade(*cuts)} = '{d}') AS n, {K.TARGET_SHARES[d][0]}::DOUBLE AS target_low,
        {K.TARGET_SHARES[d][1]}::DOUBLE AS target_high, round(count(*) FILTER (WHERE {cascade(*cuts)} = '{d}') * 100.0::DOUBLE / count(*), 6) AS percent FROM probs"""
        for name, cuts in K.DECISION_THRESHOLDS.items()
        for d in DECISIONS
    )

    @add("threshold_sweep", "D26", sql("probs", f"SELECT *, percent BETWEEN target_low AND target_high AS on_target FROM ({sweep})"))
    def _(spark, folder):
        return r6(M.decision_sweep(decided(spark, folder), "decision_probs", K.DECISION_THRESHOLDS), ["percent"])

    presets = " UNION ALL ".join(
        f"SELECT '{name}' AS preset, '{t}' AS tier, count(*) FILTER (WHERE {tiers(cuts)} = '{t}') AS n, round(count(*) FILTER (WHERE {tiers(cuts)} = '{t}') * 100.0::DOUBLE / count(*), 6) AS percent FROM tested"
        for name, cuts in K.TIER_PRESETS.items()
        for t in K.TIERS
    )

    @add("tier_sweep", "D26 F21", sql("tested", presets))
    def _(spark, folder):
        return r6(M.tier_sweep(P.tested(spark, folder), "fusion_risk_score"), ["percent"])

    @add(
        "language_share",
        "D28",
        sql(
            "reviews",
            "SELECT round(avg(CAST(language <> 'en' AS INT)), 6) AS foreign_share, avg(CAST(language <> 'en' AS INT)) > 0.2 AS red_flag FROM reviews",
        ),
    )
    def _(spark, folder):
        return r6(M.foreign_share(P.reviews(spark, folder)), ["foreign_share"])


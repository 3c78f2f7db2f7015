"""Streams over the event table.

The windowed streams read it from several files in time order, and every tenth event in a last file: most of those are
later than the watermark allows and are dropped, as the check SQL says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from probity.plans import reviews as P
from probity.plans.catalog.sql import sql
from probity.session import checkpoint_dir
from probity.streaming import jobs as J
from probity.streaming import rings as R


def stream(spark, folder):
    schema = P.table(spark, folder, "events").schema
    events = J.read_stream(spark, folder, schema, glob="events.parquet")
    return P.as_reviews(events, P.table(spark, folder, "documents"), P.table(spark, folder, "labels"))


PARTS = 4
FILE_ROWS = 50_000


def late_stream(spark, folder):
    """The events in folders by time, the tenth of them that comes late in the last; one folder per micro-batch.

    Every folder has the same number of files, for the largest part as many as it needs; empty ones fill up a small part.
    Events without a time are in the first folder.
    """
    events = P.table(spark, folder, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = events.agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    part = F.when(F.col("event_id") % 10 == 0, PARTS).otherwise(F.coalesce(F.floor((us - lo) * PARTS / (hi - lo + 1)).cast("int"), F.lit(0)))
    staged = f"{checkpoint_dir(spark)}/events-{uuid.uuid4().hex}"
    most = max((r["count"] for r in events.groupBy(part.alias("part")).count().collect()), default=0)
    files = max(1, -(-most // FILE_ROWS))
    for i in range(PARTS + 1):
        path = f"{staged}/{i}"
        events.filter(part == i).repartition(files).write.parquet(path)
        for _ in range(files - len(spark.read.schema(events.schema).parquet(path).inputFiles())):
            events.limit(0).coalesce(1).write.mode("append").parquet(path)
    rows = J.read_stream(spark, f"{staged}/*", events.schema, files_per_trigger=files)
    return P.as_reviews(rows, P.table(spark, folder, "documents"), P.table(spark, folder, "labels"))


def on_time(view: str, rows: str, window_end: str) -> str:
    """SQL of the rows of ``rows`` that a stream with two days of delay keeps, in windows that are closed at its end.

    A batch drops late rows by the watermark that the batch before it ran with.
    """
    return f"""ends AS (SELECT min(epoch_us(CAST(ts AS TIMESTAMP))) AS lo, max(epoch_us(CAST(ts AS TIMESTAMP))) AS hi FROM events),
arrived AS (SELECT event_id, epoch_us(CAST(ts AS TIMESTAMP)) AS us, CASE WHEN event_id % 10 = 0 THEN {PARTS}
  ELSE CAST(floor(CAST((epoch_us(CAST(ts AS TIMESTAMP)) - lo) * {PARTS} AS DOUBLE) / (hi - lo + 1)) AS INT) END AS part FROM events CROSS JOIN ends),
marks AS (SELECT p.part, (SELECT max(us) FROM arrived a WHERE a.part < p.part - 1) - 172800000000 AS mark FROM (SELECT DISTINCT part FROM arrived) p),
{view} AS (SELECT x.* FROM {rows} x JOIN arrived a ON a.event_id = x.review_id JOIN marks m ON m.part = a.part
  WHERE (m.mark IS NULL OR epoch_us({window_end}) > m.mark) AND epoch_us({window_end}) <= (SELECT max(us) FROM arrived) - 172800000000)"""


def register(catalog):
    add = catalog.add

    @add(
        "stream_scores",
        "X1 X5 S18",
        sql("tested", "SELECT review_id, text_prediction, round(risk, 6) AS fusion_risk_score, tier AS fusion_prediction FROM tested"),
    )
    def _(spark, folder):
        scored = J.score_stream(stream(spark, folder)).select(
            "review_id", "text_prediction", "fusion_risk_score", "fusion_prediction"
        )
        return J.run_to_table(scored).withColumn("fusion_risk_score", F.round("fusion_risk_score", 6))

    @add(
        "stream_totals",
        "X2 R6",
        sql(
            "served",
            """SELECT total_processed, genuine_count, suspicious_count, low_quality_count, spam_count, round(genuine_count / total_processed::DOUBLE * 100, 1) AS genuine_percentage,
            round((total_processed - genuine_count) / total_processed::DOUBLE * 100, 1) AS flagged_percentage FROM (SELECT count(*) AS total_processed,
            count(*) FILTER (WHERE final_prediction = 'genuine') AS genuine_count, count(*) FILTER (WHERE final_prediction = 'suspicious') AS suspicious_count,
            count(*) FILTER (WHERE final_prediction = 'low-quality') AS low_quality_count, count(*) FILTER (WHERE final_prediction = 'high-confidence-spam') AS spam_count FROM served)""",
        ),
    )
    def _(spark, folder):
        return J.run_to_table(J.decision_totals(late_stream(spark, folder)), "complete")

    @add(
        "stream_decisions_per_day",
        "X3",
        sql(
            "served",
            "SELECT CAST(CAST(published_at AS DATE) AS VARCHAR) AS day, final_prediction, count(*) AS n FROM kept GROUP BY 1, 2",
            on_time("kept", "served", "CAST(CAST(x.published_at AS DATE) + INTERVAL 1 DAY AS TIMESTAMP)"),
        ),
    )
    def _(spark, folder):
        out = J.run_to_table(J.decisions_per_window(late_stream(spark, folder)))
        return out.select(F.to_date("start").cast("string").alias("day"), "final_prediction", "n")

    @add(
        "stream_rolling_reviewer_counts",
        "X4",
        sql(
            "reviews",
            """SELECT CAST(d AS VARCHAR) AS first_day, reviewer_id, count(*) AS reviews, round(avg(stars), 6) AS stars_mean FROM
            kept GROUP BY d, reviewer_id""",
            """spread AS (SELECT review_id, reviewer_id, stars,
              unnest(generate_series(CAST(published_at AS DATE) - INTERVAL 6 DAYS, CAST(published_at AS DATE), INTERVAL 1 DAY))::DATE AS d FROM reviews)""",
            on_time("kept", "spread", "CAST(x.d + INTERVAL 7 DAYS AS TIMESTAMP)"),
        ),
    )
    def _(spark, folder):
        out = J.run_to_table(J.rolling_reviewer_counts(late_stream(spark, folder)))
        return out.select(
            F.to_date("start").cast("string").alias("first_day"), "reviewer_id", "reviews", F.round("stars_mean", 6).alias("stars_mean")
        )

    def span_sql(days):
        return f"""CAST(sum(reviews) OVER span{days} AS BIGINT) AS reviews_{days}d, round(sum(stars) OVER span{days} / nullif(sum(rated) OVER span{days}, 0), 6) AS stars_mean_{days}d"""

    @add(
        "stream_rolling_reviewer_days",
        "X4",
        sql(
            "reviews",
            f"""SELECT CAST(day AS VARCHAR) AS day, reviewer_id, {span_sql(7)}, {span_sql(30)} FROM days
            WINDOW span7 AS (PARTITION BY reviewer_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW),
            span30 AS (PARTITION BY reviewer_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)""",
            on_time("kept", "reviews", "CAST(CAST(x.published_at AS DATE) + INTERVAL 1 DAY AS TIMESTAMP)"),
            """days AS (SELECT reviewer_id, CAST(published_at AS DATE) AS day, CAST(count(*) AS BIGINT) AS reviews, count(stars) AS rated, sum(stars) AS stars
            FROM kept WHERE reviewer_id IS NOT NULL GROUP BY 1, 2)""",
        ),
    )
    def _(spark, folder):
        out = J.run_to_table(R.rolling_reviewer_days(late_stream(spark, folder)))
        means = [f"stars_mean_{d}d" for d in R.SPANS]
        return out.withColumn("day", F.date_from_unix_date(F.col("day").cast("int")).cast("string")).withColumns({m: F.round(m, 6) for m in means})

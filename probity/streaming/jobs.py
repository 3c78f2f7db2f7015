"""Streams of reviews. Scoring is the batch function; only state and sinks differ."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from probity.operators.reports import running_totals
from probity.operators.scoring import serving_scores, tester_scores
from probity.session import checkpoint_dir


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", glob: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def score_stream(reviews: DataFrame) -> DataFrame:
    return tester_scores(reviews)


def decision_totals(reviews: DataFrame) -> DataFrame:
    """Running totals per decision. One row of state, whatever the length of the stream."""
    return running_totals(serving_scores(reviews))


def decisions_per_window(
    reviews: DataFrame, length: str = "1 day", delay: str = "2 days", ts: str = "published_at"
) -> DataFrame:
    """Decisions per time window; rows later than ``delay`` behind the newest are dropped."""
    scored = serving_scores(reviews.withWatermark(ts, delay))
    return (
        scored.groupBy(F.window(ts, length).alias("w"), "final_prediction")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "final_prediction", "n")
    )


def rolling_reviewer_counts(
    reviews: DataFrame, length: str = "7 days", slide: str = "1 day", delay: str = "2 days",
    key: str = "reviewer_id", ts: str = "published_at", stars: str = "stars",
) -> DataFrame:
    """Reviews and mean stars per reviewer in sliding windows (day grain)."""
    slim = reviews.select(key, ts, stars).withWatermark(ts, delay)
    return (
        slim.groupBy(F.window(ts, length, slide).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("reviews"), F.avg(stars).alias("stars_mean"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "reviews", "stars_mean")
    )


def progress_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch has its own folder and overwrites it, so a batch run twice counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def start_progress(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes finished rows batch by batch; a restart goes on after the last finished batch."""
    writer = stream.writeStream.foreachBatch(progress_writer(path)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over everything there is now and reads back what it wrote.

    In complete mode every batch holds the whole result, so the last one is read.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(progress_writer(f"{base}/rows"))
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    out = spark.read.schema(schema).parquet(f"{base}/rows")
    if mode == "complete":
        out = out.filter(F.col("batch_id") == out.agg(F.max("batch_id").alias("b")).scalar())
    return out.select(*stream.columns)

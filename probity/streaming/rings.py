"""Rolling reviewer counts on a stream: a ring of day buckets per reviewer, kept as arbitrary keyed state with event-time timers.

The stream is counted per reviewer and day first (a windowed aggregation with partial sums, so a reviewer with a third of
all reviews sends one row a day and task). Each closed day goes through the reviewer's ring once and leaves with the sums of every
span that ends with it. The ring holds the days of the longest span only, and a timer drops it when the last day has left that span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
SPANS = (7, 30)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKET = np.dtype([("day", "<i8"), ("reviews", "<i8"), ("rated", "<i8"), ("stars", "<f8")])


def span_names(days: int) -> list[str]:
    return [f"reviews_{days}d", f"stars_mean_{days}d"]


def advance(ring: np.ndarray, closed: np.ndarray, spans: tuple[int, ...]) -> tuple[np.ndarray, list[tuple]]:
    """Puts closed days, in order, into the ring of earlier days.

    Gives the ring afterwards and, for each closed day, (day, then reviews and mean stars of each span that ends with it).
    """
    out, longest = [], max(spans)
    for bucket in np.sort(closed, order="day"):
        day = int(bucket["day"])
        ring = np.append(ring[ring["day"] > day - longest], bucket)
        row: list = [day]
        for span in spans:
            part = ring[ring["day"] > day - span]
            rated = int(part["rated"].sum())
            row += [int(part["reviews"].sum()), float(part["stars"].sum()) / rated if rated else None]
        out.append(tuple(row))
    return ring, out


class ReviewerRings(StatefulProcessor):
    def __init__(self, key: str, spans: tuple[int, ...]):
        self.key, self.spans = key, spans
        self.columns = [key, "day", *[n for s in spans for n in span_names(s)]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ring", "buckets binary")

    def _ring(self) -> np.ndarray:
        return np.frombuffer(bytes(self.state.get()[0]), BUCKET) if self.state.exists() else np.zeros(0, BUCKET)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = [tuple(r) for pdf in rows for r in pdf[list(BUCKET.names)].fillna({"stars": 0.0}).itertuples(index=False)]
        ring, out = advance(self._ring(), np.array(closed, BUCKET), self.spans)
        self.state.update((ring.tobytes(),))
        self.handle.registerTimer((int(ring["day"][-1]) + 1 + max(self.spans)) * DAY_MS)
        frame = pd.DataFrame([(key[0], *r) for r in out], columns=self.columns)
        yield frame.astype({n: "Int64" if n.startswith("reviews") else "float64" for n in self.columns[2:]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ring = self._ring()
        if len(ring) and (int(ring["day"][-1]) + 1 + max(self.spans)) * DAY_MS <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield pd.DataFrame({c: [] for c in self.columns})

    def close(self) -> None:
        pass


def rolling_reviewer_days(
    reviews: DataFrame, spans: tuple[int, ...] = SPANS, delay: str = "2 days", key: str = "reviewer_id", ts: str = "published_at",
    stars: str = "stars",
) -> DataFrame:
    """One row per reviewer and day with reviews, once the day is closed: reviews and mean stars of the 7 and 30 days that end with it.

    A day is closed when the watermark, ``delay`` behind the newest time, has passed its end; rows that come later are dropped. Rows
    without a time or reviewer do not count. Restarts go on from the state in the checkpoint.
    """
    spark = reviews.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    slim = reviews.select(key, ts, stars).filter(F.col(key).isNotNull()).withWatermark(ts, delay)
    days = slim.groupBy(F.window(ts, "1 day").alias("w"), key).agg(
        F.count(F.lit(1)).alias("reviews"), F.count(stars).alias("rated"), F.coalesce(F.sum(stars), F.lit(0.0)).alias("stars")
    )
    days = days.select(key, F.window_time("w").alias("closed"), F.unix_date(F.to_date("w.start")).alias("day"), "reviews", "rated", "stars")
    kind = reviews.schema[key].dataType.simpleString()
    shape = f"{key} {kind}, day long, " + ", ".join(f"{n} {'long' if n.startswith('reviews') else 'double'}" for s in spans for n in span_names(s))
    return days.groupBy(key).transformWithStateInPandas(ReviewerRings(key, tuple(spans)), shape, "Append", "EventTime")

"""Calendar parts and time differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def day_of_week(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def whole_days(diff_micros: Column) -> Column:
    return F.floor(diff_micros / F.lit(float(DAY_MICROS))).cast("long")

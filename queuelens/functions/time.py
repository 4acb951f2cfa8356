"""Time expressions over integer microsecond timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_SECOND = 1_000_000
US_PER_MINUTE = 60_000_000
MINUTES_PER_DAY = 1440


def minute_bucket(ts: Column) -> Column:
    """Minute index since time 0: ``floor(ts / 60,000,000)`` as bigint."""
    return F.floor(ts / F.lit(US_PER_MINUTE)).cast("bigint")


def _index(ts: Column, seconds: int) -> Column:
    # Absolute index since time 0 (not hour-of-day); integer overflow raises.
    return F.floor(ts / F.lit(1e6) / F.lit(seconds)).cast("int")


def day_index(ts: Column) -> Column:
    return _index(ts, 86400)


def hour_index(ts: Column) -> Column:
    return _index(ts, 3600)


def minute_index(ts: Column) -> Column:
    return _index(ts, 60)


def seconds_between(start_us: Column, end_us: Column) -> Column:
    """``(end - start) / 1e6`` as double seconds."""
    return (end_us - start_us) / F.lit(1e6)

"""Clock-aligned batch boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_US_HOUR = 3_600_000_000
_US_MIN = 60_000_000


def next_boundary(ts, interval_minutes: int | Column) -> Column:
    """Next clock boundary after ``ts`` (UTC).

    The minute is floored to the interval and one interval added; reaching 60 or more
    rolls to the next full hour, so the grid restarts every hour (an interval of 25 gives
    :25, :50, :00). Intervals >= 60 always give the next full hour. Integer arithmetic on
    epoch microseconds keeps the result independent of the session time zone.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    b = F.lit(interval_minutes) if isinstance(interval_minutes, int) else interval_minutes
    if isinstance(interval_minutes, int) and interval_minutes < 1:
        raise ValueError("interval must be >= 1 minute")
    us = F.unix_micros(ts.cast("timestamp"))
    into_hour = F.pmod(us, F.lit(_US_HOUR))
    hour_start = us - into_hour
    minute = F.floor(into_hour / F.lit(_US_MIN)).cast("long")
    step = F.least(F.lit(60).cast("long"), (F.floor(minute / b).cast("long") + 1) * b)
    return F.timestamp_micros(hour_start + step * F.lit(_US_MIN))


def batch_minutes(batch_duration_s: int) -> int:
    """Minutes per batch from the batch duration in seconds (60..3600)."""
    if not 60 <= batch_duration_s <= 3600:
        raise ValueError("batch_duration must be within 60..3600 seconds")
    return batch_duration_s // 60

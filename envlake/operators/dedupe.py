"""Duplicate readings from at-least-once writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def dedupe_readings(df: DataFrame, keys: Sequence[str] = ("station", "timestamp")) -> DataFrame:
    """Keep one row per (station, timestamp). A retried flush rewrites identical rows, so
    which copy survives does not matter. Partial aggregation drops map-side duplicates
    before the shuffle."""
    return df.dropDuplicates(list(keys))

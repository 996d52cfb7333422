"""Canonical storage types: measurements as float32, timestamp at millisecond precision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlake.schema import SENSOR_FLOAT_COLUMNS


def canonical_dtypes(df: DataFrame) -> DataFrame:
    """Cast present measurement columns to FLOAT and truncate ``timestamp`` to ms.

    Absent columns stay absent (a failed sensor leaves its keys out of the batch).
    """
    out = []
    for name in df.columns:
        if name in SENSOR_FLOAT_COLUMNS:
            out.append(F.col(name).cast("float").alias(name))
        elif name == "timestamp":
            out.append(F.date_trunc("millisecond", F.col(name).cast("timestamp")).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)

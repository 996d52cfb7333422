"""The collector's data path as one declarative Spark plan.

raw readings -> sensor groups (O07, O09) -> per-(station, boot) sequence state (O17)
-> temperature/humidity compensation (O11, O12) -> warm-up skip (O18), health sampling
(O19) and as-collected batches (O21b).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlake.functions.compensation import (DEFAULT_FACTOR, compensate_humidity,
                                            compensate_temperature, cpu_temperature)
from envlake.operators.assemble import assemble_reading
from envlake.operators.batching import batch_assign_as_collected, batch_partition_values
from envlake.operators.sequence import DEFAULT_CHUNK_SECONDS, sequence_features
from envlake.schema import SENSOR_FLOAT_COLUMNS

# Fixed values of the collector: readings skipped after start, health every N readings,
# CPU temperatures averaged, default batch length.
WARMUP_READINGS = 10
HEALTH_EVERY = 12
CPU_WINDOW = 5
BATCH_MINUTES = 15

READING_COLUMNS = ["station", "boot_id", "event_id", "timestamp", *SENSOR_FLOAT_COLUMNS]


def sequenced_readings(raw: DataFrame, *, compensation: bool = True,
                       factor: float = DEFAULT_FACTOR, keys=("station", "boot_id"),
                       chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
                       cpu_col: str = "cpu_temp_c", cpu_scale: float = 1.0) -> DataFrame:
    """All readings (warm-up included) with corrected values and sequence columns.

    ``cpu_col`` holds the CPU temperature (degrees, or millidegrees with
    ``cpu_scale=1000``); a missing value counts as 40.0 C. The 5-deep CPU mean only
    advances on readings whose BME temperature and humidity were read, and includes
    warm-up readings (the reference corrects before it discards).
    """
    a = assemble_reading(raw)
    cpu = F.col(cpu_col) if cpu_scale == 1.0 else F.col(cpu_col) * (1000.0 / cpu_scale)
    cpu = cpu_temperature(cpu, for_compensation=True) if cpu_scale != 1.0 else \
        F.coalesce(F.col(cpu_col), F.lit(40.0))
    a = a.withColumn("cpu_for_compensation", cpu)
    seq = sequence_features(a, keys=keys, value_col="cpu_for_compensation" if compensation else None,
                            ok_col="bme_ok", depth=CPU_WINDOW, chunk_seconds=chunk_seconds)
    if compensation:
        temp = F.when(F.col("bme_ok"), compensate_temperature("raw_temperature", "seq_roll_mean", factor))
        hum = F.when(F.col("pressure_ok"),
                     compensate_humidity("rh_for_compensation", "raw_temperature", temp))
    else:
        temp = F.col("raw_temperature")
        hum = F.col("raw_humidity")
    return seq.withColumns({"temperature": temp, "humidity": hum})


def corrected_readings(raw: DataFrame, *, compensation: bool = True, factor: float = DEFAULT_FACTOR,
                       warmup: int = WARMUP_READINGS, health_every: int = HEALTH_EVERY,
                       batch_minutes: int = BATCH_MINUTES, keys=("station", "boot_id"),
                       chunk_seconds: int = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """Kept readings (after warm-up) with ``batch_end`` and the ``health_sample`` flag."""
    s = sequenced_readings(raw, compensation=compensation, factor=factor, keys=keys,
                           chunk_seconds=chunk_seconds)
    s = batch_assign_as_collected(s, batch_minutes, warmup)
    n = F.col("seq_rn")
    s = s.withColumn("health_sample", (n > warmup) & (n % health_every == 0))
    return s.where(n > warmup)


def lake_readings(corrected: DataFrame) -> DataFrame:
    """Readings with batch-level partition values, ready for ``write_readings``."""
    d = batch_partition_values(corrected, prefix="data")
    return d.select(*[c for c in READING_COLUMNS if c in d.columns], "batch_end", "file_label",
                    "year", "month", "day")

"""Registered queries over sensor readings (O07, O09, O11-O21, O28, O29, O49 batch twin).

Each query takes (spark, sf_dir), reads the test tables through the adapters and runs
the library operators over the whole input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envlake.functions.boundary import next_boundary
from envlake.functions.compensation import cpu_temperature, dewpoint
from envlake.functions.dtypes import canonical_dtypes
from envlake.functions.gas import gas_resistance
from envlake.functions.station_id import canonical_station_id, split_station_ids, valid_station_id
from envlake.operators.assemble import assemble_reading
from envlake.operators.batching import (batch_assign_event_time, batch_partition_values,
                                        batch_stats, empty_batches, flushes_after_failure, health_partition_values)
from envlake.operators.asof import sessions_from_uptime
from envlake.operators.sequence import gap_sessions
from envlake.plans.collect import (BATCH_MINUTES, READING_COLUMNS, WARMUP_READINGS,
                                   corrected_readings, sequenced_readings)
from envlake.schema import PM_COLUMNS, SENSOR_FLOAT_COLUMNS
from envlake.sources import fixtures as fx


def q_assemble_reading(spark: SparkSession, sf: str) -> DataFrame:
    a = assemble_reading(fx.raw_readings(spark, sf))
    return a.select("station", "event_id", "timestamp", "bme_ok", "raw_temperature", "raw_humidity",
                    "pressure", "oxidised", "reducing", "nh3", "lux", "proximity", *PM_COLUMNS)


def q_gas_resistance(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.raw_readings(spark, sf)
    return r.select("event_id", "ox_v", "red_v", "nh3_v", gas_resistance("ox_v").alias("oxidised"),
                    gas_resistance("red_v").alias("reducing"), gas_resistance("nh3_v").alias("nh3"))


def q_cpu_temperature(spark: SparkSession, sf: str) -> DataFrame:
    h = fx.raw_health(spark, sf)
    return h.select("event_id", cpu_temperature("cpu_millideg", False).alias("cpu_temp_c"),
                    cpu_temperature("cpu_millideg", True).alias("cpu_temp_for_compensation"))


def _sequenced(spark, sf):
    return sequenced_readings(fx.raw_readings(spark, sf))


def q_rolling_cpu_avg(spark: SparkSession, sf: str) -> DataFrame:
    s = _sequenced(spark, sf)
    return s.select("station", "boot_id", "event_id", "bme_ok", F.col("seq_roll_mean").alias("cpu_avg"))


def q_compensate_temperature(spark: SparkSession, sf: str) -> DataFrame:
    s = _sequenced(spark, sf)
    return s.select("station", "event_id", "raw_temperature", "temperature")


def q_compensate_humidity(spark: SparkSession, sf: str) -> DataFrame:
    s = _sequenced(spark, sf)
    return s.select("station", "event_id", "raw_humidity", "temperature", "humidity")


def q_dewpoint(spark: SparkSession, sf: str) -> DataFrame:
    a = assemble_reading(fx.raw_readings(spark, sf))
    return a.select("event_id", dewpoint("raw_temperature", "rh_for_compensation").alias("dewpoint"))


def q_skip_warmup(spark: SparkSession, sf: str) -> DataFrame:
    c = corrected_readings(fx.raw_readings(spark, sf))
    return c.select("station", "boot_id", "event_id", "timestamp", "seq_rn")


def q_health_sample(spark: SparkSession, sf: str) -> DataFrame:
    c = corrected_readings(fx.raw_readings(spark, sf))
    return c.where("health_sample").select("station", "boot_id", "event_id", "seq_rn")


def q_canonical_dtypes(spark: SparkSession, sf: str) -> DataFrame:
    c = corrected_readings(fx.raw_readings(spark, sf))
    return canonical_dtypes(c.select("station", "event_id", "timestamp", *SENSOR_FLOAT_COLUMNS))


def q_valid_station_id(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.station_ids(spark, sf)
    return s.select("event_id", "raw_id", valid_station_id("raw_id").alias("valid"),
                    canonical_station_id("raw_id").alias("station_id"))


def q_station_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Rows split by their station id: valid ones with the canonical id, the others set aside."""
    valid, refused = split_station_ids(fx.station_ids(spark, sf).withColumn("station", F.col("raw_id")))
    return (valid.withColumn("quarantined", F.lit(False)).unionByName(refused.withColumn("quarantined", F.lit(True)))
            .select("event_id", "station", "quarantined"))


def q_next_boundary(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.raw_readings(spark, sf)
    return r.select("event_id", "timestamp", next_boundary("timestamp", 15).alias("nb_15"),
                    next_boundary("timestamp", 25).alias("nb_25"),
                    next_boundary("timestamp", 120).alias("nb_120"))


def q_boot_sessions(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.raw_readings(spark, sf).select("station", "event_id", "timestamp")
    return gap_sessions(r, keys=("station",), gap_minutes=90)


def q_batch_assign_event_time(spark: SparkSession, sf: str) -> DataFrame:
    c = corrected_readings(fx.raw_readings(spark, sf))
    return batch_assign_event_time(c.select("station", "event_id", "timestamp"), BATCH_MINUTES)


def q_batch_assign_as_collected(spark: SparkSession, sf: str) -> DataFrame:
    c = corrected_readings(fx.raw_readings(spark, sf))
    return c.select("station", "boot_id", "event_id", "timestamp", "batch_end")


def q_batch_partition_values(spark: SparkSession, sf: str) -> DataFrame:
    c = corrected_readings(fx.raw_readings(spark, sf))
    b = batch_partition_values(c, prefix="data")
    return b.select("station", "boot_id", "batch_end", "year", "month", "day", "file_label").distinct()


def q_batch_partition_values_health(spark: SparkSession, sf: str) -> DataFrame:
    """Day and label of each batch's health records; the label is that of the closing reading."""
    c = corrected_readings(fx.raw_readings(spark, sf)).select("station", "boot_id", "batch_end", "timestamp", "health_sample")
    h = health_partition_values(c.where("health_sample"), c)
    return h.select("station", "boot_id", "batch_end", "year", "month", "day", "file_label").distinct()


def q_uncompensated_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Kept readings with the correction turned off: temperature and humidity as read."""
    c = corrected_readings(fx.raw_readings(spark, sf), compensation=False)
    return c.select("station", "boot_id", "event_id", "timestamp", "temperature", "humidity", "batch_end")


def q_batch_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = corrected_readings(fx.raw_readings(spark, sf))
    return batch_stats(c)


def failed_flushes(corrected: DataFrame) -> DataFrame:
    """Adapter: of the batches there are, those whose flush failed, in runs of up to three."""
    n = F.floor(F.unix_micros("batch_end") / 900_000_000) + F.col("boot_id")
    return corrected.select("station", "boot_id", "batch_end").distinct().where(n % 5 < 3)


def q_batch_retry_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the batches as written, where a failed flush goes with the next that succeeds."""
    c = corrected_readings(fx.raw_readings(spark, sf)).select("station", "boot_id", "timestamp", "batch_end")
    return batch_stats(flushes_after_failure(c, failed_flushes(c)), keys=("station", "boot_id", "flush_end"))


def q_boot_sessions_uptime(spark: SparkSession, sf: str) -> DataFrame:
    """Boots recovered from the uptime in the health records, without boot ids or gaps."""
    r = fx.raw_readings(spark, sf).select("station", "event_id", "timestamp")
    return sessions_from_uptime(r, fx.raw_health(spark, sf).drop("boot_id"))


def q_empty_batches(spark: SparkSession, sf: str) -> DataFrame:
    c = corrected_readings(fx.raw_readings(spark, sf))
    return empty_batches(c.select("station", "timestamp"), BATCH_MINUTES)


def replayed_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Kept readings plus a re-written copy of every third boot's batches, the duplicates
    an at-least-once flush leaves behind."""
    c = corrected_readings(fx.raw_readings(spark, sf)).select(*READING_COLUMNS)
    return c.unionByName(c.where(F.col("boot_id") % 3 == 0))


def q_dedupe_readings(spark: SparkSession, sf: str) -> DataFrame:
    from envlake.operators.dedupe import dedupe_readings
    return dedupe_readings(replayed_readings(spark, sf))


QUERIES = {
    "assemble_reading": q_assemble_reading,
    "gas_resistance": q_gas_resistance,
    "cpu_temperature": q_cpu_temperature,
    "compensate_temperature": q_compensate_temperature,
    "compensate_humidity": q_compensate_humidity,
    "dewpoint": q_dewpoint,
    "canonical_dtypes": q_canonical_dtypes,
    "valid_station_id": q_valid_station_id,
    "station_quarantine": q_station_quarantine,
    "next_boundary": q_next_boundary,
    "rolling_cpu_avg": q_rolling_cpu_avg,
    "skip_warmup": q_skip_warmup,
    "health_sample": q_health_sample,
    "boot_sessions": q_boot_sessions,
    "batch_assign_event_time": q_batch_assign_event_time,
    "batch_assign_as_collected": q_batch_assign_as_collected,
    "batch_partition_values": q_batch_partition_values,
    "batch_partition_values_health": q_batch_partition_values_health,
    "uncompensated_readings": q_uncompensated_readings,
    "batch_stats": q_batch_stats,
    "batch_retry_stats": q_batch_retry_stats,
    "boot_sessions_uptime": q_boot_sessions_uptime,
    "empty_batches": q_empty_batches,
    "dedupe_readings": q_dedupe_readings,
}

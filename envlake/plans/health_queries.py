"""Registered health queries (O10 health side, O31, O36-O45)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envlake.functions import health as H
from envlake.operators.health import metric_availability, normalize_health, power_status
from envlake.sources import fixtures as fx


def _raw(spark, sf):
    return fx.raw_health(spark, sf)


def q_health_memory(spark: SparkSession, sf: str) -> DataFrame:
    m = H.memory("mem_total_kb", "mem_available_kb")
    return _raw(spark, sf).select("station", "event_id", *[v.alias(k) for k, v in m.items()])


def q_health_disk(spark: SparkSession, sf: str) -> DataFrame:
    d = H.disk("disk_total_b", "disk_free_b")
    return _raw(spark, sf).select("station", "event_id", *[v.alias(k) for k, v in d.items()])


def q_health_wifi(spark: SparkSession, sf: str) -> DataFrame:
    r = _raw(spark, sf).withColumns(H.wifi_levels("wifi_quality_s", "wifi_level_s"))
    w = H.wifi_from_levels("wifi_q", "wifi_level")
    return r.select("station", "event_id", H.wifi_ssid("iwgetid_s").alias("wifi_ssid"),
                    *[v.alias(k) for k, v in w.items()], H.ip_address("hostname_s").alias("ip_address"))


def _packet():
    return H.ntp_packet_offset_ms("ntp_orig_i", "ntp_orig_f", "ntp_recv_i", "ntp_recv_f",
                                  "ntp_tx_i", "ntp_tx_f", "ntp_dest")


def q_health_ntp_packet(spark: SparkSession, sf: str) -> DataFrame:
    return _raw(spark, sf).select("station", "event_id", _packet().alias("ntp_packet_ms"))


def q_health_ntp_offset(spark: SparkSession, sf: str) -> DataFrame:
    return _raw(spark, sf).select("station", "event_id", H.ntp_offset_ms(
        "timesync_s", "chrony_s", "ntpq_s", _packet()).alias("ntp_offset_ms"))


def q_health_clock_synced(spark: SparkSession, sf: str) -> DataFrame:
    return _raw(spark, sf).select("station", "event_id",
                                  H.clock_synced("timesync_s", "ntpsync_s").alias("clock_synced"))


def q_health_power(spark: SparkSession, sf: str) -> DataFrame:
    return power_status(fx.raw_power(spark, sf))


def q_health_throttled(spark: SparkSession, sf: str) -> DataFrame:
    h = _raw(spark, sf).select("station", "event_id", H.throttled_hex("throttled_s").alias("throttled_hex"))
    return h.select("station", "event_id", "throttled_hex", H.under_voltage("throttled_hex").alias("under_voltage"))


def q_health_voltage(spark: SparkSession, sf: str) -> DataFrame:
    return _raw(spark, sf).select("station", "event_id", H.core_voltage("volt_s").alias("cpu_voltage_v"),
                                  H.throttled_hex("throttled_s").alias("throttled_hex"))


def normalized_health(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_health(_raw(spark, sf), power_status(fx.raw_power(spark, sf)))


def q_normalize_health(spark: SparkSession, sf: str) -> DataFrame:
    return normalized_health(spark, sf)


def q_metric_availability(spark: SparkSession, sf: str) -> DataFrame:
    return metric_availability(normalized_health(spark, sf))


QUERIES = {
    "health_memory": q_health_memory,
    "health_disk": q_health_disk,
    "health_wifi": q_health_wifi,
    "health_ntp_packet": q_health_ntp_packet,
    "health_ntp_offset": q_health_ntp_offset,
    "health_clock_synced": q_health_clock_synced,
    "health_power": q_health_power,
    "health_throttled": q_health_throttled,
    "health_voltage": q_health_voltage,
    "normalize_health": q_normalize_health,
    "metric_availability": q_metric_availability,
}

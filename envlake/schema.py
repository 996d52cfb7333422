"""Schemas of the sensor lake and the health lake."""

from __future__ import annotations

from pyspark.sql import types as T

# Measurement columns of a sensor reading, in the reference's order.
SENSOR_FLOAT_COLUMNS = [
    "temperature", "raw_temperature", "pressure", "humidity", "raw_humidity",
    "oxidised", "reducing", "nh3", "lux", "proximity",
    "pm1", "pm25", "pm10",
    "particles_03um", "particles_05um", "particles_10um",
    "particles_25um", "particles_50um", "particles_100um",
]

PM_COLUMNS = ["pm1", "pm25", "pm10", "particles_03um", "particles_05um", "particles_10um",
              "particles_25um", "particles_50um", "particles_100um"]

# Schema of one sensor lake file (station lives only in the path).
SENSOR_FILE_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(c, T.FloatType()) for c in SENSOR_FLOAT_COLUMNS]
)

# Hive partition columns, always passed explicitly: a numeric station directory must
# stay a string, and month/day read back as integers.
PARTITION_SCHEMA = T.StructType([
    T.StructField("station", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
])

SENSOR_LAKE_SCHEMA = T.StructType(SENSOR_FILE_SCHEMA.fields + PARTITION_SCHEMA.fields)

# Health record columns and types, in the reference's serialisation order.
HEALTH_COLUMNS = [
    ("timestamp", T.TimestampType()),
    ("cpu_temp_c", T.DoubleType()),
    ("cpu_load_1min", T.DoubleType()),
    ("cpu_load_5min", T.DoubleType()),
    ("cpu_load_15min", T.DoubleType()),
    ("memory_total_mb", T.DoubleType()),
    ("memory_available_mb", T.DoubleType()),
    ("memory_percent_used", T.DoubleType()),
    ("disk_total_gb", T.DoubleType()),
    ("disk_free_gb", T.DoubleType()),
    ("disk_percent_used", T.DoubleType()),
    ("wifi_ssid", T.StringType()),
    ("wifi_signal_dbm", T.LongType()),
    ("wifi_quality_percent", T.DoubleType()),
    ("ip_address", T.StringType()),
    ("clock_synced", T.BooleanType()),
    ("ntp_offset_ms", T.DoubleType()),
    ("uptime_seconds", T.DoubleType()),
    ("power_source", T.StringType()),
    ("battery_percent", T.DoubleType()),
    ("cpu_voltage_v", T.DoubleType()),
    ("throttled_hex", T.StringType()),
]

HEALTH_FILE_SCHEMA = T.StructType([T.StructField(n, t) for n, t in HEALTH_COLUMNS])
HEALTH_LAKE_SCHEMA = T.StructType(HEALTH_FILE_SCHEMA.fields + PARTITION_SCHEMA.fields)
HEALTH_METRICS = [n for n, _ in HEALTH_COLUMNS if n != "timestamp"]

# Remote object manifest (what an object-store listing returns).
MANIFEST_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("last_modified", T.TimestampType()),
    T.StructField("e_tag", T.StringType()),
])

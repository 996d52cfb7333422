"""Lake round trips (O01-O04) and the documented lake queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envlake.plans.lake_build import health_lake, readings_lake
from envlake.schema import HEALTH_COLUMNS, SENSOR_FLOAT_COLUMNS
from envlake.session import ship_package, work_dir
from envlake.sources.files import _fs, _join, _own_name
from envlake.sources.health_lake import scan_health
from envlake.sources.lake import PARTITION_COLUMNS, scan_readings

# Parameters of the documented single-station, single-day query.
TIME_RANGE_STATION = "st-03"
TIME_RANGE_DAY = (2024, 1, 15)
MONTH = (2024, 1)


def _readings(spark, sf):
    return scan_readings(spark, readings_lake(spark, sf))


def _health(spark, sf):
    return scan_health(spark, health_lake(spark, sf))


def q_scan_readings(spark: SparkSession, sf: str) -> DataFrame:
    return _readings(spark, sf).select("station", "year", "month", "day", "timestamp", *SENSOR_FLOAT_COLUMNS)


def q_write_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per lake partition after the write (batch-level days)."""
    return _readings(spark, sf).groupBy("station", "year", "month", "day").agg(
        F.count(F.lit(1)).alias("n_rows"))


def q_scan_health(spark: SparkSession, sf: str) -> DataFrame:
    return _health(spark, sf)


def _drifting(root: str):
    """Writes a station's day of health records as a collector without a fixed schema does: on two of
    three days all-NULL columns are Null-typed, on one of these whole-number doubles are INT64."""
    def write(t):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        fs, base = _fs(root)
        station, y, m, d = (t.column(c)[0].as_py() for c in PARTITION_COLUMNS)
        out = {}
        for name, _ in HEALTH_COLUMNS:
            c = t.column(name)
            if d % 3 and c.null_count == len(c):
                c = pa.nulls(len(c))
            elif d % 3 == 1 and pa.types.is_float64(c.type) and pc.all(pc.and_(pc.is_finite(c), pc.equal(c, pc.floor(c)))).as_py():
                c = c.cast(pa.int64())
            out[name] = c
        path = f"station={station}/year={y:04d}/month={m:02d}/day={d:02d}/health_0000.parquet"
        fs.create_dir(_join(base, path).rpartition("/")[0], recursive=True)
        own = _own_name(_join(base, path))
        pq.write_table(pa.table(out), own, filesystem=fs)
        fs.move(own, _join(base, path))
        return pa.table({"path": [path]})
    return write


def q_scan_health_drift(spark: SparkSession, sf: str) -> DataFrame:
    """The health lake's rows, written as files whose types drift, then scanned."""
    root = work_dir(spark, "drift") + "/output-health"
    ship_package(spark)
    (_health(spark, sf).groupBy(*PARTITION_COLUMNS).applyInArrow(_drifting(root), "path string")
     .write.format("noop").mode("overwrite").save())
    return scan_health(spark, root)


def q_write_health(spark: SparkSession, sf: str) -> DataFrame:
    return _health(spark, sf).groupBy("station", "year", "month", "day").agg(F.count(F.lit(1)).alias("n_rows"))


def time_range(readings: DataFrame, station: str, y: int, m: int, d: int) -> DataFrame:
    """Documented query: one station's day, pruned to one partition directory."""
    return (readings.where((F.col("year") == y) & (F.col("month") == m) & (F.col("day") == d)
                           & (F.col("station") == station))
            .select("timestamp", "temperature", "humidity", "pm25"))


def hourly_station_avg(readings: DataFrame, y: int, m: int) -> DataFrame:
    """Documented query: hourly means per station for one month, ordered by hour."""
    return (readings.where((F.col("year") == y) & (F.col("month") == m))
            .groupBy("station", F.date_trunc("hour", "timestamp").alias("hour"))
            .agg(F.avg("temperature").alias("avg_temp"),
                 F.avg("humidity").alias("avg_humidity"),
                 F.avg("pm25").alias("avg_pm25"))
            .orderBy("hour", "station"))


def clock_drift_alerts(health: DataFrame) -> DataFrame:
    """Documented query: records not clock-synced or more than 100 ms off, newest first.
    SQL three-valued logic: NULL synced with offset > 100 is kept, otherwise dropped."""
    return (health.where(~F.col("clock_synced") | (F.col("ntp_offset_ms") > 100))
            .select("station", "timestamp", "clock_synced", "ntp_offset_ms", "wifi_signal_dbm")
            .orderBy(F.col("timestamp").desc()))


def memory_pressure(health: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Documented query: hourly mean/max memory use per station where the mean > 80 %."""
    return (health.groupBy("station", F.date_trunc("hour", "timestamp").alias("hour"))
            .agg(F.avg("memory_percent_used").alias("avg_mem"),
                 F.max("memory_percent_used").alias("max_mem"))
            .where(F.col("avg_mem") > threshold))


def rounded(df: DataFrame) -> DataFrame:
    """``avg_*`` columns to six decimals: a double mean's last bits depend on the order of its sums."""
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.startswith("avg_")})


def q_time_range(spark: SparkSession, sf: str) -> DataFrame:
    """Lists only the one partition directory (not the whole lake), then filters as the
    documented query does."""
    y, m, d = TIME_RANGE_DAY
    lake = scan_readings(spark, readings_lake(spark, sf), stations=[TIME_RANGE_STATION], dates=[(y, m, d)])
    return time_range(lake, TIME_RANGE_STATION, y, m, d)


def q_hourly_station_avg(spark: SparkSession, sf: str) -> DataFrame:
    """Lists only the month's directories, then filters as the documented query does."""
    lake = scan_readings(spark, readings_lake(spark, sf), dates=[MONTH])
    return rounded(hourly_station_avg(lake, *MONTH))


def q_clock_drift_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return clock_drift_alerts(_health(spark, sf))


def q_memory_pressure(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(memory_pressure(_health(spark, sf)))


QUERIES = {
    "scan_readings": q_scan_readings,
    "write_readings": q_write_readings,
    "scan_health": q_scan_health,
    "scan_health_drift": q_scan_health_drift,
    "write_health": q_write_health,
    "q_time_range": q_time_range,
    "q_hourly_station_avg": q_hourly_station_avg,
    "q_clock_drift_alerts": q_clock_drift_alerts,
    "q_memory_pressure": q_memory_pressure,
}

"""Registered streaming queries (O06, O46-O50). Each lands test-table rows as files,
runs the streaming plan to completion with an ``availableNow`` trigger into a file sink,
and returns the sink read back as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envlake.plans.collect import corrected_readings
from envlake.plans.readings_queries import replayed_readings
from envlake.schema import SENSOR_FLOAT_COLUMNS
from envlake.session import work_dir
from envlake.sources import fixtures as fx
from envlake.sources.lake import scan_readings
from envlake.plans.lake_queries import rounded
from envlake.streaming.aggregates import dedupe_to_table, read_deduped, read_windows, windows_to_table
from envlake.streaming.ingest import (RAW_READING_SCHEMA, final_flush, flush_batches_to_lake, flush_to_lake,
                                     land, stream_readings)
from envlake.streaming.stateful import OUTPUT_SCHEMA, stream_compensate


def _sink(stream: DataFrame, spark: SparkSession, name: str) -> str:
    base = work_dir(spark, f"stream-{name}")
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{base}/out"


def _raw_landing(spark: SparkSession, sf: str) -> str:
    landing = work_dir(spark, "landing-raw")
    land(fx.raw_readings(spark, sf).select(*RAW_READING_SCHEMA.names), landing)
    return landing


#: Parts or files that the streams below land, and how many of the files a trigger takes: several triggers each.
FILES, FILES_A_TRIGGER = 6, 2


def _in_time(rows: DataFrame, parts: int = FILES) -> list[DataFrame]:
    """Parts that follow each other in time, as a fleet's readings do."""
    us = F.unix_micros("timestamp")
    cuts = rows.agg(F.percentile_approx(us, [k / parts for k in range(1, parts)])).first()[0] or []
    later = [rows if low is None else rows.where(us > low) for low in [None, *cuts]]
    return [part if high is None else part.where(us <= high) for part, high in zip(later, [*cuts, None])]


def q_stream_readings(spark: SparkSession, sf: str) -> DataFrame:
    out = _sink(stream_readings(spark, _raw_landing(spark, sf), max_files_per_trigger=2), spark, "raw")
    return spark.read.schema(RAW_READING_SCHEMA).parquet(out)


def q_stream_compensate(spark: SparkSession, sf: str) -> DataFrame:
    s = stream_compensate(stream_readings(spark, _raw_landing(spark, sf)))
    out = _sink(s, spark, "compensate")
    return spark.read.schema(OUTPUT_SCHEMA).parquet(out).drop("health_sample", "batch_first")


def q_stream_flush(spark: SparkSession, sf: str) -> DataFrame:
    base = work_dir(spark, "stream-flush")
    s = stream_compensate(stream_readings(spark, _raw_landing(spark, sf)))
    flush_to_lake(s, f"{base}/lake", f"{base}/ckpt").awaitTermination()
    return scan_readings(spark, f"{base}/lake").select("station", "year", "month", "day", "timestamp",
                                                       *SENSOR_FLOAT_COLUMNS)


def q_stream_flush_batch_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Stream flush in the reference's batch layout (first reading's day per batch), over several triggers
    that cut collector batches: each part is drained before the next one lands, in as many files as tasks write."""
    base = work_dir(spark, "stream-flush-batch")
    landing = f"{base}/landing"
    for part in _in_time(fx.raw_readings(spark, sf).select(*RAW_READING_SCHEMA.names)):
        land(part, landing)
        s = stream_compensate(stream_readings(spark, landing, max_files_per_trigger=None))
        flush_batches_to_lake(s, f"{base}/lake", f"{base}/ckpt").awaitTermination()
    return scan_readings(spark, f"{base}/lake").select("station", "year", "month", "day", "timestamp",
                                                       *SENSOR_FLOAT_COLUMNS)


def q_stream_final_flush(spark: SparkSession, sf: str) -> DataFrame:
    """A running 15-minute flush is interrupted after some readings have landed; the final flush drains
    the rest (readings that landed later) and replicates the lake, whose copy is read."""
    base = work_dir(spark, "stream-final")
    landing = f"{base}/landing"
    raw = fx.raw_readings(spark, sf).select(*RAW_READING_SCHEMA.names)
    half = F.col("boot_id") % 2 == 0
    land(raw.where(half), landing)
    stream = stream_compensate(stream_readings(spark, landing))
    # A short trigger stands in for the 15-minute cadence so the check finishes quickly.
    q = flush_to_lake(stream, f"{base}/lake", f"{base}/ckpt", processing_time="2 seconds")
    q.processAllAvailable()
    land(raw.where(~half), landing)
    final_flush(q, stream, f"{base}/lake", f"{base}/ckpt", sync_to=f"{base}/remote")
    return scan_readings(spark, f"{base}/remote").select("station", "year", "month", "day", "timestamp",
                                                         *SENSOR_FLOAT_COLUMNS)


def _corrected_stream(spark: SparkSession, sf: str) -> DataFrame:
    c = corrected_readings(fx.raw_readings(spark, sf)).select("station", "timestamp", *SENSOR_FLOAT_COLUMNS)
    landing = work_dir(spark, "landing-corrected")
    land(c, landing, FILES)  # files of mixed times, so that rows are late in most triggers
    return stream_readings(spark, landing, c.schema, max_files_per_trigger=FILES_A_TRIGGER)


def q_stream_hourly_avg(spark: SparkSession, sf: str) -> DataFrame:
    base = work_dir(spark, "stream-hourly")
    windows_to_table(_corrected_stream(spark, sf), f"{base}/out", f"{base}/ckpt", 60).awaitTermination()
    found = rounded(read_windows(spark, f"{base}/out")).withColumn("hour", F.col("window_end") - F.expr("INTERVAL 1 HOUR"))
    return found.select("station", "hour", F.col("avg_temperature").alias("avg_temp"), "avg_humidity", "avg_pm25", "n_readings")


def q_stream_batch_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of 15-minute event-time batches over several triggers with late rows."""
    base = work_dir(spark, "stream-counts")
    windows_to_table(_corrected_stream(spark, sf), f"{base}/out", f"{base}/ckpt", 15, values=()).awaitTermination()
    return read_windows(spark, f"{base}/out", values=()).withColumnRenamed("window_end", "batch_end")


def q_stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Readings written again, some of them in later triggers, once each."""
    base = work_dir(spark, "stream-dedupe")
    rep = replayed_readings(spark, sf)
    land(rep, f"{base}/in", FILES)
    stream = stream_readings(spark, f"{base}/in", rep.schema, max_files_per_trigger=FILES_A_TRIGGER)
    dedupe_to_table(stream, f"{base}/out", f"{base}/ckpt").awaitTermination()
    return read_deduped(spark, f"{base}/out", rep.schema)


QUERIES = {
    "stream_readings": q_stream_readings,
    "stream_compensate": q_stream_compensate,
    "stream_flush": q_stream_flush,
    "stream_final_flush": q_stream_final_flush,
    "stream_flush_batch_layout": q_stream_flush_batch_layout,
    "stream_hourly_avg": q_stream_hourly_avg,
    "stream_batch_counts": q_stream_batch_counts,
    "stream_dedupe": q_stream_dedupe,
}

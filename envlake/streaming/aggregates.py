"""Streaming windowed counts and averages, and de-duplication without a time bound.

Stations are offline-first and may come back after weeks, so nothing here rests on a watermark: a
micro-batch is reduced to partial sums, or held against what the touched days already have, and written
to a folder of its own (query and batch id), which a repeated delivery replaces. Spark keeps no state
between triggers, so there is none to bound and none to lose.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from envlake.functions.boundary import next_boundary
from envlake.session import materialise, scoped_conf
from envlake.sources.files import path_exists
from envlake.sources.lake import FLUSH_COLUMN, PARTITION_COLUMNS
from envlake.streaming.ingest import day_of_row, flush_name

HOURLY_VALUES = ("temperature", "humidity", "pm25")


def window_sums(rows: DataFrame, minutes: int, values: Sequence[str] = HOURLY_VALUES) -> DataFrame:
    """Per station and clock window (``window_end``): rows, first and last time, and each value's sum and count."""
    sums = [f(F.col(v).cast("double")).alias(f"{n}_{v}") for v in values for n, f in (("sum", F.sum), ("n", F.count))]
    return rows.groupBy("station", next_boundary("timestamp", minutes).alias("window_end")).agg(
        F.count(F.lit(1)).alias("n_readings"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), *sums)


def windows_to_table(readings: DataFrame, out: str, checkpoint: str, minutes: int,
                     values: Sequence[str] = HOURLY_VALUES, processing_time: str | None = None) -> StreamingQuery:
    """Add a stream's :func:`window_sums` to the table ``out``. Late rows are a few more partial sums.
    Queries of other checkpoints may add to the same table. Read with :func:`read_windows`."""
    def write(df: DataFrame, batch_id: int) -> None:
        folder = f"{out.rstrip('/')}/{FLUSH_COLUMN}={flush_name(df.sparkSession, batch_id)}"
        with scoped_conf(df.sparkSession, "spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS"):
            window_sums(df, minutes, values).write.mode("overwrite").parquet(folder)
    w = readings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)).start()


def read_windows(spark: SparkSession, out: str, values: Sequence[str] = HOURLY_VALUES, closed_after: str | None = None) -> DataFrame:
    """``(station, window_end, n_readings, first_ts, last_ts, readings_per_s, avg_...)``: the partial sums of all
    micro-batches, added up. With ``closed_after`` (such as ``'2 hours'``) only windows that ended so long before the
    newest reading; a row that comes later still counts in the next read."""
    parts = spark.read.parquet(out)
    total = parts.groupBy("station", "window_end").agg(
        F.sum("n_readings").alias("n_readings"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        *[F.sum(f"{n}_{v}").alias(f"{n}_{v}") for v in values for n in ("sum", "n")])
    if closed_after:
        newest = parts.agg(F.max("last_ts").alias("newest")).first()["newest"]
        total = total.where(F.col("window_end") <= F.lit(newest) - F.expr(f"INTERVAL {closed_after}"))
    span = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6
    return total.select("station", "window_end", "n_readings", "first_ts", "last_ts",
                        F.when(span > 0, F.col("n_readings") / F.nullif(span, F.lit(0.0))).otherwise(F.lit(0.0)).alias("readings_per_s"),
                        *[(F.col(f"sum_{v}") / F.nullif(F.col(f"n_{v}"), F.lit(0))).alias(f"avg_{v}") for v in values])


def unseen(rows: DataFrame, have: DataFrame | None, flush: str, keys: Sequence[str] = ("station", "timestamp")) -> DataFrame:
    """One row for each key of a micro-batch that the table doesn't have, however old it is.

    ``have`` has the partition columns and ``flush``; what the same flush wrote in an earlier attempt doesn't
    count. The touched days are written first: while they are few, Spark prunes the table to them
    (dynamic partition pruning); if they are many the join reads it all, with the same result.
    """
    own = materialise(rows.dropDuplicates(list(keys)), "unseen")
    if have is None:
        return own
    days = materialise(own.select(*[F.col(c).cast(have.schema[c].dataType).alias(c) for c in PARTITION_COLUMNS]).distinct(), "days")
    others = have.where(F.col(FLUSH_COLUMN) != flush)
    no_day = F.col("station").isNull() | F.col("year").isNull()  # folders that a join by equality doesn't meet
    old = others.join(days, PARTITION_COLUMNS, "left_semi").unionByName(others.where(no_day).select(*others.columns))
    seen = old.select(F.struct(*[F.col(k).cast(own.schema[k].dataType).alias(k) for k in keys]).alias("_key"))
    return own.withColumn("_key", F.struct(*keys)).join(seen, "_key", "left_anti").drop("_key")


def dedupe_to_table(readings: DataFrame, root: str, checkpoint: str, keys: Sequence[str] = ("station", "timestamp"),
                    processing_time: str | None = None) -> StreamingQuery:
    """Write a stream's readings, each (station, timestamp) once, to a table partitioned as the lake, without
    a bound on how late a copy may come. One query at a time may write to a table. Read with :func:`read_deduped`."""
    columns = readings.columns

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        name = flush_name(spark, batch_id)
        rows = day_of_row(df)
        have = None
        if path_exists(spark, root):
            have = spark.read.schema(_stored(rows)).parquet(root)
        fresh = unseen(rows, have, name, keys).withColumn(FLUSH_COLUMN, F.lit(name))
        with scoped_conf(spark, "spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS"):
            fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                *PARTITION_COLUMNS, FLUSH_COLUMN).parquet(root)
    if set(columns) & {*PARTITION_COLUMNS[1:], FLUSH_COLUMN}:
        raise ValueError("the stream has a column that the table's layout needs")
    w = readings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)).start()


def _stored(rows: DataFrame):
    from pyspark.sql import types as T
    return T.StructType([f for f in rows.schema.fields if f.name not in PARTITION_COLUMNS]
                        + [T.StructField(c, T.StringType()) for c in (*PARTITION_COLUMNS, FLUSH_COLUMN)])


def read_deduped(spark: SparkSession, root: str, schema) -> DataFrame:
    """The table of :func:`dedupe_to_table` with the stream's columns."""
    return spark.read.schema(schema).parquet(root).select(*schema.names)


def stream_dedupe(readings: DataFrame, watermark: str) -> DataFrame:
    """One row per (station, timestamp) within a watermark, for sinks that can't be read back. What comes later
    than the watermark is dropped; :func:`dedupe_to_table` has no such bound."""
    return (readings.withWatermark("timestamp", watermark)
            .dropDuplicatesWithinWatermark(["station", "timestamp"]))

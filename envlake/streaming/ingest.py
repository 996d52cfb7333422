"""Streaming ingest and lake flush.

Every flush runs through ``foreachBatch`` and writes to folders named by the query and the micro-batch
(innermost partition ``flush``), replacing what is there: a micro-batch that is delivered again, after
any failure, replaces itself, two queries never meet, and batch jobs may write to the same lake.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from envlake.session import scoped_conf
from envlake.sources.lake import write_readings

# Raw reading rows as they land (the adapter schema of FIXTURES F1).
RAW_READING_SCHEMA = T.StructType(
    [T.StructField("station", T.StringType()), T.StructField("boot_id", T.LongType()),
     T.StructField("event_id", T.LongType()), T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in (
        "raw_temperature", "raw_humidity", "pressure", "cpu_temp_c", "ox_v", "red_v", "nh3_v", "lux",
        "proximity", "pm1", "pm25", "pm10", "particles_03um", "particles_05um", "particles_10um",
        "particles_25um", "particles_50um", "particles_100um")])


def land(df: DataFrame, landing: str, files: int | None = None) -> None:
    """Write rows as Parquet files into a landing folder (append), as a feeder would, with the
    partitions the rows have (or so many files).
    Timestamps keep microseconds here; only the lake stores milliseconds."""
    with scoped_conf(df.sparkSession, "spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS"):
        (df.repartition(files) if files else df).write.mode("append").parquet(landing)


def stream_readings(spark: SparkSession, landing: str, schema: T.StructType = RAW_READING_SCHEMA,
                    max_files_per_trigger: int | None = 1000, max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Continuous ingest from a landing folder with an explicit schema. Micro-batches are bounded by
    files or, which bounds memory whatever the files' sizes, by bytes (one of the two)."""
    r = spark.readStream.schema(schema)
    if max_bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", max_bytes_per_trigger)
    elif max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(landing)


def _trigger(w, processing_time: str | None):
    return w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)


def flush_name(spark: SparkSession, batch_id: int, query: str | None = None) -> str:
    """The name of a micro-batch: the query's id, which its checkpoint keeps, and the batch id."""
    query = query or spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not query:
        raise RuntimeError("outside a streaming query: name the query")
    return f"{query}-{batch_id}"


def day_of_row(df: DataFrame) -> DataFrame:
    """Partition values from each row's own day."""
    ts = F.col("timestamp")
    return df.withColumns({"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"), "day": F.date_format(ts, "dd")})


def day_of_batch(df: DataFrame) -> DataFrame:
    """Partition values from the first reading of the row's collector batch, which the stateful correction
    carries from trigger to trigger as ``batch_first``."""
    first = F.col("batch_first")
    return df.withColumns({"year": F.date_format(first, "yyyy"), "month": F.date_format(first, "MM"), "day": F.date_format(first, "dd")})


def lake_writer(root: str, day, compression: str = "zstd", quarantine: str | None = None, dedupe: bool = False,
                query: str | None = None):
    """The ``foreachBatch`` function of the flushes: writes one micro-batch in place of what an earlier
    attempt wrote. ``dedupe`` leaves out readings the lake has (:func:`envlake.streaming.aggregates.unseen`)."""
    def write(df: DataFrame, batch_id: int) -> None:
        name = flush_name(df.sparkSession, batch_id, query)
        rows = day(df)
        if dedupe:
            from envlake.sources.lake import scan_flushes
            from envlake.sources.files import path_exists
            from envlake.streaming.aggregates import unseen
            rows = rows.withColumn("timestamp", F.date_trunc("millisecond", "timestamp"))  # as the lake stores it
            have = scan_flushes(df.sparkSession, root) if path_exists(df.sparkSession, root) else None
            rows = unseen(rows, have, name)
        # Spark turns adaptive plans off for a stateful query, whose state is fixed to its tasks. The rows come from
        # an RDD here, planned already; without adaptive plans every task would write a file for every station-day.
        with scoped_conf(df.sparkSession, "spark.sql.adaptive.enabled", "true"):
            write_readings(rows, root, compression=compression, mode="overwrite", quarantine=quarantine, flush=name)
    return write


def flush_to_lake(stream: DataFrame, root: str, checkpoint: str, processing_time: str | None = None,
                  compression: str = "zstd", quarantine: str | None = None, dedupe: bool = False) -> StreamingQuery:
    """Clock-aligned flush of a reading stream to the partitioned lake, each row under its own day (a
    collector batch that crosses midnight splits there). Use ``processing_time='15 minutes'`` for the
    reference cadence, or the default ``availableNow`` run that drains what has landed and stops.
    Invalid station ids go to ``quarantine``, if given; ``dedupe`` leaves out readings the lake has.
    """
    w = (stream.writeStream.foreachBatch(lake_writer(root, day_of_row, compression, quarantine, dedupe))
         .option("checkpointLocation", checkpoint))
    return _trigger(w, processing_time).start()


def flush_batches_to_lake(stream: DataFrame, root: str, checkpoint: str, processing_time: str | None = None,
                          compression: str = "zstd", quarantine: str | None = None, dedupe: bool = False) -> StreamingQuery:
    """Flush with the reference's exact layout: each collector batch (station, boot, ``batch_end``) is filed
    under its first reading's day, even across midnight and over any number of triggers. Needs
    ``batch_first`` from ``stream_compensate``.
    """
    w = (stream.writeStream.foreachBatch(lake_writer(root, day_of_batch, compression, quarantine, dedupe))
         .option("checkpointLocation", checkpoint))
    return _trigger(w, processing_time).start()


def final_flush(query: StreamingQuery | None, stream: DataFrame, root: str, checkpoint: str,
                sync_to: str | None = None, flush=flush_to_lake) -> StreamingQuery:
    """On shutdown: stop the running query and drain everything that has landed with an
    ``availableNow`` run on the same checkpoint and in the same layout (``flush``), wait for it, then
    replicate the readings lake and the health lake beside it to ``sync_to``, if given."""
    if query is not None and query.isActive:
        query.stop()
    q = flush(stream, root, checkpoint)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    if sync_to:
        from envlake.sources.replicate import sync_lakes
        sync_lakes(stream.sparkSession, root, sync_to)
    return q

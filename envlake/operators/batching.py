"""Batch assignment, batch-level partition values, batch statistics and empty batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envlake.functions.boundary import next_boundary
from envlake.session import materialise


def batch_assign_event_time(df: DataFrame, minutes: int, ts: str = "timestamp",
                            out: str = "batch_end") -> DataFrame:
    """Event-time batch: the next clock boundary after the reading's own timestamp."""
    return df.withColumn(out, next_boundary(ts, minutes))


def batch_assign_as_collected(seq: DataFrame, minutes: int, warmup: int = 10,
                              out: str = "batch_end") -> DataFrame:
    """The batch a reading was flushed in by the running collector.

    The flush test runs after the reading is appended, so the first reading at or after
    a boundary closes the earlier batch: the batch key is ``next_boundary(previous ts)``.
    The deadline is set when the collector starts (first reading) and does not move
    while the buffer is empty, i.e. during warm-up, so the first kept reading uses the
    group's first timestamp. Needs ``seq_rn``, ``seq_prev_ts``, ``seq_first_ts`` from
    :func:`envlake.operators.sequence.sequence_features`.
    """
    ref = F.when(F.col("seq_rn") <= warmup + 1, F.col("seq_first_ts")).otherwise(F.col("seq_prev_ts"))
    return seq.withColumn(out, next_boundary(ref, minutes))


def batch_partition_values(df: DataFrame, keys: Sequence[str] = ("station", "boot_id", "batch_end"),
                           ts: str = "timestamp", prefix: str = "data") -> DataFrame:
    """Per batch: ``year``/``month``/``day`` (zero-padded strings) from the batch's first
    row, so a batch across midnight stays in the earlier day, and the file label
    ``{prefix}_HHMM`` from the flush time (the batch's last reading).

    A window over one batch is bounded by the batch length, so no key can be hot.
    """
    w = Window.partitionBy(*keys)
    first_ts = F.min(ts).over(w)
    last_ts = F.max(ts).over(w)
    return df.withColumns({
        "year": F.date_format(first_ts, "yyyy"),
        "month": F.date_format(first_ts, "MM"),
        "day": F.date_format(first_ts, "dd"),
        "file_label": F.concat(F.lit(prefix + "_"), F.date_format(last_ts, "HHmm")),
    })


def health_partition_values(samples: DataFrame, readings: DataFrame, keys: Sequence[str] = ("station", "boot_id", "batch_end"),
                            ts: str = "timestamp") -> DataFrame:
    """Partition values of health records: the day of the batch's first health record, and the label
    ``health_HHMM`` of the flush, which the batch's last *reading* closes."""
    closed = readings.groupBy(F.struct(*keys).alias("_batch")).agg(F.max(ts).alias("_closed"))
    days = batch_partition_values(samples, keys, ts).drop("file_label").withColumn("_batch", F.struct(*keys))
    return (days.join(closed, "_batch", "left")
            .withColumn("file_label", F.concat(F.lit("health_"), F.date_format("_closed", "HHmm"))).drop("_batch", "_closed"))


def batch_stats(df: DataFrame, keys: Sequence[str] = ("station", "boot_id", "batch_end"),
                ts: str = "timestamp") -> DataFrame:
    """Row count, first/last timestamp and readings per second of the observed span."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_readings"),
                              F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    span = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6
    return g.withColumn("readings_per_s",
                        F.when(span > 0, F.col("n_readings") / F.nullif(span, F.lit(0.0)))
                        .otherwise(F.lit(0.0)))


def empty_batches(df: DataFrame, minutes: int, keys: Sequence[str] = ("station",),
                  ts: str = "timestamp") -> DataFrame:
    """Clock boundaries inside each station's span that no reading falls into.

    The grid restarts every hour (see ``next_boundary``), so it is built as hours x
    offsets rather than one fixed-step sequence. Hours are exploded first (one row per
    station-hour) and spread out before the offsets are added; the result is a left anti
    join against the boundaries that do have readings.
    """
    K = list(keys)
    # the (small) set of boundaries with readings is used twice: written so the input
    # plan runs once
    have = materialise(df.select(*K, next_boundary(ts, minutes).alias("batch_end")).distinct(), "boundaries")
    span = have.groupBy(*K).agg(F.min("batch_end").alias("_lo"), F.max("batch_end").alias("_hi"))
    if minutes < 1:
        raise ValueError("interval must be >= 1 minute")
    offsets = [k * minutes for k in range(60) if k * minutes < 60]
    hours = span.select(*K, "_lo", "_hi", F.explode(F.sequence(
        F.date_trunc("hour", "_lo"), F.date_trunc("hour", "_hi"), F.expr("INTERVAL 1 HOUR"))).alias("_h"))
    grid = (hours.repartition(*K, "_h")
            .select(*K, "_lo", "_hi", F.explode(F.array(*[
                F.col("_h") + F.make_dt_interval(mins=F.lit(o)) for o in offsets])).alias("batch_end"))
            .where((F.col("batch_end") >= F.col("_lo")) & (F.col("batch_end") <= F.col("_hi")))
            .select(*K, "batch_end"))
    met = have.select(F.struct(*K, "batch_end").alias("_key"))  # a struct matches NULL keys too
    return (grid.withColumn("_key", F.struct(*K, "batch_end")).join(met, on="_key", how="left_anti")
            .select(*K, "batch_end"))


def flushes_after_failure(df: DataFrame, failed: DataFrame, keys: Sequence[str] = ("station", "boot_id"), batch: str = "batch_end",
                          out: str = "flush_end", chunk_seconds: int = 7 * 86_400) -> DataFrame:
    """The batch a reading was written with when flushes fail: the collector keeps its buffer, so the rows of a
    failed batch go with the next one of the same group that succeeds. ``failed`` names the failed
    batches by ``(*keys, batch)``; ``out`` is NULL where none succeeded later (the rows are still buffered).

    Batches are looked at, not readings. The next success comes backwards over chunk edges: within a chunk by
    a window, across chunks from a table of each chunk's first success. Rows whose batch is NULL stay, with NULL.
    """
    K = F.struct(*keys)
    n = F.lit(chunk_seconds * 1_000_000)
    us = F.unix_micros(F.col(batch).cast("timestamp"))
    lost = failed.select(F.struct(*keys, batch).alias("_key")).distinct().withColumn("_lost", F.lit(True))
    batches = (df.where(F.col(batch).isNotNull()).select(*keys, batch).distinct().withColumn("_key", F.struct(*keys, batch))
               .join(lost, "_key", "left").select("_key", K.alias("_g"), F.col(batch).alias("_b"), (us - F.pmod(us, n)).alias("_chunk"),
                                                  F.when(F.col("_lost").isNull(), F.col(batch)).alias("_ok")))
    batches = materialise(batches, "flushes")  # used by the window and by the chunk table
    on = Window.partitionBy("_g", "_chunk").orderBy("_b").rowsBetween(0, Window.unboundedFollowing)
    later = Window.partitionBy("_g").orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    chunks = batches.groupBy("_g", "_chunk").agg(F.min("_ok").alias("_first")).withColumn("_next", F.min("_first").over(later))
    told = (batches.withColumn("_here", F.min("_ok").over(on)).join(chunks.select("_g", "_chunk", "_next"), ["_g", "_chunk"])
            .select("_key", F.coalesce("_here", "_next").alias(out)))
    return df.withColumn("_key", F.struct(*keys, batch)).join(told, "_key", "left").drop("_key")

"""Chunked sequence operators equal whole-group windows for any chunk size."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from envlake.operators.sequence import gap_sessions, sequence_features
from envlake.sources.fixtures import raw_readings


def _brute(df):
    w = Window.partitionBy("station", "boot_id").orderBy("timestamp", "event_id")
    wok = Window.partitionBy("station", "boot_id", "ok").orderBy("timestamp", "event_id")
    first = F.first("v").over(wok)
    lags = [F.coalesce(F.lag("v", k).over(wok), first) for k in (4, 3, 2, 1)]
    acc = ((((lags[0] + lags[1]) + lags[2]) + lags[3]) + F.col("v")) / 5
    return df.select("event_id", F.row_number().over(w).alias("rn"), F.lag("timestamp").over(w).alias("prev"),
                     F.when(F.col("ok"), acc).alias("mean"))


@pytest.mark.parametrize("chunk,block", [(60, 1), (60, 3), (3600, 2), (3600, 1024), (7 * 86400, 1024)])
def test_sequence_features_chunk_invariant(spark, sf, chunk, block):
    r = raw_readings(spark, sf).select("station", "boot_id", "event_id", "timestamp",
                                       F.coalesce("cpu_temp_c", F.lit(40.0)).alias("v"),
                                       F.col("raw_humidity").isNotNull().alias("ok"))
    got = sequence_features(r, value_col="v", ok_col="ok", chunk_seconds=chunk, block_chunks=block).select(
        "event_id", F.col("seq_rn").alias("rn"), F.col("seq_prev_ts").alias("prev"),
        F.col("seq_roll_mean").alias("mean"))
    exp = _brute(r)
    assert sorted(got.collect()) == sorted(exp.collect())


@pytest.mark.parametrize("chunk,block", [(60, 1), (60, 5), (600, 1024)])
def test_gap_sessions_small_chunks(spark, sf, chunk, block):
    r = raw_readings(spark, sf).select("station", "event_id", "timestamp")
    a = gap_sessions(r, gap_minutes=90, chunk_seconds=chunk, block_chunks=block).select("event_id", "session_id")
    b = gap_sessions(r, gap_minutes=90, chunk_seconds=30 * 86400).select("event_id", "session_id")
    assert sorted(a.collect()) == sorted(b.collect())


def test_prefilled_rolling_mean_first_rows(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    rows = [("s", 0, i, t0 + dt.timedelta(seconds=5 * i), float(v), True)
            for i, v in enumerate([50, 60, 70, 80, 90, 100, 110])]
    df = spark.createDataFrame(rows, "station string, boot_id long, event_id long, timestamp timestamp, "
                                     "v double, ok boolean")
    out = sequence_features(df, value_col="v", ok_col="ok", chunk_seconds=10)
    means = [r.seq_roll_mean for r in out.orderBy("event_id").collect()]
    # window pre-filled with five copies of the first value
    exp = [50.0, (50 * 4 + 60) / 5, (50 * 3 + 60 + 70) / 5, (50 * 2 + 60 + 70 + 80) / 5,
           (50 + 60 + 70 + 80 + 90) / 5, (60 + 70 + 80 + 90 + 100) / 5, (70 + 80 + 90 + 100 + 110) / 5]
    assert means == pytest.approx(exp)


def test_failed_bme_rows_do_not_advance_mean(spark):
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    vals = [(10.0, True), (99.0, False), (20.0, True)]
    rows = [("s", 0, i, t0 + dt.timedelta(seconds=5 * i), v, ok) for i, (v, ok) in enumerate(vals)]
    df = spark.createDataFrame(rows, "station string, boot_id long, event_id long, timestamp timestamp, "
                                     "v double, ok boolean")
    out = {r.event_id: r.seq_roll_mean for r in
           sequence_features(df, value_col="v", ok_col="ok").collect()}
    assert out[0] == 10.0 and out[1] is None and out[2] == pytest.approx((10 * 4 + 20) / 5)


def test_boundary_during_warmup_flushes_first_kept_reading_alone(spark):
    from envlake.operators.batching import batch_assign_as_collected
    t0 = dt.datetime(2024, 1, 1, 10, 40, 0)
    rows = [("s", 0, i, t0 + dt.timedelta(minutes=i)) for i in range(14)]  # 10:40 .. 10:53
    df = spark.createDataFrame(rows, "station string, boot_id long, event_id long, timestamp timestamp")
    out = batch_assign_as_collected(sequence_features(df), 15, warmup=10)
    got = {r.event_id: r.batch_end.strftime("%H:%M") for r in out.where("seq_rn > 10").collect()}
    # the 10:45 deadline passed during warm-up, so the first kept reading (10:50) is flushed
    # alone under it; the next deadline is then 11:00
    assert got == {10: "10:45", 11: "11:00", 12: "11:00", 13: "11:00"}

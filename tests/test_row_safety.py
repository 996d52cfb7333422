"""Rows that earlier versions lost: NULL keys, files that arrive later, batch ids of two checkpoints."""

import datetime as dt

from pyspark.sql import functions as F

from envlake.functions.health import wifi
from envlake.operators.batching import empty_batches
from envlake.operators.sequence import gap_sessions, sequence_features
from envlake.plans.collect import corrected_readings
from envlake.plans.lake_queries import hourly_station_avg
from envlake.session import work_dir
from envlake.sources.fixtures import raw_readings


def test_null_boot_is_a_group_like_any_other(spark, sf):
    raw = raw_readings(spark, sf)
    one = raw.where("boot_id = 0")
    want = corrected_readings(one).select("event_id", "temperature", "batch_end")
    got = corrected_readings(one.withColumn("boot_id", F.lit(None).cast("long"))).select("event_id", "temperature", "batch_end")
    assert want.count() > 0 and sorted(got.collect()) == sorted(want.collect())


def test_null_keys_and_times_keep_their_rows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(None, 1, t), (None, 2, t + dt.timedelta(hours=3)), ("a", 3, None), ("a", 4, t)]
    df = spark.createDataFrame(rows, "station string, event_id long, timestamp timestamp")
    got = {r["event_id"]: r["seq_rn"] for r in sequence_features(df, keys=("station",)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2}
    assert {r["event_id"]: r["session_id"] for r in gap_sessions(df, gap_minutes=90).collect()}.keys() == {1, 2, 3, 4}
    empty = empty_batches(df.where("timestamp IS NOT NULL"), 60).where("station IS NULL").count()
    assert empty == 2


def test_files_that_arrive_between_two_calls_count(spark, sf):
    raw, folder = raw_readings(spark, sf), work_dir(spark, "test-arrivals")
    raw.where("boot_id % 2 = 0").write.parquet(folder)
    first = corrected_readings(spark.read.schema(raw.schema).parquet(folder)).count()
    raw.where("boot_id % 2 = 1").write.mode("append").parquet(folder)
    second = corrected_readings(spark.read.schema(raw.schema).parquet(folder)).count()
    assert first < second == corrected_readings(raw).count()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0


def test_plain_averages(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, v, v, 1e-7 if v == 10 else 3e-7, 2024, 1) for v in (10.0, 20.0, float("nan"))]
    df = spark.createDataFrame(rows, "station string, timestamp timestamp, temperature double, humidity double, pm25 double, year int, month int")
    r = hourly_station_avg(df.where("NOT isnan(temperature)"), 2024, 1).first()
    assert r["avg_temp"] == 15.0 and abs(r["avg_pm25"] - 2e-7) < 1e-12
    assert hourly_station_avg(df, 2024, 1).where("isnan(avg_temp)").count() == 1


def test_infinite_level_loses_one_value_only(spark):
    df = spark.createDataFrame([("60", "inf."), ("60", "-50.")], "q string, l string")
    out = wifi("q", "l")
    got = [r[0] for r in df.select(out["wifi_signal_dbm"]).collect()]
    assert got == [None, -50]

"""Streams and batch jobs in one lake, collector batches over triggers, failed flushes, late stations."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from envlake.operators.asof import asof_join, sessions_from_uptime
from envlake.operators.batching import batch_partition_values, batch_stats, flushes_after_failure
from envlake.plans import stream_queries
from envlake.plans.collect import corrected_readings, lake_readings
from envlake.plans.readings_queries import failed_flushes
from envlake.schema import SENSOR_FLOAT_COLUMNS
from envlake.session import scoped_conf, work_dir
from envlake.sources.files import list_files
from envlake.sources.fixtures import raw_health, raw_readings
from envlake.sources.lake import scan_flushes, scan_readings, write_readings
from envlake.streaming.aggregates import dedupe_to_table, read_deduped, read_windows, windows_to_table
from envlake.streaming.ingest import (RAW_READING_SCHEMA, day_of_row, final_flush, flush_batches_to_lake, flush_to_lake, lake_writer,
                                      land, stream_readings)
from envlake.streaming.stateful import stream_compensate


def cut(df, n):
    """``n`` parts that follow each other in time."""
    us = F.unix_micros("timestamp")
    edges = df.agg(F.percentile_approx(us, [k / n for k in range(1, n)])).first()[0]
    return [df.where((us > low if low else F.lit(True)) & (us <= high if high else F.lit(True))) for low, high in zip([None, *edges], [*edges, None])]


def wait(done, seconds=60):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(1)


def test_stream_and_batch_rows_share_a_lake(spark, sf):
    base = work_dir(spark, "test-shared")
    c = corrected_readings(raw_readings(spark, sf))
    even, odd = c.where("boot_id % 2 = 0"), c.where("boot_id % 2 = 1")
    land(even.select("station", "timestamp", *SENSOR_FLOAT_COLUMNS), f"{base}/in")
    stream = stream_readings(spark, f"{base}/in", c.select("station", "timestamp", *SENSOR_FLOAT_COLUMNS).schema)
    flush_to_lake(stream, f"{base}/lake", f"{base}/ckpt").awaitTermination()
    assert 0 < scan_readings(spark, f"{base}/lake").count() < c.count()
    write_readings(lake_readings(odd), f"{base}/lake")
    assert scan_readings(spark, f"{base}/lake").count() == c.count()
    # a second checkpoint adds its rows; none replaces another's
    flush_to_lake(stream, f"{base}/lake", f"{base}/ckpt2").awaitTermination()
    assert scan_readings(spark, f"{base}/lake").count() == c.count() + even.count()
    assert scan_flushes(spark, f"{base}/lake").select("flush").distinct().count() == 3


def test_a_crash_after_the_write_leaves_no_copies(spark, sf):
    base = work_dir(spark, "test-crash")
    raw = raw_readings(spark, sf).select(*RAW_READING_SCHEMA.names)
    for part in cut(raw, 3):
        land(part, f"{base}/in", 1)
    stream = stream_compensate(stream_readings(spark, f"{base}/in", max_files_per_trigger=1))
    write, calls = lake_writer(f"{base}/lake", day_of_row), []

    def breaks(df, batch_id):
        write(df, batch_id)
        calls.append(batch_id)
        if len(calls) == 2:  # written, but not yet known as done
            raise RuntimeError("lost")
    q = stream.writeStream.foreachBatch(breaks).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination()
    flush_to_lake(stream, f"{base}/lake", f"{base}/ckpt").awaitTermination()
    want = corrected_readings(raw_readings(spark, sf))
    got = scan_readings(spark, f"{base}/lake")
    assert calls == [0, 1] and got.count() == want.count() == got.select("station", "timestamp").distinct().count()


def test_collector_batches_over_triggers_keep_their_first_day(spark):
    t0 = dt.datetime(2024, 1, 1, 23, 40)
    rows = [("s", 1, k, t0 + dt.timedelta(seconds=60 * k)) for k in range(60)]
    raw = spark.createDataFrame(rows, "station string, boot_id long, event_id long, timestamp timestamp").withColumns(
        {c: F.lit(20.0) for c in RAW_READING_SCHEMA.names if c not in ("station", "boot_id", "event_id", "timestamp")}).select(*RAW_READING_SCHEMA.names)
    base = work_dir(spark, "test-midnight")
    for k in range(0, 60, 9):  # triggers cut the batch 23:45 - 00:00, whose closing reading is after midnight
        land(raw.where((F.col("event_id") >= k) & (F.col("event_id") < k + 9)), f"{base}/in", 1)
    stream = stream_compensate(stream_readings(spark, f"{base}/in", max_files_per_trigger=1), warmup=2)
    flush_batches_to_lake(stream, f"{base}/lake", f"{base}/ckpt").awaitTermination()
    assert scan_flushes(spark, f"{base}/lake").select("flush").distinct().count() == 7
    twin = batch_partition_values(corrected_readings(raw, warmup=2))
    want = {(r.timestamp, int(r.month), int(r.day)) for r in twin.collect()}
    got = {(r.timestamp, r.month, r.day) for r in scan_readings(spark, f"{base}/lake").collect()}
    assert got == want and any(t.day == 2 and d == 1 for t, _, d in got)


def test_a_flush_writes_one_file_for_a_small_station_day(spark, sf):
    base = work_dir(spark, "test-small-days")
    raw = raw_readings(spark, sf).select(*RAW_READING_SCHEMA.names)
    land(raw, f"{base}/in")
    flush_to_lake(stream_compensate(stream_readings(spark, f"{base}/in")), f"{base}/lake", f"{base}/ckpt").awaitTermination()
    files = list_files(spark, f"{base}/lake").select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    assert 1 < files.count() == files.distinct().count()


def test_boots_share_buckets_of_state(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, b, None if b == 2 and k % 5 == 0 else k, t0 + dt.timedelta(seconds=61 * k + 7 * ((b or 0) % 5)), 20.0 + k % 7, None if k % 4 == 0 else 50.0)
            for s in ("s", "t", None) for b in (1, 2, (1 << 60) + 1, None) for k in range(30)]
    raw = spark.createDataFrame(rows, "station string, boot_id long, event_id long, timestamp timestamp, raw_temperature double, raw_humidity double").withColumns(
        {c: F.lit(20.0) + F.coalesce("event_id", F.lit(1)) % 3 for c in RAW_READING_SCHEMA.names if c not in ("station", "boot_id", "event_id", "timestamp", "raw_temperature", "raw_humidity")}).select(*RAW_READING_SCHEMA.names)
    base = work_dir(spark, "test-buckets")
    parts = cut(raw, 3)
    land(parts[0], f"{base}/in", 2)
    stream = stream_compensate(stream_readings(spark, f"{base}/in"), buckets=2)
    q = stream.writeStream.format("memory").queryName("shared_buckets").option("checkpointLocation", f"{base}/ckpt").trigger(processingTime="1 second").start()
    try:
        q.processAllAvailable()
        for part in parts[1:]:
            land(part, f"{base}/in", 2)
            q.processAllAvailable()
        cols = ["station", "boot_id", "event_id", "timestamp", *SENSOR_FLOAT_COLUMNS, "seq_rn", "batch_end"]
        got, want = spark.table("shared_buckets").select(*cols), corrected_readings(raw).select(*cols)
        assert got.count() == want.count() == 12 * 20
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 2
    finally:
        q.stop()


def test_parts_of_the_batch_layout_land_by_the_tasks_that_read_them(spark, sf, monkeypatch):
    landed = []
    monkeypatch.setattr(stream_queries, "land", lambda df, landing, files=None: (landed.append(files), land(df, landing, files)))
    got = stream_queries.q_stream_flush_batch_layout(spark, sf)
    assert landed == [None] * stream_queries.FILES and got.count() == corrected_readings(raw_readings(spark, sf)).count()


def test_final_flush_in_the_batch_layout_replicates(spark, sf):
    base = work_dir(spark, "test-final")
    raw = raw_readings(spark, sf).select(*RAW_READING_SCHEMA.names)
    land(raw, f"{base}/in")
    stream = stream_compensate(stream_readings(spark, f"{base}/in"))
    final_flush(None, stream, f"{base}/lake", f"{base}/ckpt", sync_to=f"{base}/far", flush=flush_batches_to_lake)
    want = batch_partition_values(corrected_readings(raw_readings(spark, sf))).select("station", F.col("day").cast("int"), F.date_trunc("millisecond", "timestamp").alias("timestamp"))
    got = scan_readings(spark, f"{base}/far").select("station", "day", "timestamp")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_quarantine_in_the_stream(spark):
    base, good = work_dir(spark, "test-quarantine"), "0123456789abcdef0123456789abcdef"
    df = spark.createDataFrame([(good, 1.0), ("st-1", 2.0)], "station string, temperature double").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    land(df, f"{base}/in", 1)
    flush_to_lake(stream_readings(spark, f"{base}/in", df.schema), f"{base}/lake", f"{base}/ckpt", quarantine=f"{base}/bad").awaitTermination()
    assert scan_readings(spark, f"{base}/lake").count() == 1
    assert [r.station for r in spark.read.parquet(f"{base}/bad").collect()] == ["st-1"]


@pytest.mark.parametrize("days", [0, 60])
def test_copies_are_left_out_however_late(spark, days):
    base = work_dir(spark, "test-late")
    t0 = dt.datetime(2024, 1, 1)
    near = [("a", k, t0 + dt.timedelta(days=90, minutes=k)) for k in range(6)] + [(None, 7, t0)]
    back = [("b", k, t0 + dt.timedelta(days=90 - days, minutes=k)) for k in range(6)]
    schema = "station string, event_id long, timestamp timestamp"
    for rows in (near, back, back + near + [("a", 99, t0 + dt.timedelta(days=90))]):
        land(spark.createDataFrame(rows, schema), f"{base}/in", 1)
        stream = stream_readings(spark, f"{base}/in", spark.createDataFrame([], schema).schema, max_files_per_trigger=1)
        dedupe_to_table(stream, f"{base}/out", f"{base}/ckpt").awaitTermination()
    got = read_deduped(spark, f"{base}/out", spark.createDataFrame([], schema).schema)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(near + back, key=str)


def test_a_deduplicating_flush_of_the_lake(spark, sf):
    base = work_dir(spark, "test-dedupe-lake")
    c = corrected_readings(raw_readings(spark, sf)).select("station", "timestamp", *SENSOR_FLOAT_COLUMNS)
    for _ in range(2):
        land(c, f"{base}/in", 1)
    stream = stream_readings(spark, f"{base}/in", c.schema, max_files_per_trigger=1)
    flush_to_lake(stream, f"{base}/lake", f"{base}/ckpt", dedupe=True).awaitTermination()
    assert scan_readings(spark, f"{base}/lake").count() == c.select("station", F.date_trunc("millisecond", "timestamp")).distinct().count()


def test_windows_of_two_queries_with_a_late_station(spark, sf):
    base = work_dir(spark, "test-windows")
    c = corrected_readings(raw_readings(spark, sf)).select("station", "timestamp", "temperature", "humidity", "pm25")
    late = c.agg(F.max("station")).first()[0]
    on_time = c.where(F.col("station") != late)
    for k, rows in enumerate([on_time.where("unix_micros(timestamp) % 2 = 0"), on_time.where("unix_micros(timestamp) % 2 = 1"), c.where(F.col("station") == late)]):
        land(rows, f"{base}/in{k // 2}", 2)
    for k in range(2):
        windows_to_table(stream_readings(spark, f"{base}/in{k}", c.schema, max_files_per_trigger=1), f"{base}/out", f"{base}/ckpt{k}", 15).awaitTermination()
    got = read_windows(spark, f"{base}/out")
    want = batch_stats(c.withColumn("batch_end", F.window("timestamp", "15 minutes")["end"]), keys=("station", "batch_end"))
    columns = ["station", "n_readings", "first_ts", "last_ts", "readings_per_s"]
    assert sorted(map(tuple, got.select("window_end", *columns).collect())) == sorted(map(tuple, want.select("batch_end", *columns).collect()))
    newest = c.agg(F.max("timestamp")).first()[0]
    closed = read_windows(spark, f"{base}/out", closed_after="3 days")
    assert 0 < closed.count() < got.count() and closed.agg(F.max("window_end")).first()[0] <= newest - dt.timedelta(days=3)


@pytest.mark.parametrize("chunk", [900, 3600, 7 * 86400])
def test_failed_flushes_go_with_the_next_that_succeeds(spark, chunk):
    t0 = dt.datetime(2024, 1, 1)
    ends = [t0 + dt.timedelta(minutes=15 * k) for k in range(12)]
    rows = [(s, 1, e - dt.timedelta(minutes=m), e) for s in ("a", None) for e in ends for m in (1, 2)] + [("a", 1, t0, None)]
    df = spark.createDataFrame(rows, "station string, boot_id long, timestamp timestamp, batch_end timestamp")
    lost = {0, 1, 4, 6, 7, 8, 10, 11}
    failed = spark.createDataFrame([(s, 1, ends[k]) for s in ("a", None) for k in lost] + [("z", 1, ends[0])], "station string, boot_id long, batch_end timestamp")
    got = flushes_after_failure(df, failed, chunk_seconds=chunk)
    assert got.count() == len(rows)
    for r in got.collect():
        k = None if r.batch_end is None else next((j for j in range(ends.index(r.batch_end), 12) if j not in lost), None)
        assert r.flush_end == (None if k is None else ends[k])


def test_failed_flushes_do_not_depend_on_chunks(spark, sf):
    c = corrected_readings(raw_readings(spark, sf)).select("station", "boot_id", "timestamp", "batch_end")
    one, other = (flushes_after_failure(c, failed_flushes(c), chunk_seconds=s) for s in (900, 30 * 86400))
    assert one.exceptAll(other).isEmpty() and one.where("flush_end > batch_end").count() > 0


@pytest.mark.parametrize("chunk,strict", [(60, False), (3600, True), (86400, False)])
def test_asof_join_equals_brute_force(spark, chunk, strict):
    t0 = dt.datetime(2024, 1, 1)
    left = [(k % 3 if k % 7 else None, k, t0 + dt.timedelta(seconds=97 * k)) for k in range(200)] + [(1, 900, None)]
    right = [(k % 3 if k % 5 else None, f"r{k}", t0 + dt.timedelta(seconds=291 * (k // 2))) for k in range(60)] + [(1, "none", None)]
    a = spark.createDataFrame(left, "g int, i int, t timestamp")
    b = spark.createDataFrame(right, "g int, v string, t timestamp")
    got = {r.i: (r.last_v, r.last_t) for r in asof_join(a, b, ["g"], "t", "t", ["v", "t"], strict=strict, chunk_seconds=chunk, prefix="last_").collect()}
    for g, i, t in left:
        fits = [(u, v) for h, v, u in right if h == g and u is not None and t is not None and (u < t if strict else u <= t)]
        assert got[i] == (max(fits)[::-1] if fits else (None, None))
    assert len(got) == len(left)


def test_boots_are_recovered_from_uptime(spark, sf):
    r = raw_readings(spark, sf).select("station", "event_id", "timestamp", "boot_id")
    got = sessions_from_uptime(r, raw_health(spark, sf).drop("boot_id"))
    pairs = got.select("station", "boot_id", "boot_no").distinct()
    assert pairs.count() == r.select("station", "boot_id").distinct().count() == pairs.select("station", "boot_no").distinct().count()
    assert got.where("boot_no IS NULL").isEmpty()
    some = sessions_from_uptime(r, raw_health(spark, sf).drop("boot_id").where("station = 'none'"))
    assert some.count() == r.count() and some.where("boot_no IS NOT NULL").isEmpty()


def test_state_holds_small_frames_and_forgets_idle_boots(spark, sf):
    base = work_dir(spark, "test-frames")
    raw = raw_readings(spark, sf).select(*RAW_READING_SCHEMA.names)
    land(raw.where("boot_id = 0"), f"{base}/in", 3)
    with scoped_conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "10"):
        q = (stream_compensate(stream_readings(spark, f"{base}/in", max_bytes_per_trigger=1 << 30), idle="1 second").writeStream.format("memory")
             .queryName("small_frames").option("checkpointLocation", f"{base}/ckpt").trigger(processingTime="1 second").start())
        try:  # such a query runs a batch at every trigger, so there is no end of all available rows to wait for
            want = corrected_readings(raw_readings(spark, sf).where("boot_id = 0"))
            wait(lambda: spark.table("small_frames").count() == want.count())
            cols = ["station", "boot_id", "event_id", "timestamp", *SENSOR_FLOAT_COLUMNS, "seq_rn", "batch_end"]
            got = spark.table("small_frames").select(*cols)
            assert got.count() == want.count() and got.exceptAll(want.select(*cols)).isEmpty()
            state = lambda: [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
            wait(lambda: state() and state()[-1] == 0)
            assert max(state()) > 1 and state()[-1] == 0
        finally:
            q.stop()


def test_readings_without_compensation(spark, sf):
    raw = raw_readings(spark, sf)
    plain = corrected_readings(raw, compensation=False)
    want = corrected_readings(raw)
    assert plain.count() == want.count()
    assert plain.where("NOT (temperature <=> raw_temperature) OR NOT (humidity <=> raw_humidity)").isEmpty()

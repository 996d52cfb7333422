"""Lake layout, drift-tolerant health scan and replication on real files."""

import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from envlake.operators.batching import batch_partition_values
from envlake.sources.health_lake import scan_health
from envlake.sources.lake import scan_readings, write_readings
from envlake.sources.replicate import replicate_files


def test_midnight_batch_keeps_first_day(spark):
    rows = [("s", 0, "2024-01-01 23:58:00"), ("s", 0, "2024-01-02 00:00:05"), ("s", 0, "2024-01-02 00:10:00")]
    df = (spark.createDataFrame(rows, "station string, boot_id long, ts string")
          .withColumn("timestamp", F.col("ts").cast("timestamp"))
          .withColumn("batch_end", F.lit("2024-01-02 00:15:00").cast("timestamp")))
    out = batch_partition_values(df).select("year", "month", "day", "file_label").distinct().collect()
    assert [tuple(r) for r in out] == [("2024", "01", "01", "data_0010")]


def test_write_scan_round_trip_and_pruning(spark):
    root = tempfile.mkdtemp(prefix="lake-") + "/output"
    df = spark.createDataFrame(
        [("st-1", "2024-01-05 10:00:00.123456", 21.5, "2024", "01", "05"),
         ("st-2", "2024-01-06 11:00:00", 19.25, "2024", "01", "06")],
        "station string, ts string, temperature double, year string, month string, day string",
    ).withColumn("timestamp", F.col("ts").cast("timestamp")).drop("ts")
    write_readings(df, root)
    assert os.path.isdir(f"{root}/station=st-1/year=2024/month=01/day=05")
    back = scan_readings(spark, root)
    r = back.where("station = 'st-1'").first()
    assert r.temperature == 21.5 and r.month == 1 and r.pressure is None
    assert r.timestamp.microsecond == 123000  # stored in milliseconds
    plan = back.where((F.col("station") == "st-2") & (F.col("day") == 6))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "st-2" in plan


def test_health_scan_survives_type_drift(spark):
    root = tempfile.mkdtemp(prefix="health-") + "/output-health"
    p1 = f"{root}/station=a/year=2024/month=01/day=01"
    p2 = f"{root}/station=b/year=2024/month=01/day=02"
    os.makedirs(p1)
    os.makedirs(p2)
    ts = pa.timestamp("us", tz="UTC")
    pq.write_table(pa.table({"timestamp": pa.array([1704067200000000], ts), "wifi_ssid": pa.array([None], pa.null()),
                             "wifi_quality_percent": pa.array([100], pa.int64())}), f"{p1}/health_0015.parquet")
    pq.write_table(pa.table({"timestamp": pa.array([1704153600000000], ts), "wifi_ssid": pa.array(["x"]),
                             "wifi_quality_percent": pa.array([55.5])}), f"{p2}/health_0015.parquet")
    rows = {r.station: r for r in scan_health(spark, root).collect()}
    assert rows["a"].wifi_ssid is None and rows["a"].wifi_quality_percent == 100.0
    assert rows["b"].wifi_ssid == "x" and rows["b"].wifi_quality_percent == 55.5
    assert rows["a"].cpu_temp_c is None
    assert rows["a"].timestamp.year == 2024 and rows["b"].day == 2
    only_b = scan_health(spark, root, stations=["b"]).collect()
    assert [r.station for r in only_b] == ["b"]


def _write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_replicate_new_changed_skip(spark):
    base = tempfile.mkdtemp(prefix="sync-")
    src, dst = f"{base}/output", f"{base}/remote"
    a = "station=s/year=2024/month=01/day=01/data_0015.parquet"
    b = "station=s/year=2024/month=01/day=01/data_0030.parquet"
    c = "station=s/year=2024/month=01/day=01/data_0045.parquet"
    junk = ".cache/pyarrow/tests/x.parquet"
    _write(f"{src}/{a}", b"aaaa")
    _write(f"{src}/{b}", b"bbbb")
    _write(f"{src}/{c}", b"cccc")
    _write(f"{src}/{junk}", b"junk")
    _write(f"{dst}/{a}", b"aaaa")      # identical -> skip
    _write(f"{dst}/{b}", b"bbbX")      # same size, other content -> content_changed
    first = {r.path: r.action for r in replicate_files(spark, src, dst).collect()}
    assert first == {a: "skip", b: "content_changed", c: "new"}
    with open(f"{dst}/{b}", "rb") as f:
        assert f.read() == b"bbbb"
    second = {r.path: r.action for r in replicate_files(spark, src, dst).collect()}
    assert set(second.values()) == {"skip"}


def test_refuses_dangerous_roots(spark):
    assert replicate_files(spark, "/tmp", "/tmp/elsewhere").count() == 0


def test_storage_stats_on_a_real_lake(spark, sf):
    from envlake.operators.sync import storage_stats
    from envlake.plans.lake_build import build_lakes
    from envlake.session import local_path
    from envlake.sources.files import list_files
    root = build_lakes(spark, sf).readings
    files = [os.path.join(d, f) for d, _, fs in os.walk(local_path(root)) for f in fs if f.endswith(".parquet")]
    stats = {(r.station, r.day, r.level): r for r in storage_stats(list_files(spark, root)).collect()}
    total = stats[(None, None, 3)]
    assert total.files == len(files)
    assert total.total_mb == sum(os.path.getsize(f) for f in files) / 1048576
    assert sum(r.files for (st, d, lvl), r in stats.items() if lvl == 0) == len(files)


def test_files_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    from envlake.sources import files
    names = [f"station={k % 3}/day={k}/data_{k}.parquet" for k in range(40)] + [
        "_x=1/a.parquet", "_metadata/b.parquet", "c d%.parquet", "_hidden/e.parquet", ".f/g.parquet", "h._COPYING_", "i.txt", "station=0/.j.parquet"]
    for n in names:
        os.makedirs(os.path.dirname(tmp_path / n), exist_ok=True)
        (tmp_path / n).write_bytes(n.encode())
    (tmp_path / "empty.parquet").write_bytes(b"")
    os.symlink(tmp_path / "nowhere", tmp_path / "k.parquet")
    row = lambda r: (r.path, r.size, r.last_modified)
    for folders in (None, [f"{tmp_path}/station=*/day=7", f"{tmp_path}/station=1", f"{tmp_path}/c d%.parquet"]):
        there = folders or [str(tmp_path)]
        want = sorted(map(row, files._list_by_reader(spark, files.qualified(spark, str(tmp_path)), "*.parquet", there).collect()))
        monkeypatch.setattr(files, "_list_by_reader", None)  # the driver holds every name there
        assert sorted(map(row, files.list_files(spark, str(tmp_path), folders=folders).collect())) == want
        assert len(want) == (43 if folders is None else 14)
        monkeypatch.undo()
    assert files.list_files(spark, str(tmp_path), glob="{i,h}*").select("path").collect() == [("i.txt",)]
    monkeypatch.setattr(files, "_WALKED", 0)  # a round for each level; workers fork anew or read the shipped module
    assert files.list_files(spark, str(tmp_path)).count() == 43
    assert files.list_files(spark, f"{tmp_path}/none").count() == 0


def test_final_sync_replicates_both_lakes(spark, sf):
    from envlake.plans.lake_build import build_lakes
    from envlake.session import work_dir
    from envlake.sources.files import list_files
    from envlake.sources.replicate import sync_lakes
    lakes, target = build_lakes(spark, sf), work_dir(spark, "target") + "/output"
    first = sync_lakes(spark, lakes.readings, target).groupBy("lake", "action").count().collect()
    assert {(r.lake, r.action) for r in first} == {("readings", "new"), ("health", "new")}
    for a, b in ((lakes.readings, target), (lakes.health, target + "-health")):
        assert list_files(spark, a).select("path", "size").exceptAll(list_files(spark, b).select("path", "size")).isEmpty()
    again = sync_lakes(spark, lakes.readings, target).select("action").distinct().collect()
    assert [r.action for r in again] == ["skip"]


def test_replication_copies_in_several_tasks(spark, sf):
    from envlake.plans.sync_queries import q_replicate_files
    from envlake.session import scoped_conf
    with scoped_conf(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        out = q_replicate_files(spark, sf).where("action <> 'skip'")
        assert {r.action for r in out.select("action").distinct().collect()} == {"new", "size_mismatch", "content_changed"}
        assert out.select(F.input_file_name()).distinct().count() > 1  # a written file per task


def test_drifted_health_scan_is_narrowed_and_pruned(spark, sf):
    from envlake.plans.lake_queries import q_scan_health_drift
    whole = q_scan_health_drift(spark, sf)
    plan = whole.where("year = 1999")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    r = whole.select("station", "year", "month", "day").where("day % 3 <> 0").first()
    root = next(f for f in whole.inputFiles() if "/station=" in f).split("/station=")[0]
    some = scan_health(spark, root, stations=[r.station], dates=[(r.year, r.month, r.day), (1999, 1, 1)])
    same = whole.where((F.col("station") == r.station) & (F.col("year") == r.year) & (F.col("month") == r.month) & (F.col("day") == r.day))
    assert sorted(map(str, some.collect())) == sorted(map(str, same.collect())) != []
    assert scan_health(spark, root, dates=[(1999, 1, 1)]).count() == 0


def test_invalid_station_ids_go_to_quarantine(spark):
    base = tempfile.mkdtemp(prefix="quarantine-")
    good = "0123456789ABCDEF0123456789abcdef"
    df = (spark.createDataFrame([(good, 1.0), ("st-1", 2.0), (None, 3.0)], "station string, temperature double")
          .selectExpr("*", "timestamp'2024-01-01 00:00:00' AS timestamp", "'2024' AS year", "'01' AS month", "'01' AS day"))
    write_readings(df, f"{base}/lake", quarantine=f"{base}/quarantine")
    assert [r.station for r in scan_readings(spark, f"{base}/lake").collect()] == ["01234567-89ab-cdef-0123-456789abcdef"]
    assert {r.station for r in spark.read.parquet(f"{base}/quarantine").collect()} == {"st-1", None}


def test_one_bad_file_leaves_the_others_copied(spark):
    base = tempfile.mkdtemp(prefix="partly-")
    names = [f"station=s{k}/year=2024/month=01/day=01/data_0015.parquet" for k in range(6)]
    for n in names:
        _write(f"{base}/output/{n}", n.encode())
    _write(f"{base}/remote/station=s3", b"a file where a folder has to be")
    first = {r.path: r for r in replicate_files(spark, f"{base}/output", f"{base}/remote").collect()}
    assert {p: r.action for p, r in first.items()} == {n: "failed" if "s3" in n else "new" for n in names}
    bad = first[names[3]]
    assert bad.bytes == 0 and bad.e_tag is None and bad.error and first[names[0]].error is None
    os.remove(f"{base}/remote/station=s3")
    again = {r.path: r.action for r in replicate_files(spark, f"{base}/output", f"{base}/remote").collect()}
    assert again == {n: "new" if "s3" in n else "skip" for n in names}
    assert not [f for _, _, fs in os.walk(f"{base}/remote") for f in fs if f.endswith(".tmp")]


def test_copies_are_dealt_by_bytes(spark):
    from envlake.sources.files import by_bytes
    sizes = [1 << 30] * 4 + [1 << 20] * 400
    files = spark.createDataFrame([(f"f{k:04d}", n) for k, n in enumerate(sizes)], "path string, size long").repartition(7)
    dealt = by_bytes(files, 4).groupBy(F.spark_partition_id()).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in dealt) == len(sizes) and max(r.b for r in dealt) <= 2 * (1 << 30) + 400 * (1 << 20)
    assert len(dealt) >= 3 and by_bytes(files.where("false"), 4).count() == 0


def test_object_store_names():
    import pytest
    from envlake.sources.files import _fs, _own_name, arrow_uri
    assert arrow_uri("s3a://b/k") == "s3://b/k" and arrow_uri("s3n://b/k") == "s3://b/k" and arrow_uri("gcs://b/k") == "gs://b/k"
    assert arrow_uri("file:/a") == "file:/a" and arrow_uri("/a/b") == "/a/b" and arrow_uri("hdfs://n/a") == "hdfs://n/a"
    with pytest.raises(ValueError, match="nosuch"):
        _fs("nosuch://a/b")
    assert _own_name("x") != _own_name("x")


def test_roots_without_a_scheme_are_those_of_spark(spark):
    from envlake.sources.files import qualified
    assert qualified(spark, "/a/b/") == "file:/a/b" and qualified(spark, "file:///a") == "file:/a"


def test_drifted_scan_is_native(spark, sf):
    from envlake.plans.lake_queries import q_scan_health_drift
    plan = q_scan_health_drift(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_health_kinds_with_extra_and_missing_columns(spark):
    root = tempfile.mkdtemp(prefix="kinds-") + "/output-health"
    ts = pa.timestamp("us", tz="UTC")
    one = pa.array([1704067200000000], ts)
    for k, t in enumerate([{"timestamp": one, "cpu_temp_c": pa.array([1.5])}, {"timestamp": one, "cpu_temp_c": pa.array([2], pa.int32())},
                           {"timestamp": one, "cpu_temp_c": pa.array([3], pa.int8()), "other": pa.array(["x"])}, {"timestamp": one, "cpu_temp_c": pa.nulls(1)},
                           {"timestamp": one, "wifi_signal_dbm": pa.array([-4.0])}]):
        folder = f"{root}/station=s{k % 2}/year=2024/month=01/day={k + 1:02d}"
        os.makedirs(folder)
        pq.write_table(pa.table(t), f"{folder}/health_0000.parquet")
    got = {r.day: (r.cpu_temp_c, r.wifi_signal_dbm) for r in scan_health(spark, root).collect()}
    assert got == {1: (1.5, None), 2: (2.0, None), 3: (3.0, None), 4: (None, None), 5: (None, -4)}
    assert [r.day for r in scan_health(spark, root, dates=[(2024, 1, 1)]).collect()] == [1]
    assert [r.day for r in scan_health(spark, root, dates=[(2024, 1, 1), (2024, 1, 2)]).orderBy("day").collect()] == [1, 2]


def _documents(spark, tmp_path, n=240):
    """A table of documents of its own: an empty text, a null one and a repeated row among them."""
    rows = [(k, None if k == 3 else "" if k == 4 else f"text {k} ä" * (k % 5 + 1)) for k in range(n)]
    spark.createDataFrame([*rows, rows[1]], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_files_of_a_listing_are_there_part_by_part(spark, tmp_path, monkeypatch):
    from envlake.plans import sync_queries
    from envlake.sources import files, fixtures
    sf, roots, seen = _documents(spark, tmp_path), [], []

    def listed(spark, root, f=files.list_files):
        roots.append(root)
        seen.append(sum(len(fs) for _, _, fs in os.walk(root.removeprefix("file:"))))
        return f(spark, root)
    laid_out = fixtures.laid_out_files(spark, sf).where("path NOT LIKE '.%' AND length(content) > 0")
    want = sorted(map(tuple, laid_out.selectExpr("path", "cast(length(content) as long)").distinct().collect()))
    monkeypatch.setattr(sync_queries, "list_files", listed)
    for part, parts in ((files._PART, 1), (1 << 20, 4)):
        monkeypatch.setattr(files, "_PART", part)
        roots.clear(), seen.clear()
        got = sync_queries.q_list_local(spark, sf)
        assert sorted(map(tuple, got.collect())) == want and len(want) == 240 - 40 - 1
        assert len(seen) == parts and sum(seen) == 240 and max(seen) <= 240 / parts * 1.5
        assert not any(os.path.exists(r.removeprefix("file:")) for r in roots)


def test_sources_of_a_replication_are_there_part_by_part(spark, tmp_path, monkeypatch):
    from envlake.plans import sync_queries
    from envlake.sources import files, fixtures
    sf, roots, seen = _documents(spark, tmp_path), [], []

    def below(root):
        top = root.removeprefix("file:")
        return {os.path.relpath(os.path.join(d, f), top): os.path.join(d, f) for d, _, fs in os.walk(top) for f in fs}

    def replicated(spark, root, target, f=sync_queries.replicate_files, **more):
        roots.extend((root, target))
        seen.append(len(below(root)))
        return f(spark, root, target, **more)
    laid_out = [r for r in fixtures.laid_out_files(spark, sf).distinct().collect() if r.content]
    monkeypatch.setattr(sync_queries, "replicate_files", replicated)
    monkeypatch.setattr(files, "_PART", 1 << 20)
    got = {r.path: (r.action, r.bytes) for r in sync_queries.q_replicate_files(spark, sf).collect()}
    lake = [r for r in laid_out if r.path.startswith("station=")]
    assert got == {r.path: ("new" if r.remote is None else "size_mismatch" if len(r.remote) != len(r.content) else
                            "content_changed" if r.remote != r.content else "skip", 0 if r.remote == r.content else len(r.content)) for r in lake}
    assert len(seen) == 4 and sum(seen) == 240 and max(seen) <= 90
    assert not any(os.path.exists(r.removeprefix("file:")) for r in roots[::2]) and len(set(roots[1::2])) == 1
    there = below(roots[1])  # the target is left, with every file as it is in the source
    assert all(open(there[r.path], "rb").read() == bytes(r.content) for r in lake)
    assert {r.path for r in laid_out if r.remote} <= there.keys()

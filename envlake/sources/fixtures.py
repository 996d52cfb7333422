"""Adapters from the driver's test tables to the raw inputs envlake processes.

The test tables hold no sensor data, so each adapter is a deterministic row-by-row
projection of ``events`` or ``documents`` into the schema a job expects (see
FIXTURES.md). Adapters only shape input; they do none of the jobs' work. Integer
arithmetic and division by a double keep Spark and DuckDB bit-identical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _e() -> Column:
    return F.col("event_id")


def _cycle(key: Column, values: list[Column]) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(key == i, v) if expr is None else expr.when(key == i, v)
    return expr


def _s(c: Column) -> Column:
    return c.cast("string")


def _station() -> Column:
    return F.concat(F.lit("st-"), F.lpad(_s(F.col("user_id") % 8), 2, "0"))


def _keys() -> list[Column]:
    e = _e()
    return [_station().alias("station"), F.floor(e / 400).cast("long").alias("boot_id"),
            e.alias("event_id"), F.col("ts").cast("timestamp").alias("timestamp")]


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one raw sensor reading per event."""
    e = _e()
    ev = read_table(spark, sf_dir, "events")
    ok_pm = F.col("event_type") != "error"
    pm = [F.when(ok_pm, F.col("value") / 4).alias("pm1"),
          F.when(ok_pm, F.col("value") / 2).alias("pm25"),
          F.when(ok_pm, F.col("value")).alias("pm10")]
    parts = [F.when(ok_pm, (e % k).cast("double")).alias(n) for k, n in
             [(900, "particles_03um"), (500, "particles_05um"), (300, "particles_10um"),
              (90, "particles_25um"), (30, "particles_50um"), (9, "particles_100um")]]
    return ev.select(
        *_keys(),
        (F.lit(15) + ((e * 7) % 200) / 10.0).alias("raw_temperature"),
        F.when(e % 23 != 0, F.lit(30) + ((e * 13) % 600) / 10.0).alias("raw_humidity"),
        (F.lit(990) + (e % 400) / 10.0).alias("pressure"),
        F.when(e % 17 != 0, F.lit(40) + ((e * 11) % 300) / 10.0).alias("cpu_temp_c"),
        (((e * 7) % 40) / 10.0).alias("ox_v"),
        (((e * 3) % 40) / 10.0).alias("red_v"),
        (((e * 9) % 40) / 10.0).alias("nh3_v"),
        F.col("value").alias("lux"),
        (e % 3).cast("double").alias("proximity"),
        *pm, *parts,
    )


def raw_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw OS-probe outputs per event (strings where the probe prints text)."""
    e = _e()
    ev = read_table(spark, sf_dir, "events")
    base = F.lit(3900000000)
    return ev.select(
        *_keys(),
        F.when(e % 17 != 0, F.lit(40000) + (e * 110) % 30000).alias("cpu_millideg"),
        ((e % 40) / 10.0).alias("load1"), ((e % 30) / 10.0).alias("load5"),
        ((e % 20) / 10.0).alias("load15"),
        F.when(e % 29 == 0, F.lit(0)).otherwise(F.lit(512000)).cast("long").alias("mem_total_kb"),
        F.when(e % 31 != 0, (e * 997) % 512000).alias("mem_available_kb"),
        F.when(e % 37 == 0, F.lit(0)).otherwise(F.lit(16000000000)).cast("long").alias("disk_total_b"),
        F.when(e % 37 == 0, F.lit(0)).otherwise((e * 7919) % 16000000000).cast("long").alias("disk_free_b"),
        F.concat(_s(e % 90), F.lit(".")).alias("wifi_quality_s"),
        _cycle(e % 3, [F.concat(F.lit("-"), _s(e % 90), F.lit(".")),
                       F.concat(_s(e % 100), F.lit(".")),
                       F.concat(_s(F.lit(101) + e % 150), F.lit("."))]).alias("wifi_level_s"),
        _cycle(e % 4, [F.lit("lab-net\n"), F.lit("  "), F.lit(None).cast("string"),
                       F.concat(F.lit("field-"), _s(e % 5))]).alias("iwgetid_s"),
        _cycle(e % 3, [F.concat(F.lit("10.0."), _s(e % 256), F.lit("."), _s(e % 7 + 1),
                                F.lit(" fe80::1\n")),
                       F.lit(" "), F.lit(None).cast("string")]).alias("hostname_s"),
        _cycle(e % 5, [F.concat(F.lit("+"), _s(e % 300), F.lit("ms")), F.lit("-1s"),
                       F.lit("+12us"), F.lit("n/a"), F.lit(None).cast("string")]).alias("timesync_s"),
        _cycle(e % 3, [F.lit("yes"), F.lit(" No "), F.lit(None).cast("string")]).alias("ntpsync_s"),
        F.when(e % 7 == 0, F.lit("0.000123")).alias("chrony_s"),
        F.when(e % 11 == 0, F.lit("1.5")).alias("ntpq_s"),
        F.when(e % 13 == 0, F.lit(0)).otherwise(base + e).cast("long").alias("ntp_orig_i"),
        ((e * 7919) % 4294967296).alias("ntp_orig_f"),
        (base + e).alias("ntp_recv_i"), ((e * 104729) % 4294967296).alias("ntp_recv_f"),
        (base + e).alias("ntp_tx_i"), ((e * 1299709) % 4294967296).alias("ntp_tx_f"),
        (base + e + (e % 50) / 100.0).alias("ntp_dest"),
        F.lit("volt=0.8312V").alias("volt_s"),
        F.when(e % 6 != 5, F.concat(F.lit("throttled="), _cycle(e % 6, [
            F.lit("0x0"), F.lit("0x1"), F.lit("0x50000"), F.lit("0x50005"), F.lit("zz")]))
        ).alias("throttled_s"),
        ((e % 400) * 5).cast("double").alias("uptime_seconds"),
    )


def raw_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per (event, power supply) in listing order ``supply_seq``."""
    e = _e()
    ev = read_table(spark, sf_dir, "events").select(*_keys(), F.explode(F.array(F.lit(0), F.lit(1)))
                                                    .alias("supply_seq"))
    bat = F.col("supply_seq") == 0
    return ev.select(
        "station", "boot_id", "event_id", "timestamp", F.col("supply_seq").cast("int").alias("supply_seq"),
        F.when(bat, F.lit("Battery")).otherwise(F.lit("Mains")).alias("supply_type"),
        F.when(bat, F.concat(_s(e % 101), F.lit("\n"))).alias("capacity_s"),
        F.when(bat, _cycle(e % 4, [F.lit("Discharging"), F.lit("Charging"), F.lit("Full"),
                                   F.lit("Unknown")])).alias("status_s"),
        F.when(~bat, F.when(e % 3 == 0, F.lit("1\n")).otherwise(F.lit("0\n"))).alias("online_s"),
    )


def _doc_path() -> Column:
    d = F.col("doc_id")
    st = F.concat(F.lit("station=st-"), _s(d))
    ymd = F.concat(F.lit("/year=2024/month="), F.lpad(_s(d % 12 + 1), 2, "0"),
                   F.lit("/day="), F.lpad(_s(d % 28 + 1), 2, "0"))
    hhmm = F.concat(F.lpad(_s(d % 24), 2, "0"), F.lpad(_s((d % 4) * 15), 2, "0"))
    return _cycle(d % 6, [
        F.concat(st, ymd, F.lit("/data_"), hhmm, F.lit(".parquet")),
        F.concat(st, ymd, F.lit("/health_"), hhmm, F.lit(".parquet")),
        F.concat(st, F.lit("/year=2024/notes_"), _s(d), F.lit(".parquet")),
        F.concat(F.lit(".cache/uv/st-"), _s(d), F.lit("/pyarrow/tests/data.parquet")),
        F.concat(F.lit("output/"), st, F.lit("/year=2024/month=01/day=01/data_0000.parquet")),
        F.concat(F.lit("st-"), _s(d), F.lit(".parquet")),
    ])


def local_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 local listing: (path, size, last_modified, e_tag) per document."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        _doc_path().alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        F.timestamp_seconds(F.lit(1706745600) + F.col("doc_id")).alias("last_modified"),
        F.concat(F.lit('"'), F.md5(F.col("text").cast("binary")), F.lit('"')).alias("e_tag"),
    )


def remote_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 remote manifest: missing, resized or re-tagged copies of some documents."""
    d = F.col("doc_id")
    docs = read_table(spark, sf_dir, "documents").where(d % 5 != 0)
    size = F.octet_length("text").cast("long")
    tag = F.concat(F.lit('"'), F.md5(F.col("text").cast("binary")), F.lit('"'))
    return docs.select(
        _doc_path().alias("path"),
        F.when(d % 11 == 0, size + 1).otherwise(size).alias("size"),
        F.timestamp_seconds(F.lit(1704067200) + d).alias("last_modified"),
        F.when(d % 7 == 0, F.lit('"0"')).when(d % 13 == 0, F.lit(None).cast("string"))
         .otherwise(tag).alias("e_tag"),
    )


def laid_out_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 as files: (path, content, remote). ``remote`` is the content of the target's copy: NULL where
    it is missing, one byte longer, or of the same size with another first byte, by document id."""
    d = F.col("doc_id")
    docs = read_table(spark, sf_dir, "documents").withColumn("content", F.expr("encode(coalesce(text, ''), 'UTF-8')"))
    remote = (F.when(d % 5 == 0, F.lit(None))
              .when(d % 11 == 0, F.expr("concat(content, X'00')"))
              .when((d % 7 == 0) & (F.length("content") > 0), F.expr("overlay(content PLACING X'00' FROM 1)"))
              .otherwise(F.col("content")))
    return docs.select(_doc_path().alias("path"), "content", remote.alias("remote"))


def station_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate station-id strings in the spellings ``UUID()`` meets in config files."""
    e = _e()
    h = F.md5(_s(e).cast("binary"))
    hy = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                     F.substring(h, 17, 4), F.substring(h, 21, 12))
    raw = _cycle(e % 8, [
        hy, F.upper(h), F.concat(F.lit("{"), hy, F.lit("}")), F.concat(F.lit("urn:uuid:"), hy),
        F.substring(h, 1, 31), F.concat(F.lit("g"), F.substring(h, 2, 31)),
        F.concat(F.lit("0x"), F.substring(h, 1, 30)), F.lit(""),
    ])
    return read_table(spark, sf_dir, "events").select(e.alias("event_id"), raw.alias("raw_id"))

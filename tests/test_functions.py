"""Hand-computed edge cases of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from envlake.functions import health as H
from envlake.functions.boundary import next_boundary
from envlake.functions.compensation import compensate_humidity, compensate_temperature
from envlake.functions.gas import gas_resistance
from envlake.functions.paths import partition_path_class
from envlake.functions.station_id import canonical_station_id, valid_station_id


def one(spark, expr, schema="x double", value=None):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first().r


def test_gas_resistance_edges(spark):
    assert one(spark, gas_resistance("x"), value=3.3) == 0.0
    assert one(spark, gas_resistance("x"), value=1.0) == pytest.approx(1.0 * 56000 / 2.3 / 1000)
    assert one(spark, gas_resistance("x"), value=3.5) < 0  # above 3.3 V: negative, no clamp
    assert one(spark, gas_resistance("x"), value=None) is None


def test_compensation(spark):
    df = spark.createDataFrame([(20.0, 50.0, 40.0)], "t double, h double, cpu double")
    r = df.select(compensate_temperature("t", "cpu").alias("tc")).first().tc
    assert r == pytest.approx(20 - (40 - 20) / 2.25)
    hum = df.select(compensate_humidity("h", "t", compensate_temperature("t", "cpu")).alias("h")).first().h
    dew = 20 - (100 - 50) / 5
    assert hum == pytest.approx(max(0.0, min(100.0, 100 - 5 * (r - dew))))
    # NULL humidity must stay NULL (least/greatest would turn it into 100)
    df2 = spark.createDataFrame([(20.0, None, 40.0)], "t double, h double, cpu double")
    assert df2.select(compensate_humidity("h", "t", "cpu").alias("h")).first().h is None


@pytest.mark.parametrize("ts,b,exp", [
    ("2024-01-01 10:37:12", 15, "2024-01-01 10:45:00"),
    ("2024-01-01 10:45:00", 15, "2024-01-01 11:00:00"),
    ("2024-01-01 10:59:59", 15, "2024-01-01 11:00:00"),
    ("2024-01-01 10:00:00", 15, "2024-01-01 10:15:00"),
    ("2024-01-01 10:51:00", 25, "2024-01-01 11:00:00"),
    ("2024-01-01 10:49:00", 25, "2024-01-01 10:50:00"),
    ("2024-01-01 23:59:00", 15, "2024-01-02 00:00:00"),
    ("2024-01-01 10:10:00", 120, "2024-01-01 11:00:00"),
])
def test_next_boundary(spark, ts, b, exp):
    r = one(spark, next_boundary(F.col("x").cast("timestamp"), b), "x string", ts)
    assert r == dt.datetime.fromisoformat(exp)


@pytest.mark.parametrize("s,valid", [
    ("bd58fce2-5e40-4b07-b9f9-73d4f3139054", True),
    ("{BD58FCE2-5E40-4B07-B9F9-73D4F3139054}", True),
    ("urn:uuid:bd58fce2-5e40-4b07-b9f9-73d4f3139054", True),
    ("bd58fce25e404b07b9f973d4f3139054", True),
    ("bd58fce2-5e40-4b07-b9f9-73d4f313905", False),
    ("zd58fce2-5e40-4b07-b9f9-73d4f3139054", False),
    ("", False),
    (None, False),
])
def test_valid_station_id(spark, s, valid):
    import uuid
    assert one(spark, valid_station_id("x"), "x string", s) is valid
    if valid:
        assert one(spark, canonical_station_id("x"), "x string", s) == str(uuid.UUID(s))


@pytest.mark.parametrize("tok,exp", [("+12ms", 12.0), ("-1s", -1000.0), ("+12us", None), ("n/a", None),
                                     ("1.5ms", 1.5), ("12.0dms", None)])
def test_timesync_offset(spark, tok, exp):
    assert one(spark, H.timesync_offset_ms("x"), "x string", tok) == exp


@pytest.mark.parametrize("hexs,uv", [("0x0", False), ("0x1", True), ("0x50000", False), ("0x50005", True),
                                     ("zz", False), (None, False)])
def test_under_voltage(spark, hexs, uv):
    assert one(spark, H.under_voltage("x"), "x string", hexs) is uv


def test_clock_synced_three_valued(spark):
    df = spark.createDataFrame([("+1ms", None), (None, " Yes "), (None, "no"), (None, None)],
                               "a string, b string")
    got = [r.c for r in df.select(H.clock_synced("a", "b").alias("c")).collect()]
    assert got == [True, True, False, None]


def test_clock_synced_by_exit_status(spark):
    """Exit 0 without an Offset line is an answer; an Offset line of a failed probe isn't; without a status the line decides."""
    rows = [(None, "no", 0), ("+1ms", "no", 1), ("+1ms", None, 4), ("+1ms", "no", None), (None, "yes", 1), (None, None, None), ("+1ms", "no", 0)]
    df = spark.createDataFrame(rows, "a string, b string, e int")
    got = df.select(H.clock_synced("a", "b", "e").alias("c"),
                    H.ntp_offset_ms(H.answered_timesync("a", "e"), F.lit(None).cast("string"), F.lit(None).cast("string"),
                                    F.lit(None).cast("double")).alias("o")).collect()
    assert [r.c for r in got] == [True, False, None, True, True, None, True]
    assert [r.o for r in got] == [None, None, None, 1.0, None, None, 1.0]


@pytest.mark.parametrize("q,lvl,dbm,pct", [("45.", "-60.", -60, 45 / 70 * 100), ("70.", "200.", -56, 100.0),
                                           ("35.", "60.", -40, 50.0), ("x", "-60.", None, None)])
def test_wifi(spark, q, lvl, dbm, pct):
    df = spark.createDataFrame([(q, lvl)], "q string, l string")
    w = H.wifi("q", "l")
    r = df.select(w["wifi_signal_dbm"].alias("d"), w["wifi_quality_percent"].alias("p")).first()
    assert r.d == dbm
    assert (r.p is None and pct is None) or r.p == pytest.approx(pct)


@pytest.mark.parametrize("p,cls", [
    ("station=a/year=2024/month=01/day=02/data_0915.parquet", "exact"),
    ("station=a/year=2024/month=01/day=02/health_0915.parquet", "exact"),
    ("station=a/year=2024/x.parquet", "fallback"),
    (".cache/uv/x/pyarrow/tests/a.parquet", "suspicious"),
    ("output/station=a/year=2024/month=01/day=02/data_0915.parquet", "suspicious"),
    ("a.parquet", "other"),
])
def test_path_class(spark, p, cls):
    assert one(spark, partition_path_class("x"), "x string", p) == cls


def test_empty_batches_hour_restarting_grid(spark):
    from envlake.operators.batching import empty_batches
    df = spark.createDataFrame([("s", "2024-01-01 10:05:00"), ("s", "2024-01-01 12:55:00")],
                               "station string, t string").select("station", F.col("t").cast("timestamp").alias("timestamp"))
    got = sorted(r.batch_end.strftime("%H:%M") for r in empty_batches(df, 25).collect())
    # boundaries with readings: 10:25 and 13:00; the 25-minute grid restarts every hour
    assert got == ["10:50", "11:00", "11:25", "11:50", "12:00", "12:25", "12:50"]


def test_strings_are_cut_and_parsed_as_python_does(spark):
    """Against Python's own ``strip``, ``rstrip`` and ``float`` on strings of awkward signs."""
    import random

    from envlake.functions.parse import py_float, py_strip, rstrip_chars
    pick = random.Random(3)
    signs = ["1", "2", "_", ".", "e", "+", "-", " ", "\n", "\x0b", "\f", "d", "inf"]
    texts = ["", "45.", "45.\n", "45..", "1_000", "1__0", ".5", "1 2", "-1e-5\t"] + ["".join(pick.choices(signs, k=pick.randint(0, 6))) for _ in range(4000)]

    def number(s):
        try:
            return float(s)
        except ValueError:
            return None
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for r in df.select("s", py_strip("s").alias("a"), rstrip_chars("s", ".").alias("b"), py_float("s").alias("c")).collect():
        assert (r.a, r.b, r.c) == (r.s.strip(), r.s.rstrip("."), number(r.s)), r.s
    volts = {"volt=0.8312V": 0.8312, " volt=1V\n": 1.0, "volt=V": None, "volt=1.5VV": None, "xvolt=1V": None, "volt=1": None}
    got = spark.createDataFrame([(v,) for v in volts], "s string").select("s", H.core_voltage("s").alias("v")).collect()
    assert {r.s: r.v for r in got} == volts

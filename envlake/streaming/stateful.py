"""Stateful stream correction per (station, boot) with applyInPandasWithState.

State per boot: readings seen, first and previous timestamp (epoch us), the last five
CPU temperatures of readings whose BME temperature and humidity were read, and the open collector
batch with the time of its first reading. Rows of a micro-batch are sorted by (timestamp, event_id)
inside the boot; rows arriving in a later trigger with an earlier timestamp are counted in
arrival order (the reference's arrival order is its event order). All arithmetic is vectorised
with numpy and adds in the same order as the batch operator, so results equal the batch plan when
each boot's rows arrive in order.

Spark groups by a hash of (station, boot), so that a call serves all boots of a bucket at once: a call
for each boot costs milliseconds, whatever it holds. A bucket's state is a table of its boots. The frames
of a bucket are packed into one numeric array as they come, and results leave in
slices of ``SLICE`` rows, so a task holds the numbers of one bucket's micro-batch, which the source's
``max_bytes_per_trigger`` bounds. With ``idle``, the state of a boot that has been silent for so
long (by the clock) is dropped; a boot that goes on after that begins anew, with its warm-up. No row
is dropped for being late.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from envlake.functions.compensation import DEFAULT_FACTOR
from envlake.operators.assemble import assemble_reading
from envlake.schema import SENSOR_FLOAT_COLUMNS
from envlake.session import ship_package

_US_HOUR = 3_600_000_000
_US_MIN = 60_000_000

#: A bucket's boots, and their numbers as a table of :func:`_state_type`.
STATE_SCHEMA = T.StructType([
    T.StructField("station", T.ArrayType(T.StringType())), T.StructField("boot_id", T.ArrayType(T.LongType())),
    T.StructField("numbers", T.BinaryType()),
])

OUTPUT_SCHEMA = T.StructType(
    [T.StructField("station", T.StringType()), T.StructField("boot_id", T.LongType()),
     T.StructField("event_id", T.LongType()), T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in SENSOR_FLOAT_COLUMNS]
    + [T.StructField("seq_rn", T.LongType()), T.StructField("batch_end", T.TimestampType()),
       T.StructField("health_sample", T.BooleanType()), T.StructField("batch_first", T.TimestampType())])

#: Rows of one frame of results.
SLICE = 10_000
#: Buckets of boots; a checkpoint keeps the number it began with.
BUCKETS = 256
_FLAGS = ["bme_ok", "pressure_ok"]
_INPUTS = ["cpu_for_compensation", "rh_for_compensation", *[c for c in SENSOR_FLOAT_COLUMNS if c not in ("temperature", "humidity")]]


def _next_boundary_us(us: np.ndarray, minutes: int) -> np.ndarray:
    into = np.mod(us, _US_HOUR)
    minute = into // _US_MIN
    step = np.minimum(60, (minute // minutes + 1) * minutes)
    return (us - into) + step * _US_MIN


def _state_type(depth: int) -> np.dtype:
    return np.dtype([("n", "<i8"), ("first", "<i8"), ("prev", "<i8"), ("open", "?"), ("batch", "<i8"), ("batch_first", "<i8"),
                     ("warm", "?"), ("cpu", "<f8", (depth,)), ("seen_ms", "<i8")])


def _packed(pdfs: Iterator[pd.DataFrame]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The boots of a bucket's rows, and in order of boot, time and event: the row's boot, time, event id, whether
    it has one, and its numeric columns."""
    parts = list(pdfs)
    whole = {c: np.concatenate([p[c].to_numpy() for p in parts]) for c in ("station", "boot", "no_boot", "us", "event", "no_event")}
    x = np.concatenate([p[[*_FLAGS, *_INPUTS]].to_numpy(dtype=np.float64) for p in parts])
    station, stations = pd.factorize(whole["station"], use_na_sentinel=False)
    station = station.astype(np.int64)
    new = lambda order, *columns: np.concatenate([[True], np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])])
    keys = (station, whole["no_boot"], whole["boot"])
    order = np.lexsort((whole["event"], whole["no_event"], whole["us"], *keys[::-1]))
    begins = new(order, *keys)
    at = order[begins]
    boots = [(None if pd.isna(s) else s, None if no else b)
             for s, no, b in zip(stations[station[at]], whole["no_boot"][at].tolist(), whole["boot"][at].tolist())]
    return boots, np.cumsum(begins) - 1, whole["us"][order], whole["event"][order], ~whole["no_event"][order].astype(bool), x[order]


def _rolling(values: np.ndarray, boot: np.ndarray, known: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of the last ``depth`` values of each boot (in order of boot), the boots that have values, and their last
    ``depth`` ones. Before a boot's first value come those it had (``known``), or copies of the first."""
    begins = np.flatnonzero(np.concatenate([[True], boot[1:] != boot[:-1]]))
    who, sizes = boot[begins], np.diff(np.append(begins, len(boot)))
    room = np.repeat(np.arange(len(who)), sizes) * (depth - 1) + np.arange(len(values))  # where the row's oldest value is
    s = np.empty(len(values) + len(who) * (depth - 1))
    s[room + depth - 1] = values
    before = np.where(known["warm"][who][:, None], known["cpu"][who], values[begins][:, None])
    for j in range(1, depth):
        s[room[begins] + j - 1] = before[:, j]
    acc = s[room].copy()
    for j in range(1, depth):  # oldest first, as sum(list) adds
        acc = acc + s[room + j]
    last = room[begins + sizes - 1]
    return acc / depth, who, s[last[:, None] + np.arange(depth)]


def _nullable(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return values if known.all() else np.where(known, values.astype(object), None)


def make_state_fn(warmup: int = 10, health_every: int = 12, factor: float = DEFAULT_FACTOR,
                  batch_minutes: int = 15, depth: int = 5, idle_ms: int | None = None):
    at = {c: i for i, c in enumerate([*_FLAGS, *_INPUTS])}
    kind = _state_type(depth)

    def keep_state(state, table: dict[tuple, np.void], now_ms: int) -> None:
        if not table:
            state.remove()
            return
        numbers = np.array(list(table.values()), dtype=kind)
        state.update(([s for s, _ in table], [b for _, b in table], numbers.tobytes()))
        if idle_ms is not None:
            state.setTimeoutDuration(max(1, int(numbers["seen_ms"].min()) + idle_ms - now_ms))

    def fn(key, pdfs, state):
        now_ms = state.getCurrentProcessingTimeMs() if idle_ms is not None else 0
        table = {}
        if state.exists:
            stations, boot_ids, numbers = state.get
            table = dict(zip(zip(stations, boot_ids), np.frombuffer(bytes(numbers), dtype=kind)))
        idle = {k for k, v in table.items() if int(v["seen_ms"]) + idle_ms <= now_ms} if idle_ms is not None else set()
        if state.hasTimedOut:
            keep_state(state, {k: v for k, v in table.items() if k not in idle}, now_ms)
            return
        boots, g, us, event, has_event, x = _packed(pdfs)
        k, begins = len(us), np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        ends = np.append(begins[1:], k) - 1
        own = np.zeros(len(boots), dtype=kind)
        own["first"] = own["prev"] = us[begins]
        for i, boot in enumerate(boots):
            if boot in table:
                own[i] = table[boot]
        n = own["n"][g] + np.arange(1, k + 1, dtype=np.int64) - begins[g]
        ok = x[:, at["bme_ok"]] == 1
        avg = np.full(k, np.nan)
        if ok.any():
            avg[ok], who, cpu = _rolling(x[ok, at["cpu_for_compensation"]], g[ok], own, depth)
            own["cpu"][who], own["warm"][who] = cpu, True
        raw_t = x[:, at["raw_temperature"]]
        temp = raw_t - ((avg - raw_t) / factor)
        hum = 100 - (5 * (temp - (raw_t - ((100 - x[:, at["rh_for_compensation"]]) / 5))))
        hum = np.where(np.isnan(hum), np.nan, np.maximum(0.0, np.minimum(100.0, hum)))
        prev = np.concatenate([us[:1], us[:-1]])
        prev[begins] = own["prev"]
        bend = _next_boundary_us(np.where(n <= warmup + 1, own["first"][g], prev), batch_minutes)
        keep = np.flatnonzero(n > warmup)
        if len(keep):
            boot, end = g[keep], bend[keep]
            first = np.concatenate([[True], boot[1:] != boot[:-1]])
            new = first | np.concatenate([[True], end[1:] != end[:-1]])
            goes_on = first & own["open"][boot] & (own["batch"][boot] == end)
            starts = np.where(goes_on, own["batch_first"][boot], us[keep])[new][np.cumsum(new) - 1]
            last = np.flatnonzero(np.append(first[1:], True))
            own["open"][boot[last]] = True
            own["batch"][boot[last]], own["batch_first"][boot[last]] = end[last], starts[last]
        own["n"], own["prev"], own["seen_ms"] = n[ends], us[ends], now_ms
        keep_state(state, {b: v for b, v in table.items() if b not in idle} | dict(zip(boots, own)), now_ms)
        stations = np.array([s for s, _ in boots], dtype=object)
        boot_ids = np.array([b or 0 for _, b in boots], dtype=np.int64)
        has_boot = np.array([b is not None for _, b in boots])
        for i in range(0, len(keep), SLICE):
            part = keep[i:i + SLICE]
            out = {"station": stations[g[part]], "boot_id": _nullable(boot_ids[g[part]], has_boot[g[part]]),
                   "event_id": _nullable(event[part], has_event[part]), "timestamp": us[part].astype("datetime64[us]")}
            for c in SENSOR_FLOAT_COLUMNS:
                if c == "temperature":
                    out[c] = np.where(ok, temp, np.nan)[part]
                elif c == "humidity":
                    out[c] = np.where(x[:, at["pressure_ok"]] == 1, hum, np.nan)[part]
                else:
                    out[c] = x[part, at[c]]
            out["seq_rn"] = n[part]
            out["batch_end"] = bend[part].astype("datetime64[us]")
            out["health_sample"] = n[part] % health_every == 0
            out["batch_first"] = starts[i:i + SLICE].astype("datetime64[us]")
            yield pd.DataFrame(out)
    return fn


def _milliseconds(duration: str) -> int:
    m = re.fullmatch(r"(\d+) (second|minute|hour|day)s?", duration.strip())
    if not m:
        raise ValueError(f"not a duration such as '7 days': {duration!r}")
    return int(m[1]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[m[2]] * 1000


def stream_compensate(raw_stream: DataFrame, warmup: int = 10, health_every: int = 12,
                      factor: float = DEFAULT_FACTOR, batch_minutes: int = 15, idle: str | None = None,
                      buckets: int = BUCKETS) -> DataFrame:
    """Warm-up skip, 5-deep CPU mean, compensation and as-collected batch per (station, boot), with the first
    reading's time of the batch. ``idle`` (such as ``'30 days'``) bounds how long a silent boot's state is kept;
    ``buckets`` is how many tasks can work at once at most."""
    ship_package(raw_stream.sparkSession)
    a = assemble_reading(raw_stream).withColumn(
        "cpu_for_compensation", F.coalesce(F.col("cpu_temp_c"), F.lit(40.0)))
    # integers with a flag where they are null, as pandas would make them floats; a null time sorts first
    a = a.select(F.pmod(F.xxhash64("station", "boot_id"), F.lit(buckets)).alias("bucket"), "station",
                 F.coalesce("boot_id", F.lit(0)).alias("boot"), F.col("boot_id").isNull().alias("no_boot"),
                 F.coalesce("event_id", F.lit(0)).alias("event"), F.col("event_id").isNull().alias("no_event"),
                 F.coalesce(F.unix_micros("timestamp"), F.lit(np.iinfo(np.int64).min)).alias("us"),
                 *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in _FLAGS], *_INPUTS)
    return a.groupBy("bucket").applyInPandasWithState(
        make_state_fn(warmup, health_every, factor, batch_minutes, idle_ms=_milliseconds(idle) if idle else None),
        OUTPUT_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)

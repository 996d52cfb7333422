"""Health records from raw probe outputs (O42 power fold, O45 full normalisation, O31)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlake.functions import health as H
from envlake.functions.compensation import cpu_temperature
from envlake.functions.parse import py_float, py_strip
from envlake.schema import HEALTH_COLUMNS, HEALTH_METRICS


def power_status(raw_power: DataFrame, keys: Sequence[str] = ("station", "event_id")) -> DataFrame:
    """Fold power supplies in listing order (``supply_seq``); the last writer wins.

    Battery: a readable capacity sets ``battery_percent``; status ``discharging`` ->
    'battery', ``charging``/``full`` -> 'mains', anything else writes nothing. An
    unreadable capacity aborts that supply (its status is never read). Mains: online
    ``1`` -> 'mains'. Supplies that write nothing do not reset earlier values.
    """
    # parse stage (each raw string parsed once), then integer codes so the fold runs as
    # a hash aggregate: 1 = battery, 2 = mains
    parsed = raw_power.select(*keys, F.col("supply_seq").alias("_seq"),
                              F.lower(py_strip("supply_type")).alias("_t"),
                              F.lower(py_strip("status_s")).alias("_st"),
                              F.col("capacity_s").isNotNull().alias("_has_cap"),
                              py_float("capacity_s").alias("_cap"),
                              (py_strip("online_s") == "1").alias("_online"))
    t, st = F.col("_t"), F.col("_st")
    aborted = F.col("_has_cap") & F.col("_cap").isNull()
    code = (F.when(aborted, F.lit(None).cast("int"))
            .when(t == "battery", F.when(st == "discharging", 1).when(st.isin("charging", "full"), 2))
            .when(t == "mains", F.when(F.col("_online"), 2)))
    bp = F.when(t == "battery", F.col("_cap"))
    folded = (parsed.select(*keys, "_seq", code.alias("_ps"), bp.alias("_bp"))
              .groupBy(*keys)
              .agg(F.max_by("_ps", F.when(F.col("_ps").isNotNull(), F.col("_seq"))).alias("_code"),
                   F.max_by("_bp", F.when(F.col("_bp").isNotNull(), F.col("_seq"))).alias("battery_percent")))
    return folded.select(*keys, F.when(F.col("_code") == 1, "battery").when(F.col("_code") == 2, "mains")
                         .alias("power_source"), "battery_percent")


def normalize_health(raw: DataFrame, power: DataFrame | None = None,
                     keys: Sequence[str] = ("station", "event_id"),
                     keep: Sequence[str] = ("station",)) -> DataFrame:
    """The 22-column health record (plus ``keep`` columns) from a ``raw_health`` table.

    ``power`` is the output of :func:`power_status` (joined on ``keys``); an
    under-voltage bit in the throttled word overrides the power source. A column ``timesync_exit``, where
    ``raw`` has it, is the exit status of the timesync probe.
    """
    timesync, status = "timesync_s", None
    if "timesync_exit" in raw.columns:
        status, timesync = "timesync_exit", H.answered_timesync("timesync_s", "timesync_exit")
    # Parse stage: every raw string that feeds several outputs is parsed once here
    # (Spark does not inline a costly expression into several consumers).
    raw = raw.withColumns({**H.wifi_levels("wifi_quality_s", "wifi_level_s"),
                           "throttled_hex": H.throttled_hex("throttled_s")})
    mem = H.memory("mem_total_kb", "mem_available_kb")
    dsk = H.disk("disk_total_b", "disk_free_b")
    wifi = H.wifi_from_levels("wifi_q", "wifi_level")
    packet = H.ntp_packet_offset_ms("ntp_orig_i", "ntp_orig_f", "ntp_recv_i", "ntp_recv_f",
                                    "ntp_tx_i", "ntp_tx_f", "ntp_dest")
    cols = {
        "timestamp": F.col("timestamp"),
        "cpu_temp_c": cpu_temperature("cpu_millideg", for_compensation=False),
        "cpu_load_1min": F.col("load1"), "cpu_load_5min": F.col("load5"),
        "cpu_load_15min": F.col("load15"),
        **mem, **dsk,
        "wifi_ssid": H.wifi_ssid("iwgetid_s"),
        **wifi,
        "ip_address": H.ip_address("hostname_s"),
        "clock_synced": H.clock_synced("timesync_s", "ntpsync_s", status),
        "ntp_offset_ms": H.ntp_offset_ms(timesync, "chrony_s", "ntpq_s", packet),
        "uptime_seconds": F.col("uptime_seconds"),
        "cpu_voltage_v": H.core_voltage("volt_s"),
        "throttled_hex": F.col("throttled_hex"),
    }
    base = raw.select(*dict.fromkeys([*keys, *keep]), *[v.alias(k) for k, v in cols.items()])
    if power is not None:
        base = base.join(power, on=list(keys), how="left")
    else:
        base = base.withColumns({"power_source": F.lit(None).cast("string"),
                                 "battery_percent": F.lit(None).cast("double")})
    base = base.withColumn("power_source", F.when(H.under_voltage("throttled_hex"), F.lit("under-voltage"))
                           .otherwise(F.col("power_source")))
    out = [*dict.fromkeys(keep)] + [F.col(n).cast(t).alias(n) for n, t in HEALTH_COLUMNS]
    return base.select(*out)


def metric_availability(health: DataFrame, keys: Sequence[str] = ("station",),
                        metrics: Sequence[str] = tuple(HEALTH_METRICS)) -> DataFrame:
    """Per station and metric: how many records have the metric (non-NULL) and how many
    do not. Counts are aggregated first (partial aggregation, one row per station), then
    the small result is unpivoted."""
    aggs = []
    for m in metrics:
        aggs += [F.count(m).alias(f"a__{m}"), F.count(F.lit(1)).alias(f"n__{m}")]
    g = health.groupBy(*keys).agg(*aggs)
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a__{m}").alias("available"),
                                           (F.col(f"n__{m}") - F.col(f"a__{m}")).alias("unavailable"))
                                  for m in metrics]))
    return g.select(*keys, stacked.alias("s")).select(*keys, "s.metric", "s.available", "s.unavailable")

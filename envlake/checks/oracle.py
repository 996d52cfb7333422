"""DuckDB SQL written independently of the Spark code, one statement per registered query.

The driver runs each statement against the test tables (registered as views). Adapters
are CTEs mirroring ``envlake.sources.fixtures``; sequence state uses whole-group
windows (the brute-force form of the chunked Spark operators). Literals are DOUBLE
(``::DOUBLE``), never DECIMAL.
"""

from __future__ import annotations

D = "::DOUBLE"


def _cycle(key: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {key} = {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {arms} END"


STATION = "'st-' || lpad(CAST(user_id % 8 AS VARCHAR), 2, '0')"
KEYS = (f"{STATION} AS station, CAST(floor(event_id / 400) AS BIGINT) AS boot_id, event_id, "
        "CAST(ts AS TIMESTAMP) AS timestamp")

RAW_READINGS = f"""raw_readings AS (
  SELECT {KEYS},
    15 + ((event_id * 7) % 200) / 10{D} AS raw_temperature,
    CASE WHEN event_id % 23 <> 0 THEN 30 + ((event_id * 13) % 600) / 10{D} END AS raw_humidity,
    990 + (event_id % 400) / 10{D} AS pressure,
    CASE WHEN event_id % 17 <> 0 THEN 40 + ((event_id * 11) % 300) / 10{D} END AS cpu_temp_c,
    ((event_id * 7) % 40) / 10{D} AS ox_v,
    ((event_id * 3) % 40) / 10{D} AS red_v,
    ((event_id * 9) % 40) / 10{D} AS nh3_v,
    value AS lux, CAST(event_id % 3 AS DOUBLE) AS proximity,
    CASE WHEN event_type <> 'error' THEN value / 4 END AS pm1,
    CASE WHEN event_type <> 'error' THEN value / 2 END AS pm25,
    CASE WHEN event_type <> 'error' THEN value END AS pm10,
    CASE WHEN event_type <> 'error' THEN CAST(event_id % 900 AS DOUBLE) END AS particles_03um,
    CASE WHEN event_type <> 'error' THEN CAST(event_id % 500 AS DOUBLE) END AS particles_05um,
    CASE WHEN event_type <> 'error' THEN CAST(event_id % 300 AS DOUBLE) END AS particles_10um,
    CASE WHEN event_type <> 'error' THEN CAST(event_id % 90 AS DOUBLE) END AS particles_25um,
    CASE WHEN event_type <> 'error' THEN CAST(event_id % 30 AS DOUBLE) END AS particles_50um,
    CASE WHEN event_type <> 'error' THEN CAST(event_id % 9 AS DOUBLE) END AS particles_100um
  FROM events)"""


def gas(v: str) -> str:
    return f"(CASE WHEN 3.3{D} - {v} = 0 THEN 0{D} ELSE ({v} * 56000) / (3.3{D} - {v}) END) / 1000{D}"


def boundary(ts: str, b: int) -> str:
    us = f"epoch_us({ts})"
    return (f"make_timestamp(({us} - ({us} % 3600000000)) + "
            f"least(60, ((({us} % 3600000000) // 60000000) // {b} + 1) * {b}) * 60000000)")


PM_ORDER = ["pm1", "pm25", "pm10", "particles_03um", "particles_05um", "particles_10um",
            "particles_25um", "particles_50um", "particles_100um"]


def _pm_cols() -> str:
    out, conds = [], []
    for c in PM_ORDER:
        conds.append(f"{c} IS NOT NULL")
        out.append(f"CASE WHEN {' AND '.join(conds)} THEN {c} END AS {c}")
    return ",\n    ".join(out)


ASSEMBLED = f"""assembled AS (
  SELECT station, boot_id, event_id, timestamp,
    (raw_temperature IS NOT NULL AND raw_humidity IS NOT NULL) AS bme_ok,
    (raw_temperature IS NOT NULL AND raw_humidity IS NOT NULL AND pressure IS NOT NULL) AS pressure_ok,
    CASE WHEN raw_temperature IS NOT NULL AND raw_humidity IS NOT NULL THEN raw_temperature END AS raw_temperature,
    CASE WHEN raw_temperature IS NOT NULL AND raw_humidity IS NOT NULL THEN raw_humidity END AS rh_read,
    CASE WHEN raw_temperature IS NOT NULL AND raw_humidity IS NOT NULL AND pressure IS NOT NULL THEN raw_humidity END AS raw_humidity,
    CASE WHEN raw_temperature IS NOT NULL AND raw_humidity IS NOT NULL AND pressure IS NOT NULL THEN pressure END AS pressure,
    CASE WHEN ox_v IS NOT NULL AND red_v IS NOT NULL AND nh3_v IS NOT NULL THEN {gas('ox_v')} END AS oxidised,
    CASE WHEN ox_v IS NOT NULL AND red_v IS NOT NULL AND nh3_v IS NOT NULL THEN {gas('red_v')} END AS reducing,
    CASE WHEN ox_v IS NOT NULL AND red_v IS NOT NULL AND nh3_v IS NOT NULL THEN {gas('nh3_v')} END AS nh3,
    lux, CASE WHEN lux IS NOT NULL THEN proximity END AS proximity,
    {_pm_cols()},
    COALESCE(cpu_temp_c, 40{D}) AS cpu
  FROM raw_readings)"""

SEQUENCED = f"""sequenced AS (
  SELECT *,
    row_number() OVER w_all AS rn,
    lag(timestamp) OVER w_all AS prev_ts,
    min(timestamp) OVER (PARTITION BY station, boot_id) AS first_ts,
    CASE WHEN bme_ok THEN
      ((((COALESCE(lag(cpu, 4) OVER w_ok, first_value(cpu) OVER w_ok)
        + COALESCE(lag(cpu, 3) OVER w_ok, first_value(cpu) OVER w_ok))
        + COALESCE(lag(cpu, 2) OVER w_ok, first_value(cpu) OVER w_ok))
        + COALESCE(lag(cpu, 1) OVER w_ok, first_value(cpu) OVER w_ok))
        + cpu) / 5 END AS cpu_avg
  FROM assembled
  WINDOW w_all AS (PARTITION BY station, boot_id ORDER BY timestamp, event_id),
         w_ok AS (PARTITION BY station, boot_id, bme_ok ORDER BY timestamp, event_id)),
compensated AS (
  SELECT *,
    CASE WHEN bme_ok THEN raw_temperature - ((cpu_avg - raw_temperature) / 2.25{D}) END AS temperature
  FROM sequenced),
corrected_all AS (
  SELECT *,
    CASE WHEN pressure_ok THEN greatest(0{D}, least(100{D},
      100 - (5 * (temperature - (raw_temperature - ((100 - rh_read) / 5)))))) END AS humidity,
    {boundary("CASE WHEN rn <= 11 THEN first_ts ELSE prev_ts END", 15)} AS batch_end,
    (rn > 10 AND rn % 12 = 0) AS health_sample
  FROM compensated),
corrected AS (SELECT * FROM corrected_all WHERE rn > 10)"""

SENSOR_FLOATS = ["temperature", "raw_temperature", "pressure", "humidity", "raw_humidity",
                 "oxidised", "reducing", "nh3", "lux", "proximity", *PM_ORDER]


def xavg(c: str) -> str:
    """Plain mean to six decimals (a double mean's last bits depend on the order of its sums)."""
    return f"(round(avg(CAST({c} AS DOUBLE)), 6) + 0{D})"


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


READINGS_CTES = (RAW_READINGS, ASSEMBLED, SEQUENCED)


def readings_sql(body: str) -> str:
    return with_ctes(*READINGS_CTES, body=body)


RAW_HEALTH = f"""raw_health AS (
  SELECT {KEYS},
    CASE WHEN event_id % 17 <> 0 THEN 40000 + (event_id * 110) % 30000 END AS cpu_millideg,
    (event_id % 40) / 10{D} AS load1, (event_id % 30) / 10{D} AS load5, (event_id % 20) / 10{D} AS load15,
    CAST(CASE WHEN event_id % 29 = 0 THEN 0 ELSE 512000 END AS BIGINT) AS mem_total_kb,
    CASE WHEN event_id % 31 <> 0 THEN (event_id * 997) % 512000 END AS mem_available_kb,
    CAST(CASE WHEN event_id % 37 = 0 THEN 0 ELSE 16000000000 END AS BIGINT) AS disk_total_b,
    CAST(CASE WHEN event_id % 37 = 0 THEN 0 ELSE (event_id * 7919) % 16000000000 END AS BIGINT) AS disk_free_b,
    CAST(event_id % 90 AS VARCHAR) || '.' AS wifi_quality_s,
    {_cycle('event_id % 3', ["'-' || CAST(event_id % 90 AS VARCHAR) || '.'", "CAST(event_id % 100 AS VARCHAR) || '.'", "CAST(101 + event_id % 150 AS VARCHAR) || '.'"])} AS wifi_level_s,
    {_cycle('event_id % 4', ["'lab-net' || chr(10)", "'  '", "NULL", "'field-' || CAST(event_id % 5 AS VARCHAR)"])} AS iwgetid_s,
    {_cycle('event_id % 3', ["'10.0.' || CAST(event_id % 256 AS VARCHAR) || '.' || CAST(event_id % 7 + 1 AS VARCHAR) || ' fe80::1' || chr(10)", "' '", "NULL"])} AS hostname_s,
    {_cycle('event_id % 5', ["'+' || CAST(event_id % 300 AS VARCHAR) || 'ms'", "'-1s'", "'+12us'", "'n/a'", "NULL"])} AS timesync_s,
    {_cycle('event_id % 3', ["'yes'", "' No '", "NULL"])} AS ntpsync_s,
    CASE WHEN event_id % 7 = 0 THEN '0.000123' END AS chrony_s,
    CASE WHEN event_id % 11 = 0 THEN '1.5' END AS ntpq_s,
    CAST(CASE WHEN event_id % 13 = 0 THEN 0 ELSE 3900000000 + event_id END AS BIGINT) AS ntp_orig_i,
    (event_id * 7919) % 4294967296 AS ntp_orig_f,
    3900000000 + event_id AS ntp_recv_i, (event_id * 104729) % 4294967296 AS ntp_recv_f,
    3900000000 + event_id AS ntp_tx_i, (event_id * 1299709) % 4294967296 AS ntp_tx_f,
    3900000000 + event_id + (event_id % 50) / 100{D} AS ntp_dest,
    'volt=0.8312V' AS volt_s,
    CASE WHEN event_id % 6 <> 5 THEN 'throttled=' || {_cycle('event_id % 6', ["'0x0'", "'0x1'", "'0x50000'", "'0x50005'", "'zz'"])} END AS throttled_s,
    CAST((event_id % 400) * 5 AS DOUBLE) AS uptime_seconds
  FROM events)"""


def _hy(h: str) -> str:
    return (f"substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || "
            f"substr({h},17,4) || '-' || substr({h},21,12)")


STATION_IDS = f"""station_ids AS (
  SELECT event_id, {_cycle('event_id % 8', [_hy('h'), 'upper(h)', "'{' || " + _hy('h') + " || '}'",
                                              "'urn:uuid:' || " + _hy('h'), 'substr(h, 1, 31)',
                                              "'g' || substr(h, 2, 31)", "'0x' || substr(h, 1, 30)", "''"])} AS raw_id
  FROM (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events))"""


def _readings_sql() -> dict[str, str]:
    R = readings_sql
    pm = ", ".join(PM_ORDER)
    floats = ", ".join(SENSOR_FLOATS)
    canon = ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in SENSOR_FLOATS)
    nid = ("replace(regexp_replace(replace(replace(raw_id, 'urn:', ''), 'uuid:', ''), "
           "'^[{}]+|[{}]+$', '', 'g'), '-', '')")
    valid = (f"COALESCE(length({nid}) = 32 AND regexp_matches({nid}, "
             r"'^\s*[+-]?(?:0[xX]_?)?[0-9a-fA-F](?:_?[0-9a-fA-F])*\s*$'), false)")
    digits = f"lower(lpad(regexp_replace(regexp_replace({nid}, '^\\s*\\+?(0[xX])?', ''), '[_\\s]', '', 'g'), 32, '0'))"
    return {
        "assemble_reading": R(f"SELECT station, event_id, timestamp, bme_ok, raw_temperature, raw_humidity, "
                              f"pressure, oxidised, reducing, nh3, lux, proximity, {pm} FROM assembled"),
        "gas_resistance": with_ctes(RAW_READINGS, body=(
            f"SELECT event_id, ox_v, red_v, nh3_v, {gas('ox_v')} AS oxidised, {gas('red_v')} AS reducing, "
            f"{gas('nh3_v')} AS nh3 FROM raw_readings")),
        "cpu_temperature": with_ctes(RAW_HEALTH, body=(
            f"SELECT event_id, cpu_millideg / 1000{D} AS cpu_temp_c, "
            f"COALESCE(cpu_millideg / 1000{D}, 40{D}) AS cpu_temp_for_compensation FROM raw_health")),
        "rolling_cpu_avg": R("SELECT station, boot_id, event_id, bme_ok, cpu_avg FROM sequenced"),
        "compensate_temperature": R("SELECT station, event_id, raw_temperature, temperature FROM corrected_all"),
        "compensate_humidity": R("SELECT station, event_id, raw_humidity, temperature, humidity FROM corrected_all"),
        "dewpoint": R("SELECT event_id, raw_temperature - ((100 - rh_read) / 5) AS dewpoint FROM assembled"),
        "canonical_dtypes": R(f"SELECT station, event_id, date_trunc('millisecond', timestamp) AS timestamp, "
                              f"{canon} FROM corrected"),
        "valid_station_id": with_ctes(STATION_IDS, body=(
            f"SELECT event_id, raw_id, {valid} AS valid, CASE WHEN {valid} THEN "
            f"{_hy(digits)} END AS station_id FROM station_ids")),
        "station_quarantine": with_ctes(STATION_IDS, body=(
            f"SELECT event_id, CASE WHEN {valid} THEN {_hy(digits)} ELSE raw_id END AS station, NOT {valid} AS quarantined "
            "FROM station_ids")),
        "next_boundary": with_ctes(RAW_READINGS, body=(
            f"SELECT event_id, timestamp, {boundary('timestamp', 15)} AS nb_15, "
            f"{boundary('timestamp', 25)} AS nb_25, {boundary('timestamp', 120)} AS nb_120 FROM raw_readings")),
        "skip_warmup": R("SELECT station, boot_id, event_id, timestamp, rn AS seq_rn FROM corrected"),
        "health_sample": R("SELECT station, boot_id, event_id, rn AS seq_rn FROM corrected WHERE health_sample"),
        "boot_sessions": with_ctes(RAW_READINGS, body="""
            SELECT station, event_id, timestamp,
              CAST(sum(CASE WHEN prev IS NULL OR epoch_us(timestamp) - epoch_us(prev) > 5400000000 THEN 1 ELSE 0 END)
                OVER (PARTITION BY station ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id
            FROM (SELECT station, event_id, timestamp,
                    lag(timestamp) OVER (PARTITION BY station ORDER BY timestamp, event_id) AS prev
                  FROM raw_readings)"""),
        "batch_assign_event_time": R(f"SELECT station, event_id, timestamp, {boundary('timestamp', 15)} AS batch_end FROM corrected"),
        "batch_assign_as_collected": R("SELECT station, boot_id, event_id, timestamp, batch_end FROM corrected"),
        "batch_partition_values": R("""
            SELECT station, boot_id, batch_end, strftime(min(timestamp), '%Y') AS year,
              strftime(min(timestamp), '%m') AS month, strftime(min(timestamp), '%d') AS day,
              'data_' || strftime(max(timestamp), '%H%M') AS file_label
            FROM corrected GROUP BY station, boot_id, batch_end"""),
        "batch_partition_values_health": R("""
            SELECT station, boot_id, batch_end, strftime(min(timestamp) FILTER (WHERE health_sample), '%Y') AS year,
              strftime(min(timestamp) FILTER (WHERE health_sample), '%m') AS month, strftime(min(timestamp) FILTER (WHERE health_sample), '%d') AS day,
              'health_' || strftime(max(timestamp), '%H%M') AS file_label
            FROM corrected GROUP BY station, boot_id, batch_end HAVING count(*) FILTER (WHERE health_sample) > 0"""),
        "uncompensated_readings": R("""
            SELECT station, boot_id, event_id, timestamp, raw_temperature AS temperature, raw_humidity AS humidity, batch_end FROM corrected"""),
        "batch_stats": R("""
            SELECT station, boot_id, batch_end, count(*) AS n_readings, min(timestamp) AS first_ts,
              max(timestamp) AS last_ts,
              CASE WHEN epoch_us(max(timestamp)) - epoch_us(min(timestamp)) > 0
                THEN count(*) / ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6::DOUBLE)
                ELSE 0::DOUBLE END AS readings_per_s
            FROM corrected GROUP BY station, boot_id, batch_end"""),
        "batch_retry_stats": with_ctes(*READINGS_CTES, """batches AS (
              SELECT DISTINCT station, boot_id, batch_end, (epoch_us(batch_end) // 900000000 + boot_id) % 5 < 3 AS lost FROM corrected),
            written AS (
              SELECT station, boot_id, batch_end, min(CASE WHEN NOT lost THEN batch_end END) OVER (
                PARTITION BY station, boot_id ORDER BY batch_end ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS flush_end
              FROM batches)""", body="""
            SELECT station, boot_id, flush_end, count(*) AS n_readings, min(timestamp) AS first_ts, max(timestamp) AS last_ts,
              CASE WHEN epoch_us(max(timestamp)) - epoch_us(min(timestamp)) > 0
                THEN count(*) / ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6::DOUBLE)
                ELSE 0::DOUBLE END AS readings_per_s
            FROM corrected JOIN written USING (station, boot_id, batch_end) GROUP BY station, boot_id, flush_end"""),
        "boot_sessions_uptime": with_ctes(f"""records AS (
              SELECT {KEYS}, (event_id % 400) * 5{D} AS uptime FROM events),
            firsts AS (
              SELECT DISTINCT station, make_timestamp(epoch_us(timestamp) - CAST(round(uptime * 1000000) AS BIGINT)) AS boot_start FROM (
                SELECT *, lag(uptime) OVER (PARTITION BY station ORDER BY timestamp, event_id) AS before FROM records)
              WHERE before IS NULL OR uptime < before),
            boots AS (SELECT station, boot_start, row_number() OVER (PARTITION BY station ORDER BY boot_start) AS boot_no FROM firsts)""", body="""
            SELECT r.station, r.event_id, r.timestamp, max(b.boot_start) AS boot_start, max(b.boot_no) AS boot_no
            FROM records r LEFT JOIN boots b ON r.station = b.station AND b.boot_start <= r.timestamp
            GROUP BY r.station, r.event_id, r.timestamp"""),
        "empty_batches": with_ctes(*READINGS_CTES, f"""have AS (
              SELECT DISTINCT station, {boundary('timestamp', 15)} AS batch_end FROM corrected),
            span AS (SELECT station, min(batch_end) AS lo, max(batch_end) AS hi FROM have GROUP BY station),
            grid AS (SELECT station, unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS batch_end FROM span)""",
            body="""SELECT station, batch_end FROM grid
            WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.station = grid.station AND h.batch_end = grid.batch_end)"""),
        "dedupe_readings": R(f"""
            SELECT DISTINCT station, boot_id, event_id, timestamp, {floats} FROM corrected"""),
    }


def oracle_statements() -> dict[str, str]:
    out = dict(_readings_sql())
    for name in ("_health_sql", "_sync_sql", "_lake_sql", "_stream_sql"):
        f = globals().get(name)
        if f:
            out.update(f())
    return out


PYFLOAT_RE = (r"^[+-]?(?:(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?"
              r"|(?i:inf|infinity|nan))$")
HEX_RE = r"^[+-]?(?:0[xX]_?)?[0-9a-fA-F](?:_?[0-9a-fA-F])*$"


def trimws(s: str) -> str:
    return rf"regexp_replace({s}, '^\s+|\s+$', '', 'g')"


def pyfloat(s: str) -> str:
    t = trimws(s)
    return f"(CASE WHEN regexp_matches({t}, '{PYFLOAT_RE}') THEN TRY_CAST(replace({t}, '_', '') AS DOUBLE) END)"


RAW_POWER = """raw_power AS (
  SELECT station, boot_id, event_id, timestamp, CAST(supply_seq AS INTEGER) AS supply_seq,
    CASE WHEN supply_seq = 0 THEN 'Battery' ELSE 'Mains' END AS supply_type,
    CASE WHEN supply_seq = 0 THEN CAST(event_id % 101 AS VARCHAR) || chr(10) END AS capacity_s,
    CASE WHEN supply_seq = 0 THEN """ + _cycle("event_id % 4", ["'Discharging'", "'Charging'", "'Full'", "'Unknown'"]) + """ END AS status_s,
    CASE WHEN supply_seq = 1 THEN (CASE WHEN event_id % 3 = 0 THEN '1' ELSE '0' END) || chr(10) END AS online_s
  FROM (SELECT """ + KEYS + """, unnest([0, 1]) AS supply_seq FROM events))"""


def _power_cte() -> str:
    t = f"lower({trimws('supply_type')})"
    st = f"lower({trimws('status_s')})"
    cap = pyfloat("capacity_s")
    return f"""power AS (
  SELECT station, event_id,
    arg_max(ps, supply_seq) FILTER (WHERE ps IS NOT NULL) AS power_source,
    arg_max(bp, supply_seq) FILTER (WHERE bp IS NOT NULL) AS battery_percent
  FROM (SELECT station, event_id, supply_seq,
          CASE WHEN capacity_s IS NOT NULL AND {cap} IS NULL THEN NULL
               WHEN {t} = 'battery' THEN (CASE WHEN {st} = 'discharging' THEN 'battery'
                                               WHEN {st} IN ('charging', 'full') THEN 'mains' END)
               WHEN {t} = 'mains' THEN (CASE WHEN {trimws('online_s')} = '1' THEN 'mains' END) END AS ps,
          CASE WHEN {t} = 'battery' THEN {cap} END AS bp
        FROM raw_power)
  GROUP BY station, event_id)"""


def _health_exprs() -> dict[str, str]:
    q = pyfloat("regexp_replace(wifi_quality_s, '[.]+$', '')")
    s = pyfloat("regexp_replace(wifi_level_s, '[.]+$', '')")
    pct = f"(({q} / 70) * 100)"
    tot, av = "COALESCE(mem_total_kb, 0)", "COALESCE(mem_available_kb, 0)"
    ts = "timesync_s"
    packet = (f"((((ntp_recv_i + ntp_recv_f / 4294967296{D}) - (ntp_orig_i + ntp_orig_f / 4294967296{D})) "
              f"+ ((ntp_tx_i + ntp_tx_f / 4294967296{D}) - ntp_dest)) / 2) * 1000")
    timesync = (f"(CASE WHEN ends_with({ts}, 'ms') THEN {pyfloat(f'left({ts}, length({ts}) - 2)')} "
                f"WHEN ends_with({ts}, 's') THEN {pyfloat(f'left({ts}, length({ts}) - 1)')} * 1000 END)")
    volt = trimws("volt_s")
    thr_s = trimws("throttled_s")
    thr = f"(CASE WHEN starts_with({thr_s}, 'throttled=') THEN split_part({thr_s}, '=', 2) END)"
    ssid = trimws("iwgetid_s")
    hexv = trimws(thr)
    under = (f"COALESCE({thr} <> '0x0' AND (CASE WHEN regexp_matches({hexv}, '{HEX_RE}') "
             f"THEN regexp_matches(right({hexv}, 1), '^[13579bdfBDF]$') END), false)")
    return {
        "cpu_temp_c": f"cpu_millideg / 1000{D}",
        "cpu_load_1min": "load1", "cpu_load_5min": "load5", "cpu_load_15min": "load15",
        "memory_total_mb": f"CASE WHEN {tot} > 0 THEN {tot} / 1024 END",
        "memory_available_mb": f"CASE WHEN {tot} > 0 THEN {av} / 1024 END",
        "memory_percent_used": f"CASE WHEN {tot} > 0 THEN (({tot} - {av}) / {tot}) * 100 END",
        "disk_total_gb": "disk_total_b / 1073741824",
        "disk_free_gb": "disk_free_b / 1073741824",
        "disk_percent_used": ("CASE WHEN disk_total_b > 0 THEN ((disk_total_b - disk_free_b) / disk_total_b) * 100 "
                              f"WHEN disk_total_b IS NOT NULL AND disk_free_b IS NOT NULL THEN 0{D} END"),
        "wifi_ssid": f"CASE WHEN {ssid} <> '' THEN {ssid} END",
        "wifi_signal_dbm": (f"CASE WHEN {q} IS NOT NULL AND {s} IS NOT NULL THEN CAST(trunc(CASE WHEN {s} > 100 "
                            f"THEN {s} - 256 WHEN {s} > 0 THEN {s} - 100 ELSE {s} END) AS BIGINT) END"),
        "wifi_quality_percent": (f"CASE WHEN {q} IS NOT NULL AND {s} IS NOT NULL THEN "
                                 f"(CASE WHEN {pct} > 100 THEN 100{D} ELSE {pct} END) END"),
        "ip_address": r"NULLIF(regexp_extract(hostname_s, '^\s*(\S+)', 1), '')",
        "clock_synced": (f"CASE WHEN timesync_s IS NOT NULL THEN true WHEN ntpsync_s IS NOT NULL THEN "
                         f"lower({trimws('ntpsync_s')}) = 'yes' END"),
        "ntp_offset_ms": f"COALESCE({timesync}, {pyfloat('chrony_s')} * 1000, {pyfloat('ntpq_s')}, {packet})",
        "ntp_packet_ms": packet,
        "timesync_ms": timesync,
        "uptime_seconds": "uptime_seconds",
        "cpu_voltage_v": (f"CASE WHEN starts_with({volt}, 'volt=') AND ends_with({volt}, 'V') THEN "
                          f"{pyfloat(f'substr({volt}, 6, length({volt}) - 6)')} END"),
        "throttled_hex": thr,
        "under_voltage": under,
    }


HEALTH_ORDER = ["timestamp", "cpu_temp_c", "cpu_load_1min", "cpu_load_5min", "cpu_load_15min",
                "memory_total_mb", "memory_available_mb", "memory_percent_used", "disk_total_gb",
                "disk_free_gb", "disk_percent_used", "wifi_ssid", "wifi_signal_dbm",
                "wifi_quality_percent", "ip_address", "clock_synced", "ntp_offset_ms", "uptime_seconds",
                "power_source", "battery_percent", "cpu_voltage_v", "throttled_hex"]


def normalized_health_ctes() -> tuple[str, ...]:
    x = _health_exprs()
    sel = ",\n    ".join(f"{x[c]} AS {c}" for c in HEALTH_ORDER
                         if c not in ("timestamp", "power_source", "battery_percent"))
    norm = f"""normalized AS (
  SELECT h.station, h.event_id, h.boot_id, h.timestamp, {sel},
    CASE WHEN {x['under_voltage']} THEN 'under-voltage' ELSE p.power_source END AS power_source,
    p.battery_percent
  FROM raw_health h LEFT JOIN power p ON h.station = p.station AND h.event_id = p.event_id)"""
    return (RAW_HEALTH, RAW_POWER, _power_cte(), norm)


def _health_sql() -> dict[str, str]:
    x = _health_exprs()
    H = lambda cols: with_ctes(RAW_HEALTH, body=(
        "SELECT station, event_id, " + ", ".join(f"{x[c]} AS {c}" for c in cols) + " FROM raw_health"))
    metrics = [c for c in HEALTH_ORDER if c != "timestamp"]
    avail = " UNION ALL ".join(
        f"SELECT station, '{m}' AS metric, count({m}) AS available, count(*) - count({m}) AS unavailable "
        f"FROM normalized GROUP BY station" for m in metrics)
    return {
        "health_memory": H(["memory_total_mb", "memory_available_mb", "memory_percent_used"]),
        "health_disk": H(["disk_total_gb", "disk_free_gb", "disk_percent_used"]),
        "health_wifi": H(["wifi_ssid", "wifi_signal_dbm", "wifi_quality_percent", "ip_address"]),
        "health_ntp_packet": H(["ntp_packet_ms"]),
        "health_ntp_offset": H(["ntp_offset_ms"]),
        "health_clock_synced": H(["clock_synced"]),
        "health_power": with_ctes(RAW_POWER, _power_cte(), body="SELECT station, event_id, power_source, battery_percent FROM power"),
        "health_throttled": H(["throttled_hex", "under_voltage"]),
        "health_voltage": H(["cpu_voltage_v", "throttled_hex"]),
        "normalize_health": with_ctes(*normalized_health_ctes(), body="SELECT station, " + ", ".join(HEALTH_ORDER) + " FROM normalized"),
        "metric_availability": with_ctes(*normalized_health_ctes(), body=avail),
    }


def _doc_path() -> str:
    st = "'station=st-' || CAST(doc_id AS VARCHAR)"
    ymd = ("'/year=2024/month=' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '/day=' || "
           "lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')")
    hhmm = "lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || lpad(CAST((doc_id % 4) * 15 AS VARCHAR), 2, '0')"
    return _cycle("doc_id % 6", [
        f"{st} || {ymd} || '/data_' || {hhmm} || '.parquet'",
        f"{st} || {ymd} || '/health_' || {hhmm} || '.parquet'",
        f"{st} || '/year=2024/notes_' || CAST(doc_id AS VARCHAR) || '.parquet'",
        "'.cache/uv/st-' || CAST(doc_id AS VARCHAR) || '/pyarrow/tests/data.parquet'",
        f"'output/' || {st} || '/year=2024/month=01/day=01/data_0000.parquet'",
        "'st-' || CAST(doc_id AS VARCHAR) || '.parquet'",
    ])


MANIFESTS = f"""local_files AS (
  SELECT {_doc_path()} AS path, CAST(strlen(text) AS BIGINT) AS size,
    make_timestamp((1706745600 + doc_id) * 1000000) AS last_modified,
    '"' || md5(text) || '"' AS e_tag
  FROM documents),
remote_files AS (
  SELECT {_doc_path()} AS path,
    CAST(CASE WHEN doc_id % 11 = 0 THEN strlen(text) + 1 ELSE strlen(text) END AS BIGINT) AS size,
    make_timestamp((1704067200 + doc_id) * 1000000) AS last_modified,
    CASE WHEN doc_id % 7 = 0 THEN '"0"' WHEN doc_id % 13 = 0 THEN NULL ELSE '"' || md5(text) || '"' END AS e_tag
  FROM documents WHERE doc_id % 5 <> 0)"""

LAID_OUT = f"""laid_out AS (
  SELECT doc_id, {_doc_path()} AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size,
    '"' || md5(coalesce(text, '')) || '"' AS e_tag
  FROM documents)"""

EXACT_RE = r"^station=[^/]+/year=\d{4}/month=\d{2}/day=\d{2}/(?:data|health)_\d{4}\.parquet$"
SUS_RE = [r"\.cache/", r"\.local/", r"site-packages/", r"pyarrow/tests/", r"__pycache__/", r"\.venv/",
          r"venv/", r"output/"]


def path_class(p: str) -> str:
    sus = " OR ".join(f"regexp_matches({p}, '{r}')" for r in SUS_RE)
    return (f"CASE WHEN regexp_matches({p}, '{EXACT_RE}') THEN 'exact' WHEN {sus} THEN 'suspicious' "
            f"WHEN starts_with({p}, 'station=') AND contains({p}, '/year=') THEN 'fallback' ELSE 'other' END")


DECISION = f"""decision AS (
  SELECT l.path, l.size, l.last_modified, l.e_tag,
    CASE WHEN r.path IS NULL THEN 'new' WHEN l.size <> r.size THEN 'size_mismatch'
         WHEN l.e_tag <> COALESCE(r.e_tag, '') THEN 'content_changed' ELSE 'skip' END AS action
  FROM local_files l LEFT JOIN remote_files r ON l.path = r.path
  WHERE {path_class('l.path')} IN ('exact', 'fallback'))"""


def _sync_sql() -> dict[str, str]:
    st = r"NULLIF(regexp_extract(path, '(?:^|/)station=([^/]+)/', 1), '')"
    day = (r"CASE WHEN regexp_extract(path, 'year=(\d{4})/month=(\d{2})/day=(\d{2})/', 0) <> '' THEN "
           r"regexp_extract(path, 'year=(\d{4})/', 1) || '-' || regexp_extract(path, 'month=(\d{2})/', 1) "
           r"|| '-' || regexp_extract(path, 'day=(\d{2})/', 1) END")
    return {
        "partition_path_class": with_ctes(MANIFESTS, body=f"SELECT path, {path_class('path')} AS path_class FROM local_files"),
        "content_etag": """SELECT doc_id, '"' || md5(text) || '"' AS e_tag FROM documents""",
        "sync_decision": with_ctes(MANIFESTS, DECISION, body="SELECT path, size, action FROM decision"),
        "list_objects": with_ctes(MANIFESTS, body="SELECT path, size, last_modified, e_tag FROM remote_files WHERE starts_with(path, 'station=')"),
        "manifest_after_sync": with_ctes(MANIFESTS, DECISION, body="""
            SELECT COALESCE(u.path, r.path) AS path,
              CASE WHEN u.path IS NOT NULL THEN u.size ELSE r.size END AS size,
              CASE WHEN u.path IS NOT NULL THEN u.last_modified ELSE r.last_modified END AS last_modified,
              CASE WHEN u.path IS NOT NULL THEN u.e_tag ELSE r.e_tag END AS e_tag
            FROM remote_files r FULL OUTER JOIN (SELECT * FROM decision WHERE action <> 'skip') u ON r.path = u.path"""),
        "sync_summary": with_ctes(MANIFESTS, DECISION, body="""
            SELECT action, action <> 'skip' AS synced, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
            FROM decision GROUP BY action"""),
        "list_local": with_ctes(LAID_OUT, body="SELECT path, size FROM laid_out WHERE NOT starts_with(path, '.cache/')"),
        "replicate_files": with_ctes(LAID_OUT, body=f"""
            SELECT path, action, CASE WHEN action = 'skip' THEN 0 ELSE size END AS bytes, e_tag FROM (
              SELECT path, size, e_tag, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 11 = 0 THEN 'size_mismatch'
                WHEN doc_id % 7 = 0 AND size > 0 THEN 'content_changed' ELSE 'skip' END AS action
              FROM laid_out WHERE {path_class('path')} IN ('exact', 'fallback'))"""),
        "storage_stats": with_ctes(MANIFESTS, body=f"""
            SELECT station, day, count(*) AS files, sum(size) / 1048576 AS total_mb,
              grouping_id(station, day) AS level
            FROM (SELECT {st} AS station, {day} AS day, size FROM local_files)
            GROUP BY ROLLUP (station, day)"""),
    }


LAKE_READINGS = """lake_readings AS (
  SELECT station,
    CAST(strftime(min(timestamp) OVER b, '%Y') AS INTEGER) AS year,
    CAST(strftime(min(timestamp) OVER b, '%m') AS INTEGER) AS month,
    CAST(strftime(min(timestamp) OVER b, '%d') AS INTEGER) AS day,
    date_trunc('millisecond', timestamp) AS timestamp, """ + ", ".join(
    f"CAST({c} AS FLOAT) AS {c}" for c in SENSOR_FLOATS) + """
  FROM corrected WINDOW b AS (PARTITION BY station, boot_id, batch_end))"""


def _lake_health_ctes() -> tuple[str, ...]:
    cols = ", ".join(c for c in HEALTH_ORDER if c != "timestamp")
    lake = f"""lake_health AS (
  SELECT n.station,
    CAST(strftime(min(n.timestamp) OVER b, '%Y') AS INTEGER) AS year,
    CAST(strftime(min(n.timestamp) OVER b, '%m') AS INTEGER) AS month,
    CAST(strftime(min(n.timestamp) OVER b, '%d') AS INTEGER) AS day,
    date_trunc('millisecond', n.timestamp) AS timestamp, {cols}
  FROM normalized n JOIN corrected c ON n.station = c.station AND n.event_id = c.event_id
  WHERE c.health_sample
  WINDOW b AS (PARTITION BY n.station, c.boot_id, c.batch_end))"""
    return (*READINGS_CTES, *normalized_health_ctes(), lake)


def _lake_sql() -> dict[str, str]:
    floats = ", ".join(SENSOR_FLOATS)
    hcols = ", ".join(HEALTH_ORDER)
    LH = lambda body: with_ctes(*_lake_health_ctes(), body=body)
    return {
        "scan_readings": with_ctes(*READINGS_CTES, LAKE_READINGS, body=f"SELECT station, year, month, day, timestamp, {floats} FROM lake_readings"),
        "write_readings": with_ctes(*READINGS_CTES, LAKE_READINGS, body="SELECT station, year, month, day, count(*) AS n_rows FROM lake_readings GROUP BY ALL"),
        "scan_health": LH(f"SELECT station, year, month, day, {hcols} FROM lake_health"),
        "scan_health_drift": LH(f"SELECT station, year, month, day, {hcols} FROM lake_health"),
        "write_health": LH("SELECT station, year, month, day, count(*) AS n_rows FROM lake_health GROUP BY ALL"),
        "q_time_range": with_ctes(*READINGS_CTES, LAKE_READINGS, body="""
            SELECT timestamp, temperature, humidity, pm25 FROM lake_readings
            WHERE year = 2024 AND month = 1 AND day = 15 AND station = 'st-03'"""),
        "q_hourly_station_avg": with_ctes(*READINGS_CTES, LAKE_READINGS, body=f"""
            SELECT station, date_trunc('hour', timestamp) AS hour, {xavg('temperature')} AS avg_temp,
              {xavg('humidity')} AS avg_humidity, {xavg('pm25')} AS avg_pm25
            FROM lake_readings WHERE year = 2024 AND month = 1
            GROUP BY station, hour ORDER BY hour, station"""),
        "q_clock_drift_alerts": LH("""
            SELECT station, timestamp, clock_synced, ntp_offset_ms, wifi_signal_dbm FROM lake_health
            WHERE NOT clock_synced OR ntp_offset_ms > 100 ORDER BY timestamp DESC"""),
        "q_memory_pressure": LH(f"""
            SELECT station, date_trunc('hour', timestamp) AS hour, {xavg('memory_percent_used')} AS avg_mem,
              max(memory_percent_used) AS max_mem
            FROM lake_health GROUP BY station, hour HAVING avg(memory_percent_used) > 80"""),
    }


ROW_LAKE = """row_lake AS (
  SELECT station, CAST(year(timestamp) AS INTEGER) AS year, CAST(month(timestamp) AS INTEGER) AS month,
    CAST(day(timestamp) AS INTEGER) AS day,
    date_trunc('millisecond', timestamp) AS timestamp, """ + ", ".join(
    f"CAST({c} AS FLOAT) AS {c}" for c in SENSOR_FLOATS) + """
  FROM corrected)"""


def _stream_sql() -> dict[str, str]:
    floats = ", ".join(SENSOR_FLOATS)
    raw_cols = ("station, boot_id, event_id, timestamp, raw_temperature, raw_humidity, pressure, cpu_temp_c, "
                "ox_v, red_v, nh3_v, lux, proximity, " + ", ".join(PM_ORDER))
    lake = f"SELECT station, year, month, day, timestamp, {floats} FROM row_lake"
    return {
        "stream_readings": with_ctes(RAW_READINGS, body=f"SELECT {raw_cols} FROM raw_readings"),
        "stream_compensate": readings_sql(f"SELECT station, boot_id, event_id, timestamp, {floats}, rn AS seq_rn, batch_end FROM corrected"),
        "stream_flush": with_ctes(*READINGS_CTES, ROW_LAKE, body=lake),
        "stream_final_flush": with_ctes(*READINGS_CTES, ROW_LAKE, body=lake),
        "stream_flush_batch_layout": with_ctes(*READINGS_CTES, LAKE_READINGS, body=(
            f"SELECT station, year, month, day, timestamp, {floats} FROM lake_readings")),
        "stream_hourly_avg": readings_sql(f"""
            SELECT station, date_trunc('hour', timestamp) AS hour, {xavg('temperature')} AS avg_temp,
              {xavg('humidity')} AS avg_humidity, {xavg('pm25')} AS avg_pm25, count(*) AS n_readings
            FROM corrected GROUP BY station, hour"""),
        "stream_batch_counts": readings_sql(f"""
            SELECT station, {boundary('timestamp', 15)} AS batch_end, count(*) AS n_readings, min(timestamp) AS first_ts,
              max(timestamp) AS last_ts,
              CASE WHEN epoch_us(max(timestamp)) - epoch_us(min(timestamp)) > 0
                THEN count(*) / ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6::DOUBLE)
                ELSE 0::DOUBLE END AS readings_per_s
            FROM corrected GROUP BY station, {boundary('timestamp', 15)}"""),
        "stream_dedupe": readings_sql(f"SELECT DISTINCT station, boot_id, event_id, timestamp, {floats} FROM corrected"),
    }

"""Health metric normalisation from raw OS-probe values (column expressions).

Each function maps raw probe output columns to the values the reference's health
probes would return. Inputs are the columns of a ``raw_health`` table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from envlake.functions.parse import first_token, py_float, py_hex_bit0, py_strip, rstrip_chars

_KB_PER_MB = 1024
_B_PER_GB = 1024 ** 3
_NTP_FRAC = 4294967296.0  # 2**32


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def memory(total_kb, available_kb) -> dict[str, Column]:
    """MB and percent used; total <= 0 (or missing) gives all NULL; missing available is 0."""
    tot = F.coalesce(_c(total_kb), F.lit(0))
    avail = F.coalesce(_c(available_kb), F.lit(0))
    ok = tot > 0
    return {
        "memory_total_mb": F.when(ok, tot / _KB_PER_MB),
        "memory_available_mb": F.when(ok, avail / _KB_PER_MB),
        "memory_percent_used": F.when(ok, ((tot - avail) / tot) * 100),
    }


def disk(total_b, free_b) -> dict[str, Column]:
    """GB and percent used; a zero-sized file system gives 0 percent."""
    tot, free = _c(total_b), _c(free_b)
    return {
        "disk_total_gb": tot / _B_PER_GB,
        "disk_free_gb": free / _B_PER_GB,
        "disk_percent_used": F.when(tot > 0, ((tot - free) / F.nullif(tot, F.lit(0))) * 100)
                              .when(tot.isNotNull() & free.isNotNull(), F.lit(0.0)),
    }


def wifi_levels(quality_s, level_s) -> dict[str, Column]:
    """Parse stage of :func:`wifi`: the two numbers of ``/proc/net/wireless`` ("45." style)."""
    return {"wifi_q": py_float(rstrip_chars(quality_s, ".")),
            "wifi_level": py_float(rstrip_chars(level_s, "."))}


def wifi_from_levels(q, s) -> dict[str, Column]:
    """Signal dBm and quality percent from parsed quality ``q`` and level ``s``.

    Both values need both fields to parse. A positive level is an old 0..100 / 0..255
    scale: > 100 -> level - 256, else level - 100; the result is truncated to an integer.
    Quality is out of 70, capped at 100.
    """
    q, s = _c(q), _c(s)
    ok = q.isNotNull() & s.isNotNull()
    dbm = (F.when(s > 100, s - 256).when(s > 0, s - 100).otherwise(s))
    pct = (q / 70) * 100
    return {
        "wifi_signal_dbm": F.when(ok, dbm.try_cast("long")),
        "wifi_quality_percent": F.when(ok, F.when(pct > 100, F.lit(100.0)).otherwise(pct)),
    }


def wifi(quality_s, level_s) -> dict[str, Column]:
    """Single-expression form of ``wifi_from_levels(**wifi_levels(...))``. Operators over
    many rows stage the parse first (see ``envlake.operators.health``)."""
    lv = wifi_levels(quality_s, level_s)
    return wifi_from_levels(lv["wifi_q"], lv["wifi_level"])


def wifi_ssid(iwgetid_out) -> Column:
    """``stdout.strip() or None``."""
    s = py_strip(iwgetid_out)
    return F.when(s != "", s)


def ip_address(hostname_out) -> Column:
    """First address printed by ``hostname -I``."""
    return first_token(hostname_out)


def timesync_offset_ms(offset_token) -> Column:
    """Offset token of ``timedatectl timesync-status``: ``ms`` kept, ``s`` x1000.

    A ``us`` token never parses: it ends with ``s`` and ``float('12u')`` fails.
    """
    t = _c(offset_token)
    ms = t.endswith("ms")
    sec = ~ms & t.endswith("s")
    body_ms = F.substring(t, F.lit(1), F.length(t) - 2)
    body_s = F.substring(t, F.lit(1), F.length(t) - 1)
    return F.when(ms, py_float(body_ms)).when(sec, py_float(body_s) * 1000)


def ntp_packet_offset_ms(orig_i, orig_f, recv_i, recv_f, tx_i, tx_f, dest) -> Column:
    """``((recv - orig) + (tx - dest)) / 2`` in ms from 32.32 NTP words."""
    orig = _c(orig_i) + _c(orig_f) / _NTP_FRAC
    recv = _c(recv_i) + _c(recv_f) / _NTP_FRAC
    tx = _c(tx_i) + _c(tx_f) / _NTP_FRAC
    return (((recv - orig) + (tx - _c(dest))) / 2) * 1000


def ntp_offset_ms(timesync_s, chrony_s, ntpq_s, packet_ms) -> Column:
    """First available of timesyncd, chrony (s -> ms), ntpq (ms), NTP packet."""
    return F.coalesce(timesync_offset_ms(timesync_s), py_float(chrony_s) * 1000,
                      py_float(ntpq_s), _c(packet_ms))


def answered_timesync(timesync_s, timesync_exit) -> Column:
    """The Offset value of a timesync-status that ended with another exit status than 0 doesn't count."""
    return F.when(_c(timesync_exit).isNull() | (_c(timesync_exit) == 0), _c(timesync_s))


def clock_synced(timesync_s, ntpsync_s, timesync_exit=None) -> Column:
    """timesync-status answered -> True; else ``NTPSynchronized == yes``; else NULL. It answered if its exit
    status is 0, with an Offset line or without; where no status is known, if there is an Offset line."""
    ns = _c(ntpsync_s)
    answered = _c(timesync_s).isNotNull()
    if timesync_exit is not None:
        answered = F.coalesce(_c(timesync_exit) == 0, answered)
    return (F.when(answered, F.lit(True))
            .when(ns.isNotNull(), F.lower(py_strip(ns)) == "yes"))


def core_voltage(volt_out) -> Column:
    """``volt=0.8312V`` -> 0.8312 (after ``strip()``: prefix ``volt=``, suffix ``V``)."""
    s = py_strip(volt_out)
    body = F.substring(s, F.lit(6), F.length(s) - 6)
    return py_float(F.when(s.startswith("volt=") & s.endswith("V"), body))


def throttled_hex(throttled_out) -> Column:
    """``throttled=0x50005`` -> ``0x50005``: the second ``=``-separated field of the
    stripped output, when it starts with ``throttled=``."""
    s = py_strip(throttled_out)
    return F.when(s.startswith("throttled="), F.element_at(F.split(s, "="), 2))


def under_voltage(hex_col) -> Column:
    """Bit 0 of the throttled word, ignoring ``0x0`` and words that do not parse."""
    h = _c(hex_col)
    return F.coalesce((h != "0x0") & py_hex_bit0(h), F.lit(False))

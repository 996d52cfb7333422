"""Temperature / humidity compensation formulas (column arithmetic)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default compensation factor and the CPU temperature assumed when the
# thermal zone cannot be read.
DEFAULT_FACTOR = 2.25
CPU_FALLBACK_C = 40.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cpu_temperature(millideg, for_compensation: bool) -> Column:
    """Millidegrees -> degrees C. Missing is 40.0 for compensation but NULL for health."""
    t = _c(millideg) / 1000.0
    return F.coalesce(t, F.lit(CPU_FALLBACK_C)) if for_compensation else t


def compensate_temperature(raw_temp, ref_temp, factor: float = DEFAULT_FACTOR) -> Column:
    """``raw - (ref - raw) / factor``; ``ref`` is the rolling CPU mean or current CPU temp."""
    if not factor > 0:
        raise ValueError("compensation factor must be > 0")
    raw = _c(raw_temp)
    return raw - ((_c(ref_temp) - raw) / F.lit(float(factor)))


def dewpoint(raw_temp, raw_humidity) -> Column:
    """Dew point from the raw (uncorrected) readings: ``T - (100 - RH) / 5``."""
    return _c(raw_temp) - ((F.lit(100) - _c(raw_humidity)) / F.lit(5))


def compensate_humidity(raw_humidity, raw_temp, compensated_temp) -> Column:
    """``100 - 5*(T_comp - dewpoint)`` clamped to [0, 100].

    The clamp is NULL-guarded: Spark's least/greatest skip NULLs and would turn a
    missing value into 100.
    """
    h = F.lit(100) - (F.lit(5) * (_c(compensated_temp) - dewpoint(raw_temp, raw_humidity)))
    return F.when(h.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), h)))

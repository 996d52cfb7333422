"""Assemble one reading row from raw sensor-group values (partial data is kept)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlake.functions.gas import gas_resistance
from envlake.schema import PM_COLUMNS


def assemble_reading(raw: DataFrame, *, raw_temp="raw_temperature", raw_rh="raw_humidity",
                     raw_p="pressure", ox="ox_v", red="red_v", nh3="nh3_v",
                     lux="lux", prox="proximity") -> DataFrame:
    """Map raw group values to reading columns with the reference's failure semantics.

    * BME group: temperature and humidity are read first; if either is missing the whole
      group is NULL (``bme_ok`` false). A missing pressure keeps ``raw_temperature``
      (and the compensated temperature) but NULLs ``pressure``/``humidity``/``raw_humidity``.
    * Gas group: all three voltages are read before any value is stored, so one missing
      voltage NULLs all three resistances.
    * Light: lux is stored before proximity is read; a missing lux NULLs both.
    * PM: fields are stored in order until one fails; the rest are NULL.

    Output keeps every other input column and adds ``bme_ok``, ``pressure_ok``.
    """
    t, h, p = F.col(raw_temp), F.col(raw_rh), F.col(raw_p)
    bme_ok = t.isNotNull() & h.isNotNull()
    p_ok = bme_ok & p.isNotNull()
    gas_ok = F.col(ox).isNotNull() & F.col(red).isNotNull() & F.col(nh3).isNotNull()
    lux_ok = F.col(lux).isNotNull()
    cols = {
        "bme_ok": bme_ok,
        "pressure_ok": p_ok,
        "raw_temperature": F.when(bme_ok, t),
        "raw_humidity": F.when(p_ok, h),
        "pressure": F.when(p_ok, p),
        "oxidised": F.when(gas_ok, gas_resistance(ox)),
        "reducing": F.when(gas_ok, gas_resistance(red)),
        "nh3": F.when(gas_ok, gas_resistance(nh3)),
        "lux": F.when(lux_ok, F.col(lux)),
        "proximity": F.when(lux_ok, F.col(prox)),
    }
    ok = None
    for c in PM_COLUMNS:
        ok = F.col(c).isNotNull() if ok is None else (ok & F.col(c).isNotNull())
        cols[c] = F.when(ok, F.col(c))
    # raw humidity for compensation must survive a pressure failure (the reference
    # computes humidity before reading pressure), so keep it under its own name
    cols["rh_for_compensation"] = F.when(bme_ok, h)
    return raw.withColumns(cols).drop(ox, red, nh3)

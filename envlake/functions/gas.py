"""Gas sensor voltage -> resistance (MICS6814 through a 56 kOhm load at 3.3 V)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the sensor circuit.
LOAD_OHMS = 56000
REF_VOLTS = 3.3


def gas_resistance(v) -> Column:
    """Resistance in kOhm: ``V*56000/(3.3-V)/1000``; a zero denominator gives 0.0.

    V above 3.3 gives a negative resistance, as in the reference (no clamp). The
    division is never bare: ANSI mode raises on a zero divisor.
    """
    v = F.col(v) if isinstance(v, str) else v
    den = F.lit(REF_VOLTS) - v
    ohms = F.when(den == 0, F.lit(0.0)).otherwise((v * LOAD_OHMS) / F.nullif(den, F.lit(0.0)))
    return ohms / 1000.0

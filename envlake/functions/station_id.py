"""Station id validity, as Python's ``uuid.UUID(s)`` decides it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envlake.functions.parse import PY_HEX_RE


def _normalized(c) -> Column:
    s = F.col(c) if isinstance(c, str) else c
    s = F.replace(s, F.lit("urn:"), F.lit(""))
    s = F.replace(s, F.lit("uuid:"), F.lit(""))
    s = F.regexp_replace(s, r"^[{}]+|[{}]+$", "")
    return F.replace(s, F.lit("-"), F.lit(""))


def valid_station_id(c) -> Column:
    """True iff ``UUID(s)`` would accept the string (``urn:``/``uuid:``/braces/hyphens
    removed, then exactly 32 characters that ``int(x, 16)`` parses). NULL -> False."""
    n = _normalized(c)
    return F.coalesce((F.length(n) == 32) & n.rlike(r"^\s*" + PY_HEX_RE[1:-1] + r"\s*$"),
                      F.lit(False))


def canonical_station_id(c) -> Column:
    """``str(UUID(s))`` (lower-case 8-4-4-4-12) for valid ids, else NULL."""
    n = _normalized(c)
    digits = F.regexp_replace(F.regexp_replace(n, r"^\s*\+?(0[xX])?", ""), r"[_\s]", "")
    h = F.lower(F.lpad(digits, 32, "0"))
    fmt = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                      F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.when(valid_station_id(c), fmt)


def split_station_ids(df: DataFrame, column: str = "station") -> tuple[DataFrame, DataFrame]:
    """``(valid, quarantined)``: rows with a valid id, which becomes canonical, and the others
    (NULL included) as they are."""
    ok = valid_station_id(column)
    return df.where(ok).withColumn(column, canonical_station_id(column)), df.where(~ok)

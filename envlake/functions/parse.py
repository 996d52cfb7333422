"""Parsing helpers that follow Python's ``float()``/``int(s, 16)``/``str.strip()`` rules.

Spark's own casts are more permissive (Java accepts ``1.5d``), so every parse is guarded
by a regular expression and then cast with ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python float(): optional sign, digits with single underscores, optional fraction and
# exponent, or inf/infinity/nan in any case.
_DIGITS = r"\d(?:_?\d)*"
PY_FLOAT_RE = (rf"^[+-]?(?:(?:(?:{_DIGITS})?\.{_DIGITS}|{_DIGITS}\.?)(?:[eE][+-]?{_DIGITS})?"
               r"|(?i:inf|infinity|nan))$")
# Python int(s, 16): optional sign, optional 0x prefix, hex digits with single underscores.
PY_HEX_RE = r"^[+-]?(?:0[xX]_?)?[0-9a-fA-F](?:_?[0-9a-fA-F])*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_WHITESPACE = " \t\n\x0b\f\r"


def py_strip(c) -> Column:
    """``str.strip()``: remove leading/trailing whitespace (not only spaces)."""
    return F.btrim(_c(c), F.lit(_WHITESPACE))


# The same grammar with surrounding whitespace allowed, so one guard replaces strip().
PY_FLOAT_WS_RE = r"^\s*" + PY_FLOAT_RE[1:-1] + r"\s*$"


def py_float(c) -> Column:
    """``float(s)`` or NULL where Python would raise ValueError.

    The guard admits surrounding whitespace, which the cast ignores, and digit-group underscores,
    which are removed for it."""
    s = _c(c)
    return F.when(s.rlike(PY_FLOAT_WS_RE), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))


def py_hex_bit0(c) -> Column:
    """Bit 0 of ``int(s, 16)``; NULL where the parse would fail."""
    s = py_strip(c)
    return F.when(s.rlike(PY_HEX_RE), F.substring(s, -1, 1).rlike("^[13579bdfBDF]$"))


def rstrip_chars(c, chars: str) -> Column:
    """``str.rstrip(chars)`` for a set of literal characters."""
    return F.rtrim(_c(c), F.lit(chars))


def first_token(c) -> Column:
    """``s.split()[0]`` or NULL when there is no token."""
    tok = F.regexp_extract(_c(c), r"^\s*(\S+)", 1)
    return F.when(tok != "", tok)

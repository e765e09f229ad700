"""Text building blocks shared by the column functions.

The character classes spell out Unicode white space and digits, so the result
does not depend on the ASCII defaults of Java's ``\\s`` and ``\\d``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

# The Unicode white-space characters, as regex class members (control
# characters, and the separator category) and as a string.
SPACE_MEMBERS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\p{Z}"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = f"[{SPACE_MEMBERS}]"
NON_SPACE = f"[^{SPACE_MEMBERS}]"
DIGIT = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"


def strip(text: Column) -> Column:
    """Remove white space at both ends (Spark's own ``trim`` removes blanks only)."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def drop_bad_bytes(text: Column) -> Column:
    """Drop bytes that are no UTF-8; the text reader passes them on as they are."""
    return F.when(F.is_valid_utf8(text), text).otherwise(F.translate(F.make_valid_utf8(text), "\ufffd", ""))


def number_prefix(text: Column) -> Column:
    """The leading number of a text as double (``16M`` -> 16.0), NULL when there is none."""
    digits = F.regexp_extract(text, r"^[+-]?\d+\.?\d*", 0)
    return F.nullif(digits, F.lit("")).try_cast("double")


def float_text(value: Column) -> Column:
    """A double as shortest decimal text: ``85.0``, ``12345678.0``, ``1e+16``, ``5e-05``."""
    java = value.cast("string")
    size = F.abs(value)
    plain = F.regexp_replace(java.cast("decimal(38,21)").cast("string"), r"(?<!\.)0+$", "")
    plain = F.when(value == 0, F.lit("0.0")).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    exponent = F.substring_index(java, "E", -1).cast("int")
    sign = F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+"))
    scientific = F.concat(mantissa, sign, _two_digits(exponent))
    return F.when((size == 0) | ((size >= 1e-4) & (size < 1e16)), plain).otherwise(scientific)


def wall_time(ts: dt.datetime) -> Column:
    """A driver-side time as timestamp without zone, whatever the zones of driver and session."""
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")


def _two_digits(number: Column) -> Column:
    digits = F.abs(number).cast("string")
    return F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits)

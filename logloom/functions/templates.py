"""Turning a message into its template, and checking that the template fits."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from logloom.functions.text import DIGIT, SPACE

# The placeholders of a template and the characters that are escaped in it.
HEX_PLACEHOLDER = r"0x[0-9A-Fa-f]+"
SPACE_PLACEHOLDER = r"\s+"
NUMBER_PLACEHOLDER = r"\d+"
ESCAPED = r"[()\[\]{}?*+\-|^$\\.&~#]"

# A noncharacter (never valid in text) holds the place of a hex number until digits are done.
_HEX_MARK = "\ufdd0"


def template_of(message: Column) -> Column:
    """Regex template of a message.

    Escaping first means the placeholders added afterwards need no protection
    from it; only the hex placeholder, which has digits itself, waits until
    the end.
    """
    text = F.regexp_replace(message, f"({ESCAPED})", r"\\$1")
    text = F.regexp_replace(text, "0[xX][0-9A-Fa-f]+", _HEX_MARK)
    text = F.regexp_replace(text, f"{DIGIT}+", r"\\d+")
    text = F.regexp_replace(text, f"{SPACE}+", r"\\s+")
    return F.replace(text, F.lit(_HEX_MARK), F.lit(HEX_PLACEHOLDER))


def fits_own_template(message: Column) -> Column:
    """Whether a message matches the template made from it.

    Every placeholder covers the text it replaced, but the hex placeholder starts
    with a small ``0x``: a number written ``0X..`` is the one thing it misses. No
    regex of the length of the message has to run for that.
    """
    numbers = F.regexp_extract_all(message, F.lit("0[xX][0-9A-Fa-f]+"), F.lit(0))
    return ~F.exists(numbers, lambda n: n.startswith("0X"))


@F.pandas_udf(T.BooleanType())
def pattern_fits(pattern: pd.Series, message: pd.Series) -> pd.Series:
    """Whether any pattern, Python dialect, matches a whole message; false for an invalid one.

    The JVM's engine recurses once per quantifier, so a template as long as a page
    can exhaust its stack; Python's does not.
    """
    def fits(regex, text):
        if regex is None or text is None:
            return None
        try:
            return re.fullmatch(regex, text) is not None
        except (re.error, OverflowError, RecursionError):
            return False

    return pd.Series([fits(p, m) for p, m in zip(pattern, message)], dtype=object)

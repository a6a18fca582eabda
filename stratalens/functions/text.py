"""Columns about lines and words. Lengths that matter are in bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens import constants as K

WORD_SPLIT = "[" + "".join("\\" + c if c in "[]^-&\\" else c for c in K.DELIMITERS) + "]+"


def words(c: Column) -> Column:
    return F.filter(F.split(c, WORD_SPLIT), lambda w: F.octet_length(w) >= 2)


def captured(c: Column, most: int = 240) -> Column:
    return F.substring(F.btrim(c, F.lit(" \t\r")), 1, most)


def snippet(line: Column, start: Column, length: Column, most: int = 80) -> Column:
    """Up to `most` characters with the hit (from `start`, 1-based) in the middle."""
    left = F.greatest(F.lit(1), start - F.floor((F.lit(most) - length) / 2)).cast("int")
    return F.btrim(F.replace(F.substring(line, left, F.lit(most)), F.lit("\r"), F.lit("")), F.lit(" \t"))


def quoted(c: Column) -> Column:
    """The first quoted text that isn't empty, or the empty text."""
    return F.regexp_extract(c, r"""["']([^"']+)["']""", 1)


def literal(text: str) -> str:
    return re.escape(text)

"""Column expressions shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sha256_hex(text: Column) -> Column:
    """Lower-case hex digest of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")

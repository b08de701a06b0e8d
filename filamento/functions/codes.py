"""Normal forms of identifying codes and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_code(col: Column, width: int) -> Column:
    """Digits of a code, left-padded with zeros to ``width``; null if there is no digit or too many."""
    d = F.regexp_replace(col, "[^0-9]", "")
    return F.when((F.length(d) > 0) & (F.length(d) <= width), F.lpad(d, width, "0"))


def corp_code(col: Column) -> Column:
    return digits_code(col, 8)


def stock_code(col: Column) -> Column:
    return digits_code(col, 6)


def day8(col: Column) -> Column:
    """The first eight digits of a date written in any order-preserving format, as yyyymmdd; null if fewer."""
    d = F.regexp_replace(col, "[^0-9]", "")
    return F.when(F.length(d) >= 8, F.substring(d, 1, 8))

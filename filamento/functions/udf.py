"""Arrow functions as columns, built anew at each use: no state of an ended session lives on."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def arrow(kind: DataType) -> Callable:
    """Decorator for functions from Arrow arrays to one Arrow array of ``kind``."""

    def add(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def column(*cols) -> Column:
            return F.arrow_udf(f, kind)(*cols)

        return column

    return add

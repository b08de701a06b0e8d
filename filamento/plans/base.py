"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession


class Book:
    """Queries of one module by name; ``sql`` is what DuckDB runs on the same tables."""

    def __init__(self) -> None:
        self.calls: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f):
            self.calls[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add

    def whole(self, name: str, like: str) -> None:
        """Registers the query ``like`` over all of its rows, without the character filter its counterpart needs."""
        self.calls[name] = partial(self.calls[like], plain=False)

    def queries(self) -> dict:
        return dict(self.calls)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self.sql)


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """An inline table; the same ``(VALUES rows) AS t(columns)`` reads alike in both engines."""
    return spark.sql(f"SELECT * FROM (VALUES {rows}) AS t({columns})")

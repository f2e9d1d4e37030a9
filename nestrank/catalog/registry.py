"""Name -> (Spark query, checking SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = " ".join(sql.split("\n"))
        return fn

    return add


def joined(col: str | Column, sep: str = "|") -> Column:
    """Array as one text, so results compare the same in every engine."""
    return F.array_join(F.col(col) if isinstance(col, str) else col, sep)

"""Where queries and their DuckDB SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapter import CTE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, more: str = "", recursive: bool = False):
    """Register a query under its function's name; ``sql`` reads the adapter's tables and the expressions of ``more``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{CTE}{',' + more if more else ''} {sql}"
        return f

    return add

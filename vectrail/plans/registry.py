"""Where plans register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def plan(sql: str | None = None, name: str | None = None):
    """Register a function as a query; ``sql`` computes the same rows in DuckDB."""

    def add(function: Plan) -> Plan:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            SQL[key] = sql
        return function

    return add

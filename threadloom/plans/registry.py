"""All queries over the driver's tables, by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    """Registers a query, and its SQL where there is one."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add

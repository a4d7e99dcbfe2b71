"""Registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name, with its SQL if there is one."""

    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return keep

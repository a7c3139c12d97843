"""Queries by name, each with the SQL that has the same rows (or none)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from acquira.sources.tables import BASE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *, base: bool = True):
    """Registers a plan under its function's name; ``sql`` may use the base relations and starts with SELECT or more CTEs (", x AS (...) SELECT")."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (BASE + sql) if base else sql
        return f

    return keep

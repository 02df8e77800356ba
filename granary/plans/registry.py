from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.sources.prices import OBS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, obs: bool = True):
    """Register a query under its function's name. sql: the same rows in SQL; with obs, after the common table obs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            if obs:
                body = f"WITH {OBS_SQL}" + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)
            ORACLE[f.__name__] = body
        return f

    return add

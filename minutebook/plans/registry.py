"""Named queries and, where SQL can express them, the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from minutebook.plans.fixtures import compose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use any of the named fixtures as tables."""
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = compose(sql)
        return fn
    return register

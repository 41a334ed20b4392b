"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..derive import Tables, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers f(tables) as a query; oracle: SQL over the derived tables."""

    def wrap(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            SQL[key] = sql(oracle)
        return f

    return wrap

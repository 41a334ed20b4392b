"""All queries of the graph-evaluation operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .derive import Tables
from .plans import checked_queries, graph_queries, more_queries, nested_queries, path_queries, run_queries, span_queries, text_queries  # noqa: F401  registers
from .plans.base import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_queries.prune_summary(Tables(spark, sf_dir))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Joins that say what their keys must be, and stop with the key's name where that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stop(df: DataFrame, wrong: Column, what: Column) -> DataFrame:
    """Every row, unless one is wrong.  A filter, so that no later selection can drop the check."""
    return df.filter(F.when(wrong, F.raise_error(what).cast("boolean")).otherwise(F.lit(True)))


def _named(text: str, on: list[str]) -> Column:
    return F.concat(F.lit(f"{text}: "), F.to_json(F.struct(*on), {"ignoreNullFields": "false"}))


def unique(df: DataFrame, on: list[str], name: str = "table") -> DataFrame:
    """The rows of df; a key that is there twice is an error."""
    again = F.row_number().over(Window.partitionBy(*on).orderBy(*on))
    return _stop(df.withColumn("__again", again), F.col("__again") > 1, _named(f"{name} has a key twice", on)).drop("__again")


def lookup(rows: DataFrame, table: DataFrame, on: list[str], strict: bool = True) -> DataFrame:
    """Many-to-one: each row with what the table, whose keys are unique, says about its key.

    A key that the table lacks, or that is null, is an error; not strict: such rows are left out.
    """
    once = unique(table, on, "lookup table")
    if not strict:
        return rows.join(once, on)
    out = rows.join(once.withColumn("__found", F.lit(True)), on, "left")
    return _stop(out, F.col("__found").isNull(), _named("key is not in the lookup table", on)).drop("__found")


def exact_cover(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One-to-one: both sides must have the same keys, each once; anything else is an error."""
    a = unique(left, on, "left side").withColumn("__l", F.lit(True))
    b = unique(right, on, "right side").withColumn("__r", F.lit(True))
    out = _stop(a.join(b, on, "full"), F.col("__l").isNull(), _named("key is on the right side only", on))
    return _stop(out, F.col("__r").isNull(), _named("key is on the left side only", on)).drop("__l", "__r")

"""Ranks over a whole table without a task that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def numbered(rows: DataFrame, order: Sequence, name: str = "no") -> tuple[DataFrame, int]:
    """rows with their number (from 1) by order, and how many there are.

    Rows are cut into ranges; the driver gets one count for each task of the sort, and the
    counts before a range give its first number.  Rows that order leaves equal may be
    numbered either way.
    """
    ranged = checkpointed(rows.sparkSession, rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}
    first, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        first.append(total)
        total += sizes.get(part, 0)
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn(name, F.get(F.lit(first or [0]).cast("array<bigint>"), F.col("__part")) + inside).drop("__part"), total


def half_even(numerator: int, denominator: int) -> int:
    """A fraction rounded to a whole number, halves to the even one."""
    whole, rest = divmod(2 * numerator + denominator, 2 * denominator)
    return whole - (rest == 0 and whole % 2 == 1)


def equal_bins(rows: DataFrame, value: str, n: int, name: str = "bin") -> DataFrame:
    """rows with bins (from 0) of equal counts by value; boundaries are rounded half to even."""
    ranked, total = numbered(rows, [F.col(value)], "__no")
    return ranked.withColumn(name, sum((F.when(F.col("__no") > half_even(total * b, n), 1).otherwise(0) for b in range(1, n)), F.lit(0))).drop("__no")

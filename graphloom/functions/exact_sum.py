"""Exactly rounded sums of doubles, the same under any partitioning.

A double is an integer times a power of two.  The integers are summed by exponent in
whole numbers of 38 digits, which partial aggregates can merge in any order; a group's
sums, 2,100 at most, are put together at the end and rounded once.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Bits of a significand with two to spare, so that an exponent that log2 rounds up leaves it whole.
BITS = 54


def exponent(x: Column) -> Column:
    """A power of two near the number, at least that of the smallest one."""
    return F.greatest(F.floor(F.log2(F.abs(x))).cast("int"), F.lit(-1074 + BITS))


def significand(x: Column, e: Column) -> Column:
    """x * 2 ** (BITS - e), a whole number; in two steps, as the power alone may be out of range."""
    up = F.lit(BITS) - e
    half = F.floor(up / 2).cast("int")
    return (x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), up - half)).cast("bigint")


def _rounded(parts, n=None) -> float | None:
    total = Fraction(0)
    for p in parts:
        total += int(p["m"]) * (Fraction(2) ** int(p["e"]))
    total = total / Fraction(2) ** BITS / (n or 1)
    try:
        return float(total)  # rounds to nearest, ties to even
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


@F.pandas_udf(DoubleType())
def rounded(parts: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_rounded(p, int(k)) for p, k in zip(parts, n, strict=True)], dtype="float64")


def exact_sums(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, exact_sum, exact_mean of the value (a double) of each group.

    Nulls are passed over; a group without values has n 0 and nulls.  As in ordinary
    sums, NaN or infinities of both signs give NaN, an infinity gives itself.
    """
    x = F.col(value).cast("double")
    finite = F.abs(x) < float("inf")
    e = F.when(finite & (x != 0), exponent(x))
    split = rows.select(*keys, x.alias("__x"), e.alias("e")).withColumn("m", F.when(F.col("e").isNotNull(), significand(F.col("__x"), F.col("e"))).cast("decimal(19,0)"))
    odd = F.when(F.isnan("__x") | (F.abs("__x") == float("inf")), F.col("__x"))
    by_exponent = split.groupBy(*keys, "e").agg(F.count("__x").alias("n"), F.sum(F.col("m").cast("decimal(38,0)")).alias("m"), F.sum(odd).alias("odd"))
    each = by_exponent.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("odd").alias("odd"), F.collect_list(F.when(F.col("m").isNotNull(), F.struct("e", F.col("m").cast("string").alias("m")))).alias("parts"))
    total = lambda n: F.when(F.col("n") > 0, F.coalesce("odd", rounded(F.col("parts"), n)))
    return each.select(*keys, "n", total(F.lit(1)).alias("exact_sum"), total(F.greatest("n", F.lit(1))).alias("exact_mean"))

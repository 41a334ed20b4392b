"""Cohorts, masks and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exclusive_answers(node: DataFrame) -> DataFrame:
    """Nodes that belong to exactly one choice, with its letter."""
    return node.filter(F.size("in_choices") == 1).select("stmt", "cid", F.element_at("in_choices", 1).alias("letter"))


def baseline_cohort(rows: DataFrame, key: list[str], baseline: Column, capped: Column) -> DataFrame:
    """Rows of all arms whose key has a baseline row, and none that is capped."""
    kept = rows.filter(baseline).groupBy(*key).agg(F.bool_or(F.coalesce(capped, F.lit(False))).alias("__capped")).filter("not __capped")
    return rows.join(kept.select(*key), key, "left_semi").select(*rows.columns)


def masked(value: Column, covariate: Column, threshold: float, failed: Column | None = None) -> Column:
    """struct of value (null where the covariate is above the threshold, or the check failed), unmasked_value and status."""
    hide = F.coalesce(covariate > threshold, F.lit(False)) | (F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False))
    return F.struct(F.when(~hide, value).alias("value"), value.alias("unmasked_value"), F.when(hide, "illegible").when(value.isNull(), "no_items").otherwise("complete").alias("status"))


def outside_ranges(rows: DataFrame, reference: DataFrame, fields: list[str], key: list[str]) -> DataFrame:
    """key and the fields (as an array) whose value is not within the least and greatest one of the reference, both included."""
    ends = reference.agg(*(F.min(f).alias(f"__lo_{f}") for f in fields), *(F.max(f).alias(f"__hi_{f}") for f in fields))  # one row
    bad = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(f).between(F.col(f"__lo_{f}"), F.col(f"__hi_{f}")), F.lit(False)), F.lit(f)) for f in fields)))
    return rows.crossJoin(F.broadcast(ends)).select(*key, bad.alias("failed")).filter(F.size("failed") > 0)

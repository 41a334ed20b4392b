"""Nested metrics as rows: dotted paths, numbers, and what each number counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

#: Fields that say how many records an object is about, and other denominators of single metrics.
RECORDS, GOLD_NODES, PARSED = "record_count", "gold_node_count", ("parsed_count", "parsed_degree_count")


def flatten_metrics(rows: DataFrame, key: list[str], value: str, n_items: str | None = None) -> DataFrame:
    """key, name, number, n: a row for each number or null in the objects of a VARIANT column, at any depth.

    name is the path, dots between its keys.  Booleans, texts and arrays are dropped, and
    what is no object has no rows.  n is the denominator: the record_count of the
    innermost object around, else n_items; micro_recall counts gold nodes, and the mean
    absolute error of the outermost object counts parsed rows, where these are given.
    One pass for each level of depth, written so that no level is computed again.
    """
    spark = rows.sparkSession
    whole = lambda c, path: F.try_variant_get(c, f"$.{path}", "bigint")
    outer = F.col(n_items).cast("bigint") if n_items else F.lit(None).cast("bigint")
    top = rows.select(*key, F.lit(None).cast("string").alias("__at"), outer.alias("__n"), F.col(value).alias("__v"))
    found = None
    while True:
        level = top.filter("schema_of_variant(__v) like 'OBJECT%'").withColumn("__n", F.coalesce(whole(F.col("__v"), RECORDS), "__n"))
        level = level.withColumn("__gold", whole(F.col("__v"), GOLD_NODES)).withColumn("__parsed", F.coalesce(*(whole(F.col("__v"), p) for p in PARSED)))
        level.createOrReplaceTempView("__graphloom_nested")
        inner = spark.sql(f"select {', '.join(f'`{k}`' for k in key)}, __n, __gold, __parsed, concat_ws('.', __at, e.key) as __name, __at is null as __outer, e.value as __v from __graphloom_nested, lateral variant_explode(__v) as e")
        inner = checkpointed(spark, inner.withColumn("__kind", F.expr("schema_of_variant(__v)")))
        spark.catalog.dropTempView("__graphloom_nested")
        last = F.substring_index("__name", ".", -1)
        n = F.when((last == "micro_recall") & F.col("__gold").isNotNull(), F.col("__gold")).when(F.col("__outer") & (last == "mean_absolute_error"), F.coalesce("__parsed", "__n")).otherwise(F.col("__n"))
        leaf = F.col("__kind").rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL|VOID)")
        numbers = inner.filter(leaf).select(*key, F.col("__name").alias("name"), F.expr("try_variant_get(__v, '$', 'double')").alias("number"), n.alias("n"))
        found = numbers if found is None else found.unionByName(numbers)
        top = inner.filter("__kind like 'OBJECT%'").select(*key, F.col("__name").alias("__at"), "__n", "__v")
        if top.isEmpty():
            return found


def bag_difference(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """fields, n_left, n_right of rows that do not stand on both sides equally often.  Nulls are equal to each other."""
    both = left.select(*fields, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*fields, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(*fields).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right")).filter("n_left <> n_right")

"""Checks that return violations as rows: none on clean input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def missing_fields(df: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    gaps = F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields)))
    return df.select(*key, F.explode(gaps).alias("field"))


def outside(df: DataFrame, field: str, domain: list, key: list[str]) -> DataFrame:
    return df.filter(F.col(field).isNull() | ~F.col(field).isin(domain)).select(*key, F.lit(field).alias("field"))


def cover(expected: DataFrame, got: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only."""
    a, b = expected.select(*key).distinct(), got.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def inconsistent(df: DataFrame, key: list[str], value: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count_distinct(value).alias("n")).filter("n > 1")


def dangling_edges(edge: DataFrame, node: DataFrame) -> DataFrame:
    at = lambda end: node.select("stmt", F.col("cid").alias(end))
    return edge.join(at("src"), ["stmt", "src"], "left_anti").select(*edge.columns).union(edge.join(at("tgt"), ["stmt", "tgt"], "left_anti").select(*edge.columns)).distinct()


def differing(df: DataFrame, key: list[str], stored: Column, counted: Column, tolerance: float = 1e-12) -> DataFrame:
    return df.select(*key, stored.alias("stored"), counted.alias("counted")).filter(F.abs(F.col("stored") - F.col("counted")) > tolerance)


def overlap(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Keys in more than one part."""
    every = parts[0].select(*key).distinct()
    for p in parts[1:]:
        every = every.unionByName(p.select(*key).distinct())
    return duplicate_keys(every, key)


def unequal(df: DataFrame, key: list[str], stored: Column, derived: Column) -> DataFrame:
    """Rows whose stored value is not the derived one; nulls are equal to each other."""
    return df.select(*key, stored.alias("stored"), derived.alias("derived")).filter(~F.col("stored").eqNullSafe(F.col("derived")))


def inconsistent_maps(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with more than one map, whatever the order of a map's entries."""
    entries = F.to_json(F.array_sort(F.map_entries(value)), {"ignoreNullFields": "false"})
    return df.groupBy(*key).agg(F.count_distinct(entries).alias("n")).filter("n > 1")


def incomplete_products(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Left values that do not meet every right value: n of them and how many there are in all."""
    every = df.select(*right).distinct().agg(F.count("*").alias("expected"))  # one row
    return df.groupBy(*left).agg(F.count_distinct(F.struct(*right)).alias("n")).crossJoin(F.broadcast(every)).filter("n < expected")


def unbalanced(df: DataFrame, key: list[str], parts: list[str], total: str) -> DataFrame:
    """Rows whose parts (nulls count 0) do not add up to their total."""
    added = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0))
    return df.select(*key, added.alias("parts"), F.col(total).alias("total")).filter("total is null or parts <> total")


def graph_faults(edge: DataFrame, node: DataFrame, n_nodes: tuple[int, int], n_edges: tuple[int, int]) -> DataFrame:
    """stmt, fault of graphs with too few or many nodes or edges, self-loops, edges without their ends, or a node twice."""
    nodes = node.groupBy("stmt").agg(F.count("*").alias("n"), F.collect_list("cid").alias("cids"), F.collect_list(F.struct("cid")).alias("every"))
    ends = edge.groupBy("stmt").agg(F.count("*").alias("m"), F.coalesce(F.bool_or(F.col("src") == F.col("tgt")), F.lit(False)).alias("loop"), F.collect_list(F.struct("src", "tgt")).alias("ends"))
    both = nodes.join(ends, "stmt", "full")
    lost = lambda x: F.coalesce(~F.array_contains("cids", x), F.lit(True))
    tests = [
        ("nodes", ~F.col("n").between(*n_nodes)), ("edges", ~F.col("m").between(*n_edges)), ("self_loop", F.col("loop")),
        ("dangling_edge", F.exists("ends", lambda e: lost(e["src"]) | lost(e["tgt"]))), ("duplicate_node", F.size(F.array_distinct("every")) < F.size("every")),
    ]
    return both.select("stmt", F.explode(F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests)))).alias("fault")).distinct()


def changed_inputs(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """path, was, now of files (path, sha256) that changed, came or went since they were recorded."""
    both = recorded.select("path", F.col("sha256").alias("was")).join(now.select("path", F.col("sha256").alias("now")), "path", "full")
    return both.filter(~F.col("was").eqNullSafe(F.col("now")))

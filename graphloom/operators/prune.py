"""Budgeted pruning of statement graphs, as named steps.

Caps follow one rule of zero: under policy ``truncate`` a node cap of 0 is no limit,
under ``keep`` it leaves no room for fillers; edge and degree caps of 0 are no limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..sources.shared import written
from .graph import around, dedupe_pairs, edge_budget, flags, kinds, lifelines

RULES = ("qa-bridge", "core-neighbor", "any", "none")


def with_neighbors(node: DataFrame, edge: DataFrame) -> DataFrame:
    """stmt, cid, q, a, nbrs (0 for isolated nodes)."""
    return around(edge, node).select("stmt", "cid", "q", "a", "nbrs")


def ranked_core(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Core nodes with their rank: question nodes first, each by falling neighbour count, then cid."""
    return _ranked_core(with_neighbors(node, edge))


def _ranked_core(facts: DataFrame) -> DataFrame:
    w = Window.partitionBy("stmt").orderBy(F.desc("q"), F.desc("nbrs"), "cid")
    return facts.filter("q or a").select("stmt", "cid", "q", "a", "nbrs").withColumn("rank", F.row_number().over(w))


def core(node: DataFrame, edge: DataFrame, max_nodes: int, policy: str = "truncate") -> DataFrame:
    """The core that is kept; each row carries core_size, its size before truncation."""
    return _core(with_neighbors(node, edge), max_nodes, policy)


def _core(facts: DataFrame, max_nodes: int, policy: str) -> DataFrame:
    ranked = _ranked_core(facts).withColumn("core_size", F.count("*").over(Window.partitionBy("stmt")))
    return ranked.filter(F.col("rank") <= max_nodes) if policy == "truncate" and max_nodes > 0 else ranked


def fillers(node: DataFrame, edge: DataFrame, rule: str, kept_core: DataFrame | None = None) -> DataFrame:
    """Nodes outside the core that the rule admits, with core_nbrs, nbrs and rank.

    Question and answer nodes of the rule are those before truncation; core_nbrs counts
    neighbours in the (untruncated) core.
    """
    return _fillers(around(edge, node), rule)


def _fillers(facts: DataFrame, rule: str) -> DataFrame:
    if rule not in RULES:
        raise ValueError(rule)
    admitted: Column = {"qa-bridge": F.col("kind") == "q_and_a", "core-neighbor": F.col("kind") != "neither", "any": F.lit(True), "none": F.lit(False)}[rule]
    rows = kinds(facts).filter(admitted).select("stmt", "cid", "core_nbrs", "nbrs")
    order = [F.desc("core_nbrs"), F.desc("nbrs"), F.asc("cid")] if rule == "any" else [F.desc("core_nbrs"), F.asc("cid")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("stmt").orderBy(*order)))


def chosen_fillers(node: DataFrame, edge: DataFrame, rule: str, max_nodes: int, policy: str = "truncate", max_bridges: int | None = None) -> DataFrame:
    """Fillers within the room that the core leaves."""
    return _chosen(around(edge, node), rule, max_nodes, policy, max_bridges)


def _chosen(facts: DataFrame, rule: str, max_nodes: int, policy: str, max_bridges: int | None) -> DataFrame:
    ranked = _fillers(facts, rule)
    sizes = _core(facts, max_nodes, policy).groupBy("stmt").agg(F.count("*").alias("kept"), F.max("core_size").alias("core_size"))
    if policy == "truncate":
        room = F.lit(None).cast("long") if max_nodes == 0 else F.greatest(F.lit(0), F.lit(max_nodes) - F.coalesce("kept", F.lit(0)))
    else:
        room = F.greatest(F.lit(0), F.lit(max_nodes) - F.coalesce("core_size", F.lit(0)))
    if max_bridges is not None:
        room = F.least(room, F.lit(max_bridges))  # least() passes over nulls
    return ranked.join(sizes, "stmt", "left").withColumn("room", room).filter(F.col("room").isNull() | (F.col("rank") <= F.col("room"))).select("stmt", "cid", "core_nbrs", "rank")


def induced(edge: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends kept."""
    lists = kept.groupBy("stmt").agg(F.collect_list("cid").alias("__kept"))
    return edge.join(lists, "stmt").filter(F.array_contains("__kept", F.col("src")) & F.array_contains("__kept", F.col("tgt"))).drop("__kept")


def _greedy(max_degree: int, use_lifelines: bool):
    """Accepts a statement's edges in order while both ends have room; lifelines are always accepted."""

    def taken(edges: list[dict]) -> list[int]:
        used: dict[int, int] = {}
        keep = []
        for i, r in enumerate(edges):
            ends = {r["src"]: 2} if r["src"] == r["tgt"] else {r["src"]: 1, r["tgt"]: 1}
            need = {n: 1 for n in ends} if use_lifelines else ends
            if not r["dead"] or all(used.get(n, 0) + need[n] <= max_degree for n in ends):
                keep.append(i)
                for n, k in ends.items():
                    used[n] = used.get(n, 0) + k
        return keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["stmt"], b["edges"], pa.array([taken(e) for e in b["edges"].to_pylist()], pa.list_(pa.int32()))], names=["stmt", "edges", "keep"])

    return run


def degree_cap(pairs: DataFrame, life: DataFrame, core_nodes: DataFrame, max_degree: int, use_lifelines: bool = True) -> DataFrame:
    """Greedy cap on edge ends, over each statement's edges in line; a statement is one question's graph."""
    marked = edge_budget(pairs, life, 0)
    if not use_lifelines:
        marked = marked.withColumn("life", F.lit(False))
    if max_degree == 0:
        return marked
    core_lists = core_nodes.groupBy("stmt").agg(F.collect_list("cid").alias("core"))
    own = lambda end: F.coalesce(F.array_contains("core", F.col(end)), F.lit(False))
    touch = marked.join(core_lists, "stmt", "left").withColumn("core_first", F.when(own("src") | own("tgt"), 0).otherwise(1))
    line = F.struct((~F.col("life")).alias("dead"), "priority", "core_first", "src", "relation", "tgt", "rel")
    rows = touch.groupBy("stmt").agg(F.array_sort(F.collect_list(line)).alias("edges"))
    kept = rows.mapInArrow(_greedy(max_degree, use_lifelines), StructType([*rows.schema.fields, StructField("keep", ArrayType(IntegerType()))]))
    picked = kept.select("stmt", F.explode(F.transform("keep", lambda i: F.get("edges", i))).alias("e"))
    return picked.select("stmt", "e.src", "e.rel", "e.tgt", "e.priority", "e.relation", (~F.col("e.dead")).alias("life"))


def prune(node: DataFrame, edge: DataFrame, relation: DataFrame, *, max_nodes: int = 18, max_edges: int = 60, max_degree: int = 0, rule: str = "qa-bridge", policy: str = "truncate", use_lifelines: bool = True, max_bridges: int | None = None) -> dict[str, DataFrame]:
    """kept nodes (stmt, cid, q, a, connected), edges, and counters per statement."""
    spark = edge.sparkSession
    # Merged graphs, the kept nodes and the edges among them are each used several times.
    node, edge = written(spark, node), written(spark, edge)
    facts = written(spark, around(edge, node))
    kept_core = written(spark, _core(facts, max_nodes, policy))
    added = written(spark, _chosen(facts, rule, max_nodes, policy, max_bridges))
    kept = kept_core.select("stmt", "cid").unionByName(added.select("stmt", "cid"))
    pairs = written(spark, dedupe_pairs(induced(edge, kept), relation))
    life = lifelines(pairs, kept_core) if use_lifelines else lifelines(pairs, kept_core).filter("false")
    before = pairs.groupBy("stmt").agg(F.count("*").alias("edges_before"))
    capped = degree_cap(pairs, life, kept_core, max_degree, use_lifelines).drop("life")
    edges = written(spark, edge_budget(capped, life, max_edges).select("stmt", "src", "rel", "tgt"))
    ends = edges.select("stmt", F.explode(F.array("src", "tgt")).alias("cid")).distinct().withColumn("connected", F.lit(True))
    nodes = kept.join(flags(node), ["stmt", "cid"]).join(ends, ["stmt", "cid"], "left").withColumn("connected", F.coalesce("connected", F.lit(False)))
    info = (
        node.select("stmt").distinct()
        .join(kept_core.groupBy("stmt").agg(F.max("core_size").alias("core_size"), F.count("*").alias("core_kept")), "stmt", "left")
        .join(added.groupBy("stmt").agg(F.count("*").alias("bridges_added")), "stmt", "left")
        .join(before, "stmt", "left")
        .join(edges.groupBy("stmt").agg(F.count("*").alias("edges_after")), "stmt", "left")
        .na.fill(0)
    )
    return {"nodes": nodes, "visible": visible(nodes), "edges": edges, "info": info}


def visible(nodes: DataFrame) -> DataFrame:
    """Connected nodes and isolated answers; isolated questions and fillers are hidden."""
    return nodes.filter("connected or a")

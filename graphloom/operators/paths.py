"""All shortest paths between two nodes of a statement's graph, capped."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..vocab import MAX_SHORTEST_PATHS
from .graph import adjacency


def shortest(pairs: list[tuple[int, int]], source: int, target: int, cap: int = MAX_SHORTEST_PATHS) -> list[list[int]]:
    """Paths in sorted order, none without pairs; of more than cap, those found first walking back from the target over smallest parents."""
    near: dict[int, set[int]] = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    level, depth = {source: 0}, 0
    frontier = {source}
    while frontier and target not in level:
        depth += 1
        frontier = {n for f in frontier for n in near[f]} - level.keys()
        level.update(dict.fromkeys(frontier, depth))
    if target not in level:
        return []
    found: list[list[int]] = []
    stack = [[target]]
    while stack and len(found) < cap:
        tail = stack.pop()
        if tail[0] == source:
            found.append(tail)
            continue
        back = sorted(n for n in near[tail[0]] if level.get(n, -1) == level[tail[0]] - 1)
        stack += [[n, *tail] for n in reversed(back)]
    return sorted(found)


def shortest_paths(edge: DataFrame, ends: DataFrame, cap: int = MAX_SHORTEST_PATHS) -> DataFrame:
    """stmt, source, target, distance, n_paths, first_path, truncated (cap reached, even exactly) for each row of ends (stmt, source, target).

    A statement's graph is one question's: its pairs fit one task.
    """
    schema = "stmt long, source int, target int, distance int, n_paths int, first_path array<int>, truncated boolean"
    pairs = adjacency(edge).filter("cid < nbr").groupBy("stmt").agg(F.collect_list(F.struct("cid", "nbr")).alias("pairs"))
    rows = ends.join(pairs, "stmt", "left").select(F.col("stmt").cast("long").alias("stmt"), F.col("source").cast("int").alias("source"), F.col("target").cast("int").alias("target"), "pairs")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source, target = b["source"].to_pylist(), b["target"].to_pylist()
            found = [shortest([(p["cid"], p["nbr"]) for p in own or ()], x, y, cap) for own, x, y in zip(b["pairs"].to_pylist(), source, target, strict=True)]
            first = [f[0] if f else None for f in found]
            made = [pa.array([len(f) - 1 if f else None for f in first], pa.int32()), pa.array([len(f) for f in found], pa.int32()), pa.array(first, pa.list_(pa.int32())), pa.array([len(f) >= cap for f in found])]
            yield pa.RecordBatch.from_arrays([b["stmt"], b["source"], b["target"], *made], names=["stmt", "source", "target", "distance", "n_paths", "first_path", "truncated"])

    return rows.mapInArrow(each, schema)

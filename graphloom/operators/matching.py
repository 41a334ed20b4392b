"""Greatest matchings of many small bipartite graphs at once, by alternating paths.

Edges are (set, a, b): left node a may be given right node b.  Sets of up to ROW_EDGES edges
are matched each in its row; larger ones by rounds over all of them.  A round grows a forest of
alternating paths from all left nodes without partner, level by level, for all sets in one
join; each right node belongs to one tree, drawn by hash so that many trees get some, and
the paths of different trees share nothing and are all flipped together.  A set whose forest meets no right node without
partner has a greatest matching and drops out.  Every level is written to the shared
folder: plans stay short and lost executors cost one level.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, written

#: Edges of a set that is matched in one row.
ROW_EDGES = 100_000


def _grow(edges: DataFrame, matched: DataFrame, free: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The forest (set, b, a, root) and the right nodes without partner at which paths end (set, root, b), one for each tree."""
    spark = edges.sparkSession
    partner = matched.select("set", "b", F.col("a").alias("next"))
    front, forest, ends = free, None, None
    while True:
        new = front.join(edges, ["set", "a"]).select("set", "b", "a", "root")
        if forest is not None:
            new = new.join(forest.select("set", "b"), ["set", "b"], "left_anti")
        new = new.groupBy("set", "b").agg(F.min(F.struct(F.xxhash64("a", "b").alias("h"), "a", "root")).alias("m")).select("set", "b", "m.a", "m.root")
        new = checkpointed(spark, new.join(partner, ["set", "b"], "left"))
        if new.isEmpty():
            return forest, ends
        grown = new.select("set", "b", "a", "root")
        forest = grown if forest is None else forest.unionByName(grown)
        reached = new.filter("next is null").groupBy("set", "root").agg(F.min("b").alias("b"))
        ends = reached if ends is None else ends.unionByName(reached)
        # Sets that have reached an end flip first; the others go on.
        front = new.filter("next is not null").join(reached.select("set").distinct(), "set", "left_anti").select("set", F.col("next").alias("a"), "root")


def match(near: dict) -> dict:
    """Partner of each right node in a greatest matching, by one alternating path for each left node."""
    partner: dict = {}
    for start in near:
        came, front, end = {}, [start], None
        while front and end is None:
            step = []
            for a in front:
                for b in near[a]:
                    if b not in came:
                        came[b] = a
                        if b not in partner:
                            end = b
                            break
                        step.append(partner[b])
                if end is not None:
                    break
            front = step
        old = {a: b for b, a in partner.items()} if end is not None and came[end] != start else {}
        while end is not None:
            a = came[end]
            partner[end] = a
            end = old.get(a)
    return partner


def _match_rows(edges: DataFrame) -> DataFrame:
    """Matchings of small sets."""
    kinds = dict(edges.dtypes)
    rows = edges.groupBy("set", "a").agg(F.array_sort(F.collect_list("b")).alias("bs")).groupBy("set").agg(F.array_sort(F.collect_list(F.struct("a", "bs"))).alias("near"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, left, right = [], [], []
            for i, near in enumerate(batch["near"].to_pylist()):
                found = match({x["a"]: x["bs"] for x in near})
                at += [i] * len(found)
                right += found
                left += found.values()
            item = batch["near"].type.value_type
            yield pa.RecordBatch.from_arrays([batch["set"].take(pa.array(at, pa.int64())), pa.array(left, item.field("a").type), pa.array(right, item.field("bs").type.value_type)], names=["set", "a", "b"])

    return rows.mapInArrow(each, f"set {kinds['set']}, a {kinds['a']}, b {kinds['b']}")


def greatest_matching(edges: DataFrame, row_edges: int = ROW_EDGES) -> DataFrame:
    """set, a, b: for each set as many pairs as can be, no a and no b twice.  Edges with nulls are passed over; the result is the same in every run."""
    spark = edges.sparkSession
    edges = written(spark, edges.select("set", "a", "b").dropna().distinct())
    large = written(spark, edges.groupBy("set").count().filter(F.col("count") > row_edges).select("set"))
    small = _match_rows(edges.join(large, "set", "left_anti"))
    if large.isEmpty():
        return small
    return small.unionByName(_match_rounds(edges.join(large, "set", "left_semi")))


def _match_rounds(edges: DataFrame) -> DataFrame:
    """Matchings of large sets."""
    spark = edges.sparkSession
    edges = checkpointed(spark, edges)
    matched = checkpointed(spark, edges.limit(0))
    open_sets = edges.select("set").distinct()
    while True:
        free = edges.join(open_sets, "set", "left_semi").select("set", "a").distinct().join(matched, ["set", "a"], "left_anti").withColumn("root", F.col("a"))
        forest, ends = _grow(edges, matched, free)
        ends = None if ends is None else checkpointed(spark, ends)
        if ends is None or ends.isEmpty():
            return matched
        forest = checkpointed(spark, forest)
        at, flipped = ends, None
        while True:  # back from the ends to the roots
            step = checkpointed(spark, at.join(forest.select("set", "b", "a"), ["set", "b"]).join(matched.select("set", "a", F.col("b").alias("old")), ["set", "a"], "left"))
            pairs = step.select("set", "a", "b")
            flipped = pairs if flipped is None else flipped.unionByName(pairs)
            at = step.filter("old is not null").select("set", "root", F.col("old").alias("b"))
            if at.isEmpty():
                break
        flipped = checkpointed(spark, flipped)
        matched = checkpointed(spark, matched.join(flipped.select("set", "a"), ["set", "a"], "left_anti").unionByName(flipped))
        open_sets = ends.select("set").distinct()


def matching_sizes(nodes: DataFrame, matched: DataFrame) -> DataFrame:
    """set, n, matched, complete for sets of left nodes (set, a): whether every one has a partner."""
    left = nodes.select("set", "a").distinct().groupBy("set").agg(F.count("*").alias("n"))
    size = matched.groupBy("set").agg(F.count("*").alias("matched"))
    return left.join(size, "set", "left").select("set", "n", F.coalesce("matched", F.lit(0)).alias("matched"), (F.coalesce("matched", F.lit(0)) == F.col("n")).alias("complete"))

"""The pair of nodes that a shortest-path question asks for: the first eligible one in a stable order."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import adjacency
from .similar import near_pairs


def first_pair(line: list[int], ends: list[dict], likes: list[dict]) -> tuple[int, int] | None:
    """The first two nodes in line, the one before the other, that are connected, not adjacent and not alike.

    Behind a node its neighbours and likes are passed over and the next one of its component
    is taken, so no more is looked at than edges and likes.
    """
    near: dict[int, set[int]] = defaultdict(set)
    for e in ends:
        near[e["src"]].add(e["tgt"])
        near[e["tgt"]].add(e["src"])
    bad = {n: set(x) for n, x in near.items()}
    for e in likes:
        bad[e["cid"]].add(e["nbr"])
    mates: dict[int, list[int]] = {}
    for n in line:
        if n not in mates:
            seen, todo = {n}, [n]
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            own: list[int] = []
            mates.update(dict.fromkeys(seen, own))
        mates[n].append(n)
    place = {n: i for own in mates.values() for i, n in enumerate(own)}
    for a in line:
        own = mates[a]
        for i in range(place[a] + 1, len(own)):
            if own[i] not in bad[a]:
                return a, own[i]
    return None


def question_pair(edge: DataFrame, labels: DataFrame, order: Column) -> DataFrame:
    """stmt, cid_a, cid_b: of each statement the first pair, by (order of a, order of b), that is connected, not adjacent and not alike in name.

    labels: cid, label.  order: a column of (stmt, cid) by which nodes stand in line, a
    before b.  A statement's graph is one question's and is looked at in one row.
    """
    edge = edge.dropna(subset=["stmt", "src", "tgt"])
    named = labels.select("cid", "label")
    near = near_pairs(named, "label").select("a", "b").unionByName(named.select(F.col("label").alias("a"), F.col("label").alias("b")).distinct())
    alike = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    alike = alike.join(named.select(F.col("label").alias("a"), "cid"), "a").join(named.select(F.col("label").alias("b"), F.col("cid").alias("nbr")), "b").filter("cid <> nbr").groupBy("cid").agg(F.collect_set("nbr").alias("likes"))
    ends = edge.groupBy("stmt").agg(F.collect_set(F.struct("src", "tgt")).alias("ends"))
    nodes = adjacency(edge).select("stmt", "cid").distinct().join(alike, "cid", "left").withColumn("h", order)
    lines = nodes.groupBy("stmt").agg(F.array_sort(F.collect_list(F.struct("h", "cid", "likes"))).alias("x"))
    cids = F.transform("x", lambda n: n["cid"])
    likes = F.flatten(F.transform(F.filter("x", lambda n: n["likes"].isNotNull()), lambda n: F.transform(F.array_intersect(n["likes"], cids), lambda m: F.struct(n["cid"].alias("cid"), m.alias("nbr")))))
    rows = lines.join(ends, "stmt").select("stmt", cids.alias("line"), "ends", likes.alias("likes"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [first_pair(*x) for x in zip(b["line"].to_pylist(), b["ends"].to_pylist(), b["likes"].to_pylist(), strict=True)]
            pair = [pa.array([f and f[i] for f in found], b["line"].type.value_type) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b["stmt"], *pair], names=["stmt", "cid_a", "cid_b"])

    kinds = dict(nodes.dtypes)
    return rows.mapInArrow(each, f"stmt {kinds['stmt']}, cid_a {kinds['cid']}, cid_b {kinds['cid']}").filter("cid_a is not null")

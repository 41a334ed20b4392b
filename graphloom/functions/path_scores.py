"""Paths named in texts and paths against sets of right paths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, set_scores


def quoted(c: Column) -> Column:
    """A pattern that matches just this text."""
    return F.regexp_replace(c, r"([\\^$.|?*+()\[\]{}\-#&~\s])", r"\\$1")


def names_in_order(text: Column, path: Column) -> Column:
    """Whether the text names all nodes of a path one after the other, each as a whole word behind the one before."""
    behind = lambda rest, node: F.get(F.split(rest, F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted(node), F.lit(r"(?![\p{L}\p{N}_])")), 2), F.lit(1))
    return F.aggregate(path, text, behind).isNotNull()


def names_a_path(text: Column, paths: Column) -> Column:
    return F.exists(paths, lambda p: names_in_order(text, p))


def against_paths(predicted: Column, paths: Column, distance: Column) -> Column:
    """struct of exact (the path is one of the right ones), hop_correct, best (the first right path of greatest node overlap, from 0) and overlap_f1.

    No right path: best is null and the overlap 0; an empty prediction has no hops.
    """
    f1 = F.transform(paths, lambda p: set_scores(p, predicted)["f1"])

    def pick(scores: Column) -> Column:
        top = F.array_max(scores)
        first = (F.array_position(scores, top) - 1).cast("int")
        return F.struct(F.array_contains(paths, predicted).alias("exact"), ((F.size(predicted) > 0) & (F.size(predicted) - 1 == distance)).alias("hop_correct"), F.when(top.isNotNull(), first).alias("best"), F.coalesce(top, F.lit(0.0)).alias("overlap_f1"))

    return let(f1, pick)


def against_each_other(walks: list[list]) -> list[tuple]:
    """against_paths of each walk, with all others as the right paths in their order; distance is the first one's."""
    sets, out = [set(w) for w in walks], []
    for i, (walk, own) in enumerate(zip(walks, sets, strict=True)):
        top, best, exact = None, None, False
        for no, j in enumerate(j for j in range(len(walks)) if j != i):
            tp = len(own & sets[j])
            precision, recall = tp / len(own) if own else 0.0, tp / len(sets[j]) if sets[j] else float(not own)
            f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
            exact = exact or walk == walks[j]
            if top is None or f1 > top:
                top, best = f1, no
        first = None if len(walks) < 2 else walks[1 if i == 0 else 0]
        out.append((len(walk), exact, None if first is None else bool(walk) and len(walk) == len(first), best, top or 0.0))
    return out


def score_groups(walks: DataFrame) -> DataFrame:
    """k, n_nodes, exact, hop_correct, best, overlap_f1 of every walk (stmt, k, nodes) against the others of its statement in order of k.

    A statement's walks are compared in one row; those without a statement have no others.
    """
    schema = "k long, n_nodes long, exact boolean, hop_correct boolean, best int, overlap_f1 double"
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.float64()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for stmt, every in zip(b["stmt"].to_pylist(), b["every"].to_pylist(), strict=True):
                nodes = [w["nodes"] for w in every]
                scores = [against_each_other([n])[0] for n in nodes] if stmt is None else against_each_other(nodes)
                made += [(w["k"], *s) for w, s in zip(every, scores, strict=True)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), kinds, strict=True)], names=["k", "n_nodes", "exact", "hop_correct", "best", "overlap_f1"])

    return walks.groupBy("stmt").agg(F.array_sort(F.collect_list(F.struct("k", "nodes"))).alias("every")).mapInArrow(each, schema)

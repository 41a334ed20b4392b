"""Exact top-k search by MaxScore over integer vectors.

A component is a term; a shard of the rows holds one posting list per term.  Queries
and rows are cut into blocks: every block of queries meets every shard once, in a task
that holds no more than one of each.

Cases: vectors that are null or hold null or non-finite components take no part, nor do
rows without vec_id.  Rows with one vec_id are one vector (the smallest, if they differ).
Shorter vectors count as filled up with zeros.  Scores beyond 64 bits
saturate, and then tie.
Fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARD_ROWS, QUERY_BLOCK, STEP, SEED_ROWS = 8192, 2048, 8, 256


def integers(vectors: list, scale: int = 1024) -> np.ndarray:
    """floor(scale * x) of each component as exact numbers: float64 while sums stay below 2**53, else Python integers."""
    width = max((len(v) for v in vectors), default=0)
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    return np.floor(x * scale)


def exact(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def search(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, row, score) of each query's k best rows of one shard, ties to the smaller row id."""
    width = max(q.shape[1], v.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
    if width * np.abs(q).max(initial=0) * np.abs(v).max(initial=0) >= 2.0**53:
        q, v = exact(q), exact(v)
    if not len(v) or not width:
        return [(int(a), int(b), 0) for a in q_ids for b in sorted(x for x in v_ids if x != a)[:k]]
    postings = np.ascontiguousarray(v.T)
    high, low = postings.max(1), postings.min(1)
    out = []
    for qid, terms in zip(q_ids, q, strict=True):
        ends = np.stack([terms * high, terms * low])
        most, least = ends.max(0), ends.min(0)
        span = most - least  # what a term can add to the least score
        order = np.argsort(-span.astype(float), kind="stable")
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0)  # most that the terms from here on give
        alive = np.flatnonzero(v_ids != qid)
        seed = alive[:SEED_ROWS]
        scores = v[seed] @ terms
        floor = np.sort(scores)[-k] if len(seed) >= k and scores.dtype != object else None
        done = width
        if floor is not None:
            # Terms are essential up to where the others alone can't reach the floor any more.
            others = np.cumsum(span[order][::-1])[::-1] + least.sum()
            essential = int(np.count_nonzero(others >= floor))
            done = min(max(1, min(STEP, essential)), width)
        partial = terms[order[:done]] @ postings[order[:done]][:, alive]
        while floor is not None and len(alive) > k:
            keep = partial + rest[done] >= floor
            alive, partial = alive[keep], partial[keep]
            if done == width:
                break
            nxt = order[done : done + STEP]
            partial = partial + terms[nxt] @ postings[nxt][:, alive]
            done = min(done + STEP, width)
            if len(partial) >= k:  # a row's score is at least its partial sum and the least of the rest
                reached = np.partition(partial, len(partial) - k)[-k]
                floor = max(floor, reached + least[order[done:]].sum())
        if done < width:
            partial = partial + terms[order[done:]] @ postings[order[done:]][:, alive]
        whole = [max(-(2**63), min(2**63 - 1, int(s))) for s in partial.tolist()]
        out += [(int(qid), int(i), -s) for s, i in sorted((-s, i) for s, i in zip(whole, v_ids[alive].tolist(), strict=True))[:k]]
    return out


def _meet(k: int):
    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        rows = search(q["vec_id"].to_numpy(), integers(list(q["v"])), v["vec_id"].to_numpy(), integers(list(v["v"])), k) if len(q) and len(v) else []
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products with the other rows.

    is_query: a condition on vec_id.  Rows are shuffled once for each block of queries.
    """
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    clean = clean.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & usable).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, nq = clean.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    shards, blocks = max(-(-n // shard_rows), min(cores, -(-n // 512)), 1), max(-(-nq // query_block), 1)
    spread = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    rows = clean.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("b", F.explode(spread(blocks)))
    queries = clean.filter(is_query).withColumn("b", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("s", F.explode(spread(shards)))
    found = queries.groupBy("b", "s").cogroup(rows.groupBy("b", "s")).applyInPandas(_meet(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


ORACLE_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

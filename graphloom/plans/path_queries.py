"""Paths in texts, best right paths, exactly rounded sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..derive import Tables
from ..functions import path_scores as P
from ..functions.exact_sum import exact_sums
from .base import query

#: Nodes of every order in line order, and the right paths of its customer: those of the first lines of each order.
WALKS = """, walk AS (SELECT stmt, l_orderkey AS k, list(cid ORDER BY no, cid) AS nodes FROM line GROUP BY ALL)"""


def walks(t: Tables) -> DataFrame:
    steps = t.line.groupBy("stmt", F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("no", "cid"))).alias("s"))
    return steps.select("stmt", "k", F.transform("s", lambda x: x["cid"]).alias("nodes"))


@query(WALKS + """, pos AS (SELECT stmt, k, unnest(nodes) AS cid, generate_subscripts(nodes, 1) AS i FROM walk),
want AS (SELECT DISTINCT stmt, nodes[1] AS a, nodes[2] AS b FROM walk WHERE len(nodes) >= 2),
hit AS (SELECT DISTINCT p.k FROM want w JOIN (SELECT k, any_value(stmt) AS stmt, cid, min(i) AS i FROM pos GROUP BY k, cid) p ON p.stmt = w.stmt AND p.cid = w.a
  JOIN pos q ON q.k = p.k AND q.cid = w.b AND q.i > p.i WHERE w.a || ',' || w.b IN (SELECT o.nodes[1] || ',' || o.nodes[2] FROM walk o WHERE o.stmt = p.stmt AND o.k <> p.k))
SELECT k AS o_orderkey, k IN (SELECT k FROM hit) AS names_path FROM walk""")
def path_containment(t: Tables) -> DataFrame:
    """Whether the text of an order names, in order, the first two nodes of another order of its customer."""
    w = walks(t)
    name = lambda a: F.transform(a, lambda c: F.concat(F.lit("c"), c))
    starts = w.groupBy("stmt").agg(F.collect_list(F.when(F.size("nodes") >= 2, F.struct("k", name(F.slice("nodes", 1, 2)).alias("path")))).alias("starts"))
    others = F.transform(F.filter("starts", lambda s: s["k"] != F.col("k")), lambda s: s["path"])
    return w.join(starts, "stmt").select(F.col("k").alias("o_orderkey"), P.names_a_path(F.array_join(name(F.col("nodes")), " then "), others).alias("names_path"))


_SCORED = WALKS + """, pair AS (SELECT p.k, p.nodes AS pred, g.nodes AS gold, row_number() OVER (PARTITION BY p.k ORDER BY g.k) - 1 AS no, len(first_value(g.nodes) OVER (PARTITION BY p.k ORDER BY g.k)) - 1 AS distance
  FROM walk p JOIN walk g ON g.stmt = p.stmt AND g.k <> p.k),
f AS (SELECT *, len(list_intersect(list_distinct(pred), list_distinct(gold))) AS tp FROM pair),
g AS (SELECT *, CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * (tp / len(list_distinct(pred))) * (tp / len(list_distinct(gold))) / (tp / len(list_distinct(pred)) + tp / len(list_distinct(gold))) END AS f1 FROM f),
best AS (SELECT k, any_value(len(pred)) AS n_nodes, bool_or(pred = gold) AS exact, any_value(len(pred) - 1 = distance) AS hop_correct, min(struct_pack(x := -f1, no := no)) AS b FROM g GROUP BY k),
scored AS (SELECT w.k, len(w.nodes) AS n_nodes, coalesce(exact, false) AS exact, coalesce(hop_correct, false) AS hop_correct, b.no AS best, coalesce(-b.x, 0) AS overlap_f1 FROM walk w LEFT JOIN best USING (k))"""


def scored_walks(t: Tables) -> DataFrame:
    return P.score_groups(walks(t))


@query(_SCORED + " SELECT k AS o_orderkey, exact, hop_correct, CAST(best AS INTEGER) AS best, overlap_f1 FROM scored")
def best_gold_path(t: Tables) -> DataFrame:
    """Each order's nodes against those of its customer's other orders; the first of the best ones counts."""
    return scored_walks(t).select(F.col("k").alias("o_orderkey"), "exact", F.coalesce("hop_correct", F.lit(False)).alias("hop_correct"), "best", "overlap_f1")


@query(_SCORED + " SELECT n_nodes, count(*) AS n, avg(CASE WHEN exact THEN 1.0 ELSE 0.0 END) AS path_exact, avg(CASE WHEN hop_correct THEN 1.0 ELSE 0.0 END) AS hop_correct, avg(overlap_f1) AS mean_overlap_f1, count(*) FILTER (WHERE best IS NULL) AS without_gold FROM scored GROUP BY n_nodes")
def path_metrics(t: Tables) -> DataFrame:
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    return scored_walks(t).groupBy("n_nodes").agg(F.count("*").alias("n"), share("exact").alias("path_exact"), share("hop_correct").alias("hop_correct"), F.avg("overlap_f1").alias("mean_overlap_f1"), F.count(F.when(F.col("best").isNull(), 1)).alias("without_gold"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, fsum(v) AS exact_sum, fsum(v) / count(*) AS exact_mean FROM (SELECT l_returnflag, l_linestatus, CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE)) AS v FROM lineitem) GROUP BY ALL")
def exact_means(t: Tables) -> DataFrame:
    """Sums and means of prices that do not depend on the order of rows, to the last bit."""
    v = F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))
    return exact_sums(t.read("lineitem").select("l_returnflag", "l_linestatus", v.alias("v")), ["l_returnflag", "l_linestatus"], "v")

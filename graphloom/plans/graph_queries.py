"""Graph retrieval, merging, pruning and derivation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..derive import CONCEPTS, N_RELATIONS, Tables
from ..operators import graph as G
from ..operators import prune as P
from ..sources.shared import written
from ..vocab import relation_table
from .base import query

joined = lambda c: F.array_join(c, ",")

DEGREE = ", degree AS (SELECT stmt, cid, count(*) AS degree FROM (SELECT stmt, src AS cid FROM edge UNION ALL SELECT stmt, tgt FROM edge) GROUP BY ALL)"
NBRS = ", nbrs AS (SELECT stmt, cid, count(*) AS nbrs FROM adj GROUP BY ALL)"
KINDS = """, touch AS (SELECT adj.stmt, adj.cid, bool_or(q) AS tq, bool_or(a) AS ta FROM adj JOIN flag ON flag.stmt = adj.stmt AND flag.cid = adj.nbr GROUP BY ALL),
kinds AS (SELECT flag.stmt, flag.cid, CASE WHEN tq AND ta THEN 'q_and_a' WHEN tq THEN 'q_only' WHEN ta THEN 'a_only' ELSE 'neither' END AS kind
          FROM flag LEFT JOIN touch USING (stmt, cid) WHERE NOT (q OR a))"""
CORE = NBRS + """, core AS (SELECT stmt, cid, q, a, coalesce(nbrs, 0) AS nbrs, row_number() OVER (PARTITION BY stmt ORDER BY q DESC, coalesce(nbrs, 0) DESC, cid) AS rank,
                 count(*) OVER (PARTITION BY stmt) AS core_size FROM flag LEFT JOIN nbrs USING (stmt, cid) WHERE q OR a)"""
FILL = KINDS + """, corenbr AS (SELECT adj.stmt, adj.cid, count(*) AS core_nbrs FROM adj JOIN flag ON flag.stmt = adj.stmt AND flag.cid = adj.nbr WHERE q OR a GROUP BY ALL),
cand AS (SELECT stmt, cid, kind, coalesce(core_nbrs, 0) AS core_nbrs, coalesce(nbrs, 0) AS nbrs FROM kinds LEFT JOIN corenbr USING (stmt, cid) LEFT JOIN nbrs USING (stmt, cid))"""
PAIRS = """, pairs AS (
  SELECT stmt, src, rel, tgt, priority, relation FROM (
    SELECT e.*, priority, relation, row_number() OVER (PARTITION BY stmt, least(src, tgt), greatest(src, tgt) ORDER BY priority, src, relation, tgt) AS r
    FROM {edges} e JOIN relation USING (rel)) WHERE r = 1),
life AS (
  SELECT DISTINCT stmt, src, rel, tgt FROM (
    SELECT p.stmt, p.src, p.rel, p.tgt, row_number() OVER (PARTITION BY p.stmt, c.cid ORDER BY priority, src, relation, tgt) AS r
    FROM pairs p JOIN {core} c ON c.stmt = p.stmt AND (c.cid = p.src OR c.cid = p.tgt)) WHERE r = 1)"""


@query(DEGREE + " SELECT * FROM degree")
def edge_degree(t: Tables) -> DataFrame:
    return G.edge_degree(t.edge)


@query(DEGREE + " SELECT stmt, degree, string_agg(cid, ',' ORDER BY cid) AS cids FROM degree JOIN (SELECT stmt, max(degree) AS degree FROM degree GROUP BY stmt) USING (stmt, degree) GROUP BY ALL")
def highest_degree_nodes(t: Tables) -> DataFrame:
    return G.highest_nodes(G.edge_degree(t.edge)).withColumn("cids", joined("cids"))


@query(NBRS + " SELECT * FROM nbrs")
def neighbor_count(t: Tables) -> DataFrame:
    return G.neighbor_count(t.edge)


@query(" SELECT stmt, cid, count(*) AS degree, string_agg(nbr, ',' ORDER BY nbr) AS neighbors FROM adj GROUP BY ALL")
def neighbor_listing(t: Tables) -> DataFrame:
    return G.adjacency(t.edge).groupBy("stmt", "cid").agg(F.count("*").alias("degree"), joined(F.array_sort(F.collect_list("nbr"))).alias("neighbors"))


@query(" SELECT stmt, cid, in_question, array_to_string(in_choices, ',') AS letters FROM node")
def merge_choice_nodes(t: Tables) -> DataFrame:
    return t.node.select("stmt", "cid", "in_question", joined("in_choices").alias("letters"))


@query(" SELECT * FROM edge")
def merge_choice_edges(t: Tables) -> DataFrame:
    return t.edge


@query(f""" , coo AS (SELECT stmt, rel * {CONCEPTS} + src AS row, tgt AS col, (src + tgt) % 5 AS value FROM edge)
SELECT stmt, CAST(row % {CONCEPTS} AS INTEGER) AS src, CAST(row // {CONCEPTS} AS INTEGER) AS rel, col AS tgt FROM coo WHERE value <> 0""")
def decode_coo(t: Tables) -> DataFrame:
    coo = t.edge.select("stmt", (F.col("rel") * CONCEPTS + F.col("src")).alias("row"), F.col("tgt").alias("col"), ((F.col("src") + F.col("tgt")) % 5).alias("value"))
    return G.decode_coo(coo, CONCEPTS)


def _filler(rule: str, where: str, order: str):
    @query(NBRS + FILL + f" SELECT stmt, cid, core_nbrs, nbrs, CAST(row_number() OVER (PARTITION BY stmt ORDER BY {order}) AS INTEGER) AS rank FROM cand WHERE {where}", name=f"filler_candidates_{rule.replace('-', '_')}")
    def candidates(t: Tables) -> DataFrame:
        return P.fillers(*t.graph, rule)


_filler("qa-bridge", "kind = 'q_and_a'", "core_nbrs DESC, cid")
_filler("core-neighbor", "kind <> 'neither'", "core_nbrs DESC, cid")
_filler("any", "true", "core_nbrs DESC, nbrs DESC, cid")
_filler("none", "false", "cid")


@query(CORE + " SELECT stmt, cid, q, a, core_size FROM core WHERE rank <= 3")
def core_truncate(t: Tables) -> DataFrame:
    return P.core(t.node, t.edge, 3).select("stmt", "cid", "q", "a", "core_size")


@query(CORE + " SELECT stmt, cid, q, a, core_size FROM core")
def core_keep(t: Tables) -> DataFrame:
    return P.core(t.node, t.edge, 3, "keep").select("stmt", "cid", "q", "a", "core_size")


ROOM = """, room AS (SELECT stmt, count(*) FILTER (WHERE rank <= 6) AS kept FROM core GROUP BY stmt),
added AS (SELECT stmt, cid, core_nbrs, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY stmt ORDER BY core_nbrs DESC, cid) AS rank FROM cand WHERE kind <> 'neither') LEFT JOIN room USING (stmt) WHERE rank <= greatest(0, 6 - coalesce(kept, 0)))"""


@query(CORE + FILL + ROOM + " SELECT stmt, cid, core_nbrs, CAST(rank AS INTEGER) AS rank FROM added")
def filler_budget(t: Tables) -> DataFrame:
    return P.chosen_fillers(*t.graph, "core-neighbor", 6)


@query(CORE + FILL + " SELECT stmt, cid, core_nbrs, rank FROM (SELECT stmt, cid, core_nbrs, CAST(row_number() OVER (PARTITION BY stmt ORDER BY core_nbrs DESC, cid) AS INTEGER) AS rank FROM cand WHERE kind <> 'neither') LEFT JOIN (SELECT DISTINCT stmt, core_size FROM core) USING (stmt) WHERE rank <= least(2, greatest(0, 5 - coalesce(core_size, 0)))")
def adaptive_cap(t: Tables) -> DataFrame:
    return P.chosen_fillers(*t.graph, "core-neighbor", 5, "keep", max_bridges=2)


@query(PAIRS.format(edges="edge", core="flag") + " SELECT stmt, src, rel, tgt, priority FROM pairs")
def dedupe_relation_pairs(t: Tables) -> DataFrame:
    return G.dedupe_pairs(t.edge, relation_table(t.spark)).drop("relation")


@query(", cores AS (SELECT * FROM flag WHERE q OR a)" + PAIRS.format(edges="edge", core="cores") + " SELECT stmt, src, rel, tgt FROM life")
def lifeline_edges(t: Tables) -> DataFrame:
    pairs = G.dedupe_pairs(t.edge, relation_table(t.spark))
    return G.lifelines(pairs, G.flags(t.node).filter("q or a")).select("stmt", "src", "rel", "tgt")


BUDGET = """ SELECT stmt, src, rel, tgt FROM (
  SELECT p.*, row_number() OVER (PARTITION BY stmt ORDER BY (l.stmt IS NOT NULL) DESC, priority, src, relation, tgt) AS r
  FROM pairs p LEFT JOIN life l USING (stmt, src, rel, tgt)) WHERE r <= {n}"""


@query(", cores AS (SELECT * FROM flag WHERE q OR a)" + PAIRS.format(edges="edge", core="cores") + BUDGET.format(n=5))
def edge_budget(t: Tables) -> DataFrame:
    pairs = G.dedupe_pairs(t.edge, relation_table(t.spark))
    return G.edge_budget(pairs, G.lifelines(pairs, G.flags(t.node).filter("q or a")), 5).select("stmt", "src", "rel", "tgt")


PRUNED = CORE + FILL + ROOM + """, keptcore AS (SELECT stmt, cid FROM core WHERE rank <= 6), kept AS (SELECT * FROM keptcore UNION ALL SELECT stmt, cid FROM added),
ind AS (SELECT e.* FROM edge e SEMI JOIN kept k1 ON k1.stmt = e.stmt AND k1.cid = e.src SEMI JOIN kept k2 ON k2.stmt = e.stmt AND k2.cid = e.tgt)""" + PAIRS.format(edges="ind", core="keptcore") + """,
final AS (""" + BUDGET.format(n=4) + ")"


def _pruned(t: Tables) -> dict[str, DataFrame]:
    return P.prune(t.node, t.edge, relation_table(t.spark), max_nodes=6, max_edges=4, rule="core-neighbor")


@query(PRUNED + " SELECT * FROM final")
def pruned_edges(t: Tables) -> DataFrame:
    return _pruned(t)["edges"]


@query(PRUNED + """ SELECT k.stmt, k.cid, q, a, e.cid IS NOT NULL AS connected
FROM kept k JOIN flag USING (stmt, cid) LEFT JOIN (SELECT stmt, src AS cid FROM final UNION SELECT stmt, tgt FROM final) e USING (stmt, cid) WHERE e.cid IS NOT NULL OR a""")
def visible_nodes(t: Tables) -> DataFrame:
    return _pruned(t)["visible"]


@query(PRUNED + """ SELECT stmt, coalesce(core_size, 0) AS core_size, coalesce(core_kept, 0) AS core_kept, coalesce(n, 0) AS bridges_added, coalesce(b, 0) AS edges_before, coalesce(c, 0) AS edges_after
FROM (SELECT DISTINCT stmt FROM node)
LEFT JOIN (SELECT stmt, max(core_size) AS core_size, count(*) FILTER (WHERE rank <= 6) AS core_kept FROM core GROUP BY stmt) USING (stmt)
LEFT JOIN (SELECT stmt, count(*) AS n FROM added GROUP BY stmt) USING (stmt)
LEFT JOIN (SELECT stmt, count(*) AS b FROM pairs GROUP BY stmt) USING (stmt) LEFT JOIN (SELECT stmt, count(*) AS c FROM final GROUP BY stmt) USING (stmt)""")
def prune_summary(t: Tables) -> DataFrame:
    return _pruned(t)["info"]


@query()
def degree_cap(t: Tables) -> DataFrame:
    return P.prune(t.node, t.edge, relation_table(t.spark), max_nodes=0, max_edges=0, max_degree=2, rule="any")["edges"]


@query(KINDS + " SELECT * FROM kinds")
def added_node_types(t: Tables) -> DataFrame:
    return G.added_types(t.edge, t.node)


@query(KINDS + """ SELECT stmt, count(*) AS nodes, count(*) FILTER (WHERE q OR a) AS core, count(*) FILTER (WHERE q AND a) AS overlap, count(*) FILTER (WHERE kind = 'q_and_a') AS bridges
FROM flag LEFT JOIN kinds USING (stmt, cid) GROUP BY stmt""")
def question_sizes(t: Tables) -> DataFrame:
    facts = G.around(t.edge, t.node)
    rows = facts.withColumn("kind", F.when(~F.coalesce("q", F.lit(False)) & ~F.coalesce("a", F.lit(False)) & F.col("touches_q") & F.col("touches_a"), "q_and_a"))
    return rows.groupBy("stmt").agg(F.count("*").alias("nodes"), F.count_if(F.expr("q or a")).alias("core"), F.count_if(F.expr("q and a")).alias("overlap"), F.count_if(F.col("kind") == "q_and_a").alias("bridges"))


BFS = """, walk(stmt, cid, d) AS (
  SELECT stmt, cid, 0 FROM flag WHERE q
  UNION SELECT walk.stmt, adj.nbr, d + 1 FROM walk JOIN adj ON adj.stmt = walk.stmt AND adj.cid = walk.cid WHERE d < 41),
dist AS (SELECT stmt, cid, min(d) AS dist FROM walk GROUP BY ALL)"""


@query(BFS + " SELECT * FROM dist")
def bfs_distance(t: Tables) -> DataFrame:
    return G.frontier_distance(t.edge, G.flags(t.node).filter("q"))


@query(BFS + """ SELECT n.stmt, l.letter, bool_or(d.cid IS NOT NULL) AS reachable, min(d.dist) AS nearest
FROM (SELECT stmt, cid, unnest(in_choices) AS letter FROM node) l JOIN node n USING (stmt, cid) LEFT JOIN dist d USING (stmt, cid) GROUP BY ALL""")
def reachable_options(t: Tables) -> DataFrame:
    options = t.node.select("stmt", "cid", F.explode("in_choices").alias("letter"))
    dist = G.frontier_distance(t.edge, G.flags(t.node).filter("q"))
    return options.join(dist, ["stmt", "cid"], "left").groupBy("stmt", "letter").agg(F.bool_or(F.col("dist").isNotNull()).alias("reachable"), F.min("dist").alias("nearest"))


@query(""" SELECT stmt, string_agg('(' || src || ', ' || relation_text || ', ' || tgt || ')', chr(10) ORDER BY '(' || src || ', ' || relation_text || ', ' || tgt || ')') AS triples
FROM edge JOIN relation USING (rel) GROUP BY stmt""")
def linearise_triples(t: Tables) -> DataFrame:
    return G.linearise(t.edge, relation_table(t.spark))


GOLD = ", gold AS (SELECT stmt, cid FROM node WHERE list_contains(in_choices, chr(CAST(65 + stmt % 4 AS INTEGER))))"


@query(GOLD + " SELECT e.* FROM edge e WHERE EXISTS (SELECT 1 FROM gold g WHERE g.stmt = e.stmt AND (g.cid = e.src OR g.cid = e.tgt))")
def gold_answer_edges(t: Tables) -> DataFrame:
    gold = t.node.filter(F.array_contains("in_choices", F.char(F.lit(65) + F.col("stmt") % 4))).select("stmt", "cid")
    lists = gold.groupBy("stmt").agg(F.collect_list("cid").alias("gold"))
    return t.edge.join(lists, "stmt").filter(F.array_contains("gold", F.col("src")) | F.array_contains("gold", F.col("tgt"))).drop("gold")


@query("""SELECT a.s_nationkey AS graph, a.s_suppkey AS id_a, b.s_suppkey AS id_b FROM supplier a JOIN supplier b
ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND a.s_acctbal < b.s_acctbal + 900 AND b.s_acctbal < a.s_acctbal + 900
AND a.s_suppkey % 50 < b.s_suppkey % 50 + 15 AND b.s_suppkey % 50 < a.s_suppkey % 50 + 15""")
def label_box_overlap(t: Tables) -> DataFrame:
    x, y = F.col("s_acctbal"), F.col("s_suppkey") % 50
    return G.boxes_overlap(t.read("supplier").select(F.col("s_nationkey").alias("graph"), F.col("s_suppkey").alias("id"), x.alias("x0"), (x + 900).alias("x1"), y.alias("y0"), (y + 15).alias("y1")))


@query(""" SELECT stmt, relation, count(*) AS n FROM edge JOIN relation USING (rel) GROUP BY ALL""")
def relation_histogram(t: Tables) -> DataFrame:
    return t.edge.groupBy("stmt", "rel").agg(F.count("*").alias("n")).join(F.broadcast(relation_table(t.spark)), "rel").select("stmt", "relation", "n")


@query(f""", first AS (SELECT DISTINCT stmt, src, tgt, rel FROM choice_edge WHERE choice IN (0, 1)), second AS (SELECT DISTINCT stmt, src, tgt, rel FROM choice_edge WHERE choice IN (1, 2))
SELECT stmt, count(*) FILTER (WHERE a AND b) AS shared, count(*) AS either, CASE WHEN count(*) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE a AND b) / count(*) END AS jaccard
FROM (SELECT stmt, src, tgt, rel, bool_or(w = 1) AS a, bool_or(w = 2) AS b FROM (SELECT *, 1 AS w FROM first UNION ALL SELECT *, 2 FROM second) GROUP BY ALL) GROUP BY stmt""")
def jaccard_sets(t: Tables) -> DataFrame:
    some = t.choice_edge.filter("choice < 3").groupBy("stmt", "src", "tgt", "rel").agg(F.bool_or(F.col("choice") <= 1).alias("a"), F.bool_or(F.col("choice") >= 1).alias("b"))
    shared, either = F.count_if(F.expr("a and b")), F.count("*")
    return some.groupBy("stmt").agg(shared.alias("shared"), either.alias("either"), F.when(either == 0, 1.0).otherwise(shared / either).alias("jaccard"))


@query(""" SELECT stmt, members, count(*) AS n FROM (SELECT stmt, src, tgt, string_agg(DISTINCT chr(97 + choice), '' ORDER BY chr(97 + choice)) AS members FROM choice_edge WHERE choice < 3 GROUP BY ALL) GROUP BY ALL""")
def membership_classes(t: Tables) -> DataFrame:
    names = F.array_join(F.array_sort(F.collect_set(F.char(97 + F.col("choice")))), "")
    return t.choice_edge.filter("choice < 3").groupBy("stmt", "src", "tgt").agg(names.alias("members")).groupBy("stmt", "members").agg(F.count("*").alias("n"))


@query(" SELECT * FROM ((SELECT stmt, src, tgt FROM choice_edge WHERE choice = 0) EXCEPT (SELECT stmt, src, tgt FROM choice_edge WHERE choice = 1))")
def edge_set_difference(t: Tables) -> DataFrame:
    side = lambda c: t.choice_edge.filter(F.col("choice") == c).select("stmt", "src", "tgt")
    return side(0).subtract(side(1))


@query(" SELECT * FROM ((SELECT stmt, src, tgt FROM choice_edge WHERE choice = 0) INTERSECT (SELECT stmt, src, tgt FROM choice_edge WHERE choice = 1))")
def edge_set_intersection(t: Tables) -> DataFrame:
    side = lambda c: t.choice_edge.filter(F.col("choice") == c).select("stmt", "src", "tgt")
    return side(0).intersect(side(1))


@query(""", cp AS (SELECT src, tgt, rel, min(ord) AS ord FROM seen WHERE stmt % 3 = 0 GROUP BY ALL), link AS (SELECT DISTINCT src, tgt FROM edge WHERE stmt % 3 = 1),
f AS (SELECT l.src, l.tgt, arg_min(rel, ord) FILTER (WHERE rel <> 15) AS best, arg_min(rel, ord) AS any_rel FROM link l JOIN cp USING (src, tgt) GROUP BY ALL),
r AS (SELECT DISTINCT l.src, l.tgt FROM link l JOIN cp ON cp.src = l.tgt AND cp.tgt = l.src)
SELECT link.src, link.tgt, coalesce(best, any_rel) AS rel, CASE WHEN f.src IS NOT NULL THEN 'kept' WHEN r.src IS NOT NULL THEN 'direction' ELSE 'missing' END AS reason
FROM link LEFT JOIN f USING (src, tgt) LEFT JOIN r USING (src, tgt)""")
def first_relation_pick(t: Tables) -> DataFrame:
    """Each link's relation: the first one seen in the concept graph but the vaguest, or why there is none."""
    cp = t.seen.filter("stmt % 3 = 0").groupBy("src", "tgt", "rel").agg(F.min("ord").alias("ord"))
    link = t.edge.filter("stmt % 3 = 1").select("src", "tgt").distinct()
    plain = F.when((F.col("rel") < N_RELATIONS) & (F.col("rel") != 15), F.struct("ord", "rel"))
    known = F.when(F.col("rel") < N_RELATIONS, F.struct("ord", "rel"))
    forward = cp.groupBy("src", "tgt").agg(F.coalesce(F.min(plain), F.min(known)).alias("first")).filter("first is not null")
    back = cp.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.lit(True).alias("back")).distinct()
    rows = link.join(forward, ["src", "tgt"], "left").join(back, ["src", "tgt"], "left")
    reason = F.when(F.col("first").isNotNull(), "kept").when(F.col("back"), "direction").otherwise("missing")
    return rows.select("src", "tgt", F.col("first.rel").alias("rel"), reason.alias("reason"))


@query(""", cp AS (SELECT DISTINCT rel, src, tgt FROM edge WHERE stmt % 3 = 0), link AS (SELECT DISTINCT src, tgt FROM edge WHERE stmt % 3 = 1)
SELECT DISTINCT cp.* FROM cp JOIN link ON (cp.src = link.src AND cp.tgt = link.tgt) OR (cp.src = link.tgt AND cp.tgt = link.src)""")
def lossless_edges(t: Tables) -> DataFrame:
    cp = t.edge.filter("stmt % 3 = 0").select("rel", "src", "tgt").distinct()
    link = t.edge.filter("stmt % 3 = 1").select("src", "tgt").distinct()
    both = link.unionByName(link.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))).distinct()
    return cp.join(both, ["src", "tgt"], "left_semi").select("rel", "src", "tgt")


@query(""" SELECT stmt, count(*) AS parallel_pairs FROM (SELECT stmt, least(src, tgt) AS lo, greatest(src, tgt) AS hi FROM edge GROUP BY ALL HAVING count(*) > 1) GROUP BY stmt""")
def parallel_pairs(t: Tables) -> DataFrame:
    pairs = t.edge.groupBy("stmt", F.least("src", "tgt").alias("lo"), F.greatest("src", "tgt").alias("hi")).count().filter("count > 1")
    return pairs.groupBy("stmt").agg(F.count("*").alias("parallel_pairs"))


OPTION = DEGREE + """, letters(letter) AS (VALUES ('A'), ('B'), ('C'), ('D')),
opt AS (SELECT s.stmt, letter, coalesce(max(degree), 0) AS degree FROM (SELECT DISTINCT stmt FROM node) s CROSS JOIN letters
        LEFT JOIN (SELECT stmt, cid, unnest(in_choices) AS letter FROM node) n USING (stmt, letter) LEFT JOIN degree USING (stmt, cid) GROUP BY ALL)"""


def option_table(t: Tables) -> DataFrame:
    """Highest degree of each option's nodes, 0 where it has none."""
    node, edge = t.graph
    members = node.select("stmt", "cid", F.explode("in_choices").alias("letter"))
    best = members.join(G.edge_degree(edge), ["stmt", "cid"]).groupBy("stmt", "letter").agg(F.max("degree").alias("degree"))
    grid = node.select("stmt").distinct().withColumn("letter", F.explode(F.array(*map(F.lit, "ABCD"))))
    return grid.join(best, ["stmt", "letter"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


@query(OPTION + " SELECT * FROM opt")
def option_degree(t: Tables) -> DataFrame:
    return option_table(t)


@query(OPTION + """ SELECT stmt, gold, gold_degree, letter AS best_distractor, degree AS best_degree, CASE WHEN gold_degree > degree THEN 'win' WHEN gold_degree = degree THEN 'tie' ELSE 'loss' END AS verdict FROM (
  SELECT o.stmt, g.letter AS gold, g.degree AS gold_degree, o.letter, o.degree, row_number() OVER (PARTITION BY o.stmt ORDER BY o.degree DESC, o.letter) AS r
  FROM opt o JOIN opt g ON g.stmt = o.stmt AND g.letter = chr(CAST(65 + o.stmt % 4 AS INTEGER)) WHERE o.letter <> g.letter) WHERE r = 1""")
def option_verdicts(t: Tables) -> DataFrame:
    options = option_table(t).withColumn("is_gold", F.col("letter") == F.char(F.lit(65) + F.col("stmt") % 4))
    per = options.groupBy("stmt").agg(
        F.max(F.when(F.col("is_gold"), F.struct("letter", "degree"))).alias("g"),
        F.min(F.when(~F.col("is_gold"), F.struct((-F.col("degree")).alias("neg"), "letter", "degree"))).alias("d"),
    )
    verdict = F.when(F.col("g.degree") > F.col("d.degree"), "win").when(F.col("g.degree") == F.col("d.degree"), "tie").otherwise("loss")
    return per.select("stmt", F.col("g.letter").alias("gold"), F.col("g.degree").alias("gold_degree"), F.col("d.letter").alias("best_distractor"), F.col("d.degree").alias("best_degree"), verdict.alias("verdict"))


@query(OPTION + """ SELECT count(*) AS pairs, count(*) FILTER (WHERE g.degree > o.degree) AS wins, count(*) FILTER (WHERE g.degree = o.degree) AS ties,
(count(*) FILTER (WHERE g.degree > o.degree) + 0.5 * count(*) FILTER (WHERE g.degree = o.degree)) / count(*) AS win_rate
FROM opt o JOIN opt g ON g.stmt = o.stmt AND g.letter = chr(CAST(65 + o.stmt % 4 AS INTEGER)) WHERE o.letter <> g.letter""")
def pairwise_win_rate(t: Tables) -> DataFrame:
    options = option_table(t).withColumn("is_gold", F.col("letter") == F.char(F.lit(65) + F.col("stmt") % 4))
    gold = options.filter("is_gold").select("stmt", F.col("degree").alias("gd"))
    w, e = F.count_if(F.expr("gd > degree")), F.count_if(F.expr("gd = degree"))
    return options.filter("not is_gold").join(gold, "stmt").agg(F.count("*").alias("pairs"), w.alias("wins"), e.alias("ties"), ((w + 0.5 * e) / F.count("*")).alias("win_rate"))


@query(BFS + """, v AS (SELECT n.stmt, n.cid, len(in_choices) > 0 AS a, dist, coalesce(d.degree, 0) AS degree FROM node n LEFT JOIN dist USING (stmt, cid)
LEFT JOIN (SELECT stmt, cid, count(*) AS degree FROM (SELECT stmt, src AS cid FROM edge UNION ALL SELECT stmt, tgt FROM edge) GROUP BY ALL) d USING (stmt, cid))
SELECT stmt, count(*) AS nodes, count(*) FILTER (WHERE degree = 0) AS degree_zero, count(*) FILTER (WHERE a) AS answers, count(*) FILTER (WHERE a AND dist IS NOT NULL) AS answers_reachable,
CASE WHEN count(*) FILTER (WHERE a) > 0 THEN count(*) FILTER (WHERE a AND dist IS NOT NULL) / count(*) FILTER (WHERE a) END AS reachable_share, max(dist) FILTER (WHERE a) AS farthest FROM v GROUP BY stmt""")
def connectivity_summary(t: Tables) -> DataFrame:
    v = t.node.select("stmt", "cid", (F.size("in_choices") > 0).alias("a")).join(G.frontier_distance(t.edge, G.flags(t.node).filter("q")), ["stmt", "cid"], "left").join(G.edge_degree(t.edge), ["stmt", "cid"], "left")
    answers, found = F.count_if("a"), F.count_if(F.col("a") & F.col("dist").isNotNull())
    return v.groupBy("stmt").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("degree").isNull()).alias("degree_zero"), answers.alias("answers"), found.alias("answers_reachable"),
        F.try_divide(found, answers).alias("reachable_share"), F.max(F.when(F.col("a"), F.col("dist"))).alias("farthest"),
    )


@query(NBRS + KINDS + """ SELECT count(DISTINCT stmt) AS questions, count(*) AS core_nodes, median(nbrs) AS median_nbrs, quantile_cont(nbrs, 0.9) AS p90_nbrs,
(SELECT avg(share) FROM (SELECT stmt, count(*) FILTER (WHERE kind = 'q_and_a') / count(*) AS share FROM kinds GROUP BY stmt)) AS mean_bridge_share
FROM (SELECT f.stmt, coalesce(nbrs, 0) AS nbrs FROM flag f LEFT JOIN nbrs USING (stmt, cid) WHERE q OR a)""")
def sweep_metric_row(t: Tables) -> DataFrame:
    facts = written(t.spark, G.around(t.edge, t.node))
    core = facts.filter("q or a").agg(F.count_distinct("stmt").alias("questions"), F.count("*").alias("core_nodes"), F.median("nbrs").alias("median_nbrs"), F.percentile("nbrs", F.lit(0.9)).alias("p90_nbrs"))
    share = G.kinds(facts).groupBy("stmt").agg((F.count_if(F.col("kind") == "q_and_a") / F.count("*")).alias("share")).agg(F.avg("share").alias("mean_bridge_share"))
    return core.join(share)


@query(BFS + """, b AS (SELECT dist, CASE WHEN dist IS NULL THEN 'unreachable' WHEN dist = 0 THEN 'in_question' WHEN dist = 1 THEN 'adjacent' WHEN dist <= 3 THEN 'near' ELSE 'far' END AS bucket FROM node LEFT JOIN dist USING (stmt, cid) WHERE len(in_choices) > 0)
SELECT bucket, dist, count(*) AS answers, count(*) / sum(count(*)) OVER () AS share FROM b GROUP BY ALL""")
def distance_distribution(t: Tables) -> DataFrame:
    """How far answer concepts are from the question's, as a histogram with named buckets."""
    answers = t.node.filter(F.size("in_choices") > 0).select("stmt", "cid")
    d = F.col("dist")
    bucket = F.when(d.isNull(), "unreachable").when(d == 0, "in_question").when(d == 1, "adjacent").when(d <= 3, "near").otherwise("far")
    counts = answers.join(G.frontier_distance(t.edge, G.flags(t.node).filter("q")), ["stmt", "cid"], "left").groupBy(bucket.alias("bucket"), "dist").agg(F.count("*").alias("answers"))
    total = counts.agg(F.sum("answers").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("bucket", "dist", "answers", (F.col("answers") / F.col("total")).alias("share"))


@query(OPTION + BFS + """, o AS (SELECT opt.*, near FROM opt LEFT JOIN (SELECT stmt, letter, min(dist) AS near FROM (SELECT stmt, cid, unnest(in_choices) AS letter FROM node) JOIN dist USING (stmt, cid) GROUP BY ALL) USING (stmt, letter))
SELECT stmt, letter AS best_distractor, degree, near FROM o WHERE letter <> chr(CAST(65 + stmt % 4 AS INTEGER)) QUALIFY row_number() OVER (PARTITION BY stmt ORDER BY degree DESC, near NULLS LAST, letter) = 1""")
def best_distractors(t: Tables) -> DataFrame:
    """Of each question's wrong options the one of highest degree, then the nearest, then the first letter."""
    dist = G.frontier_distance(t.edge, G.flags(t.node).filter("q"))
    near = t.node.select("stmt", "cid", F.explode("in_choices").alias("letter")).join(dist, ["stmt", "cid"]).groupBy("stmt", "letter").agg(F.min("dist").alias("near"))
    wrong = option_table(t).filter(F.col("letter") != F.char(F.lit(65) + F.col("stmt") % 4)).join(near, ["stmt", "letter"], "left")
    best = F.min(F.struct((-F.col("degree")).alias("neg"), F.col("near").isNull().alias("none"), "near", "letter", "degree"))
    return wrong.groupBy("stmt").agg(best.alias("b")).select("stmt", F.col("b.letter").alias("best_distractor"), "b.degree", "b.near")

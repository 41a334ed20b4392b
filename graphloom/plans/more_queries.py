"""Selections, nested paths, evidence and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..derive import Tables
from ..functions import text as X
from ..operators import graph as G
from ..operators.similar import near_in_rows
from ..sources.jsonl import ordered_digest
from ..vocab import relation_table
from .base import query
from .text_queries import WHITE, one_byte

OK = "coalesce(pred = gold, false)"


@query("SELECT pos, o.o_orderkey, o_custkey FROM (VALUES (1, 7), (2, 3), (3, 33)) v(pos, k) JOIN orders o ON o_orderkey = k")
def list_selection(t: Tables) -> DataFrame:
    """Chosen rows in the order of the list."""
    chosen = t.spark.createDataFrame([(1, 7), (2, 3), (3, 33)], "pos int, k long")
    return t.read("orders").join(F.broadcast(chosen), F.col("o_orderkey") == F.col("k")).select("pos", "o_orderkey", "o_custkey")


@query("SELECT * FROM (SELECT user_id, event_id, event_type FROM events WHERE user_id = (SELECT min(user_id) FROM events))")
def minimum_key_group(t: Tables) -> DataFrame:
    e = t.read("events")
    low = e.agg(F.min("user_id").alias("m"))  # one row
    return e.join(F.broadcast(low), F.col("user_id") == F.col("m")).select("user_id", "event_id", "event_type")


@query(", paths AS (SELECT stmt, src, list(tgt ORDER BY tgt) AS path FROM edge GROUP BY stmt, src) SELECT stmt, count(*) AS raw_paths, count(*) FILTER (WHERE len(path) BETWEEN 2 AND 3) AS kept_paths FROM paths GROUP BY stmt")
def nested_path_counts(t: Tables) -> DataFrame:
    """Paths nested in rows: how many there are and how many have two or three nodes."""
    per = t.edge.groupBy("stmt", "src").agg(F.array_sort(F.collect_list("tgt")).alias("path")).groupBy("stmt").agg(F.collect_list("path").alias("rows"))
    kept = F.filter("rows", lambda p: F.size(p).between(2, 3))
    return per.select("stmt", F.size("rows").cast("long").alias("raw_paths"), F.size(kept).cast("long").alias("kept_paths"))


@query(""", f AS (SELECT stmt, src AS cid, rel, min(ord) AS ord FROM seen GROUP BY ALL), r AS (SELECT stmt, cid, list(rel ORDER BY ord) AS r FROM f GROUP BY ALL)
SELECT stmt, cid, array_to_string(CASE WHEN len(r) > 1 THEN list_filter(r, lambda x: x <> 15) ELSE r END, ',') AS rels FROM r""")
def relation_filter(t: Tables) -> DataFrame:
    """Distinct relations of a node in the order in which they were first seen; the vaguest goes where there are others."""
    first = t.seen.groupBy("stmt", F.col("src").alias("cid"), "rel").agg(F.min("ord").alias("ord"))
    r = first.groupBy("stmt", "cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "rel"))), lambda x: x["rel"]).alias("r"))
    return r.select("stmt", "cid", F.array_join(F.when(F.size("r") > 1, F.array_remove("r", 15)).otherwise(F.col("r")), ",").alias("rels"))


@query(" SELECT stmt, relation, count(*) AS n, avg(CASE WHEN src < tgt THEN 1.0 ELSE 0.0 END) AS accuracy FROM edge JOIN relation USING (rel) WHERE relation <> 'relatedto' GROUP BY ALL")
def per_relation_accuracy(t: Tables) -> DataFrame:
    rows = t.edge.join(F.broadcast(relation_table(t.spark)), "rel").filter("relation <> 'relatedto'")
    return rows.groupBy("stmt", "relation").agg(F.count("*").alias("n"), F.avg((F.col("src") < F.col("tgt")).cast("double")).alias("accuracy"))


@query(", d AS (SELECT stmt, cid, count(*) AS degree FROM (SELECT stmt, src AS cid FROM edge UNION ALL SELECT stmt, tgt FROM edge) GROUP BY ALL), n AS (SELECT stmt, cid, count(*) AS nbrs FROM adj GROUP BY ALL) SELECT degree, count(*) AS n, avg(nbrs) AS mean_nbrs FROM d JOIN n USING (stmt, cid) GROUP BY degree")
def by_degree_averages(t: Tables) -> DataFrame:
    return G.edge_degree(t.edge).join(G.neighbor_count(t.edge), ["stmt", "cid"]).groupBy("degree").agg(F.count("*").alias("n"), F.avg("nbrs").alias("mean_nbrs"))


@query(", f AS (SELECT stmt, count(*) FILTER (WHERE a) AS gold, count(*) FILTER (WHERE a AND cid % 2 = 0) AS found FROM flag GROUP BY stmt) SELECT CAST(sum(found) AS BIGINT) AS found, CAST(sum(gold) AS BIGINT) AS gold, CASE WHEN sum(gold) = 0 THEN 1.0 ELSE sum(found) / sum(gold) END AS recall FROM f")
def component_recall(t: Tables) -> DataFrame:
    a = G.flags(t.node).filter("a").agg(F.count_if(F.expr("cid % 2 = 0")).alias("found"), F.count("*").alias("gold"))
    return a.withColumn("recall", F.when(F.col("gold") == 0, 1.0).otherwise(F.col("found") / F.nullif(F.col("gold"), F.lit(0))))


@query(f", m AS (SELECT arm, gold, avg(CASE WHEN {OK} THEN 1.0 ELSE 0.0 END) AS v FROM outcome GROUP BY ALL) SELECT arm, CASE WHEN count(v) = 4 THEN avg(v) END AS macro FROM m GROUP BY arm")
def macro_over_primaries(t: Tables) -> DataFrame:
    m = t.outcome.groupBy("arm", "gold").agg(F.avg(F.coalesce((F.col("pred") == F.col("gold")).cast("double"), F.lit(0.0))).alias("v"))
    return m.groupBy("arm").agg(F.when(F.count("v") == 4, F.avg("v")).alias("macro"))


@query(f", q AS (SELECT arm, item % 7 AS kind, item % 50 AS graph, avg(CASE WHEN {OK} THEN 1.0 ELSE 0.0 END) AS v FROM outcome GROUP BY ALL) SELECT arm, kind, count(DISTINCT graph) AS graphs, avg(v) AS mean FROM q GROUP BY ALL")
def question_type_mean(t: Tables) -> DataFrame:
    v = F.avg(F.coalesce((F.col("pred") == F.col("gold")).cast("double"), F.lit(0.0))).alias("v")
    q = t.outcome.groupBy("arm", (F.col("item") % 7).alias("kind"), (F.col("item") % 50).alias("graph")).agg(v)
    return q.groupBy("arm", "kind").agg(F.count_distinct("graph").alias("graphs"), F.avg("v").alias("mean"))


@query("SELECT event_type, count(*) AS n, avg(value) AS mean_value, max(value) AS max_value, sum(400 * value) AS cost FROM events GROUP BY ALL")
def job_summary(t: Tables) -> DataFrame:
    return t.read("events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"), F.sum(400 * F.col("value")).alias("cost"))


@query("SELECT l_returnflag AS arm, count(*) AS n, count(*) FILTER (WHERE l_tax = greatest(l_tax, l_discount)) AS matches, count(*) FILTER (WHERE l_tax = l_discount) AS ties FROM lineitem GROUP BY ALL")
def prefix_agreement(t: Tables) -> DataFrame:
    """Rows whose chosen entry of a score map equals its maximum exactly; ties counted."""
    scores = F.create_map(F.lit("A"), F.col("l_tax"), F.lit("B"), F.col("l_discount"))
    rows = t.read("lineitem").select(F.col("l_returnflag").alias("arm"), scores.alias("m"))
    top = F.array_max(F.map_values("m"))
    return rows.groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.element_at("m", "A") == top).alias("matches"), F.count_if(F.element_at("m", "A") == F.element_at("m", "B")).alias("ties"))


@query(rf""", w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x09-\x0d ]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(ws[len(ws) // 2 + 1:]) AS w FROM w), p AS (SELECT doc_id, unnest(ws[:len(ws) // 2]) AS w FROM w EXCEPT SELECT * FROM g),
gx AS (SELECT *, {one_byte("w")} AS x FROM g), px AS (SELECT *, {one_byte("w")} AS x FROM p),
d AS (SELECT doc_id, p.w AS predicted, g.w AS gold, CAST(levenshtein(p.x, g.x) AS INTEGER) AS distance FROM px p JOIN gx g USING (doc_id) WHERE abs(length(p.w) - length(g.w)) <= 2 AND levenshtein(p.x, g.x) BETWEEN 1 AND 2)
SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, predicted ORDER BY distance, gold) AS INTEGER) AS place FROM d""")
def near_duplicate_evidence(t: Tables) -> DataFrame:
    """Names without an exact match beside gold names of the same row within two edits, nearest first: the words of a text's first half and those of its second."""
    words = F.filter(F.split("text", r"[\x09-\x0d ]+"), lambda x: x != "")
    rows = t.read("documents").select("doc_id", words.alias("ws")).withColumn("half", F.floor(F.size("ws") / 2).cast("int"))
    rows = rows.select("doc_id", F.array_distinct(F.slice("ws", F.lit(1), F.col("half"))).alias("p"), F.array_distinct(F.slice("ws", F.col("half") + 1, F.size("ws"))).alias("g"))
    rows = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("p"))).alias("p"), F.array_distinct(F.flatten(F.collect_list("g"))).alias("g"))
    return near_in_rows(rows.select("doc_id", F.array_except("p", "g").alias("p"), "g"), "doc_id", "p", "g").withColumnsRenamed({"a": "predicted", "b": "gold"})


@query("SELECT a.o_orderkey, a.c = b.c AS same_head, len(a.t) >= 4 AS long_enough FROM (SELECT o_orderkey, string_split(o_orderpriority, '')[1:4] AS c, string_split(o_orderpriority, '') AS t FROM orders) a JOIN (SELECT o_orderkey, string_split('1-URGENT', '')[1:4] AS c FROM orders WHERE o_orderkey % 5 = 0) b USING (o_orderkey)")
def prefix_audit(t: Tables) -> DataFrame:
    """Rescued rows beside their originals: equal first tokens, and enough of them."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    o = t.read("orders").select("o_orderkey", chars(F.col("o_orderpriority")).alias("t"))
    b = t.read("orders").filter("o_orderkey % 5 = 0").select("o_orderkey", chars(F.lit("1-URGENT")).alias("u"))
    return o.join(b, "o_orderkey").select("o_orderkey", F.slice("t", 1, 4).eqNullSafe(F.slice("u", 1, 4)).alias("same_head"), (F.size("t") >= 4).alias("long_enough"))


CLUES = """, made AS (SELECT DISTINCT stmt, src AS artifact, tgt AS person FROM edge WHERE rel % 3 = 1),
q AS (SELECT stmt, min(tgt) FILTER (WHERE rel = 5) AS c1, min(tgt) FILTER (WHERE rel = 0) AS c2 FROM edge GROUP BY stmt)"""


@query(CLUES + """ SELECT m.stmt, person, bool_or(a.src IS NOT NULL) AS clue_1, bool_or(b.src IS NOT NULL) AS clue_2, bool_or(a.src IS NOT NULL AND b.src IS NOT NULL) AS both FROM made m JOIN q USING (stmt)
LEFT JOIN edge a ON a.stmt = m.stmt AND a.src = artifact AND a.rel = 5 AND a.tgt = c1 LEFT JOIN edge b ON b.stmt = m.stmt AND b.src = person AND b.rel = 0 AND b.tgt = c2 GROUP BY ALL""")
def clue_solver(t: Tables) -> DataFrame:
    """Each question's candidates, and whether its clue about their artifact, or the one about themselves, is among its triples."""
    edge = t.edge
    made = edge.filter("rel % 3 = 1").select("stmt", F.col("src").alias("artifact"), F.col("tgt").alias("person")).distinct()
    clue = edge.groupBy("stmt").agg(F.min(F.when(F.col("rel") == 5, F.col("tgt"))).alias("c1"), F.min(F.when(F.col("rel") == 0, F.col("tgt"))).alias("c2"))
    holds = lambda rel, at, which, name: edge.filter(F.col("rel") == rel).join(clue, "stmt").filter(F.col("tgt") == F.col(which)).select("stmt", F.col("src").alias(at), F.lit(True).alias(name)).distinct()
    rows = made.join(holds(5, "artifact", "c1", "x"), ["stmt", "artifact"], "left").join(holds(0, "person", "c2", "y"), ["stmt", "person"], "left")
    rows = rows.select("stmt", "person", F.coalesce("x", F.lit(False)).alias("x"), F.coalesce("y", F.lit(False)).alias("y"))
    return rows.groupBy("stmt", "person").agg(F.bool_or("x").alias("clue_1"), F.bool_or("y").alias("clue_2"), F.bool_or(F.expr("x and y")).alias("both"))


@query("SELECT lang, sha256(string_agg(doc_id || ':' || n_chars, chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY lang")
def manifest_digest(t: Tables) -> DataFrame:
    line = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
    return t.read("documents").groupBy("lang").agg(ordered_digest(F.col("doc_id"), line).alias("digest"))


@query(" SELECT item, arm, r FROM (SELECT item, arm, CAST(row_number() OVER (PARTITION BY arm ORDER BY (pred IS NULL) DESC, coalesce(pred <> gold, true) DESC, item) AS INTEGER) AS r FROM outcome) WHERE r <= 5")
def top_failures(t: Tables) -> DataFrame:
    """Five rows an arm: unparsed first, then wrong, then the rest."""
    w = Window.partitionBy("arm").orderBy(F.col("pred").isNull().desc(), F.coalesce(F.col("pred") != F.col("gold"), F.lit(True)).desc(), "item")
    return t.outcome.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("item", "arm", "r")


@query(""", vague AS (SELECT stmt, bool_and(rel = 15) AS only_vague FROM edge GROUP BY stmt)
SELECT stmt, rel, count(*) FILTER (WHERE keep) AS kept, count(*) AS n FROM (SELECT edge.*, only_vague OR rel <> 15 OR ('0x' || substring(sha256(stmt || ':' || src || ':' || tgt), 58, 7))::BIGINT % 5 = 0 AS keep FROM edge JOIN vague USING (stmt)) GROUP BY ALL""")
def balanced_relations(t: Tables) -> DataFrame:
    """One in five of the vaguest relation is kept, by a stable hash of the edge, and all where a graph has no other."""
    key = F.concat_ws(":", *(F.col(c).cast("string") for c in ("stmt", "src", "tgt")))
    part = F.conv(F.substring(F.sha2(key, 256), 58, 7), 16, 10).cast("long")
    only = t.edge.groupBy("stmt").agg(F.bool_and(F.col("rel") == 15).alias("only_vague"))
    return t.edge.join(only, "stmt").withColumn("keep", F.col("only_vague") | (F.col("rel") != 15) | (part % 5 == 0)).groupBy("stmt", "rel").agg(F.count_if("keep").alias("kept"), F.count("*").alias("n"))


@query(rf"SELECT doc_id, lower(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\A{WHITE}+|{WHITE}+\z', '', 'g')), lambda x: x <> '')[1]) AS first_line FROM documents")
def first_line(t: Tables) -> DataFrame:
    """The first line of each text that is not blank; null where there is none."""
    lines = F.filter(F.transform(F.split("text", "\n"), X.strip), lambda x: x != "")
    return t.read("documents").select("doc_id", F.lower(F.get(lines, F.lit(0))).alias("first_line"))

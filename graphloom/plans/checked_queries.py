"""Checked joins, prompts, cohorts, masks, orders and validations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..derive import CONCEPTS, LETTERS, Tables
from ..functions import prompts as P
from ..operators import checked as C
from ..operators import masks as M
from ..operators import validate as V
from ..vocab import PROMPTS, relation_table
from .base import query

_OK = "coalesce(pred = gold, false)"
_LABEL = f"label AS (SELECT CAST(p_partkey AS INTEGER) AS cid, min(p_name) || ' ' || p_partkey AS label FROM part WHERE p_partkey < {CONCEPTS} GROUP BY p_partkey)"


def labels(t: Tables) -> DataFrame:
    """cid, label of every concept."""
    return t.read("part").filter(F.col("p_partkey") < CONCEPTS).groupBy("p_partkey").agg(F.min("p_name").alias("name")).select(F.col("p_partkey").cast("int").alias("cid"), F.concat_ws(" ", "name", F.col("p_partkey").cast("string")).alias("label"))


# --- checked joins ---------------------------------------------------------------------


@query(f" SELECT arm, item, pred, gold, {_OK} AS correct FROM outcome")
def scored_predictions(t: Tables) -> DataFrame:
    """Predictions with their records; both must have the same keys, each once."""
    pred, gold = t.outcome.select("arm", "item", "pred"), t.outcome.select("arm", "item", "gold")
    return C.exact_cover(pred, gold, ["arm", "item"]).select("arm", "item", "pred", "gold", F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)).alias("correct"))


@query(f" SELECT arm, count(*) AS n, count(pred) AS answered, avg(CASE WHEN {_OK} THEN 1.0 ELSE 0.0 END) AS accuracy FROM outcome GROUP BY arm")
def covered_accuracy(t: Tables) -> DataFrame:
    """Answer rate and accuracy of each arm after an exact cover of predictions and gold letters."""
    return scored_predictions(t).groupBy("arm").agg(F.count("*").alias("n"), F.count("pred").alias("answered"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


@query(" SELECT o_orderpriority, count(*) AS n_lines, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def lines_with_orders(t: Tables) -> DataFrame:
    """Lines by the priority of their orders; a line without its order would be an error."""
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return C.lookup(lines, t.read("orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"]).groupBy("o_orderpriority").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))


@query(f", {_LABEL} SELECT e.stmt, s.label AS source, relation, t.label AS target FROM edge e JOIN label s ON s.cid = e.src JOIN label t ON t.cid = e.tgt JOIN relation USING (rel)")
def labelled_edges(t: Tables) -> DataFrame:
    """Edges in words: both ends and the relation are looked up, and none may be missing."""
    names = labels(t)
    at = lambda end, name: names.select(F.col("cid").alias(end), F.col("label").alias(name))
    rows = C.lookup(C.lookup(t.edge, at("src", "source"), ["src"]), at("tgt", "target"), ["tgt"])
    return C.lookup(rows, relation_table(t.spark).select("rel", "relation"), ["rel"]).select("stmt", "source", "relation", "target")


@query(", concept AS (SELECT p_name AS name, min(p_partkey) AS id FROM part WHERE p_partkey % 3 > 0 GROUP BY ALL) SELECT p_partkey, p_name AS name, id FROM part JOIN concept ON name = p_name")
def grounded_concepts(t: Tables) -> DataFrame:
    """Names that the vocabulary knows, with their concept; others are left out."""
    part = t.read("part").select("p_partkey", F.col("p_name").alias("name"))
    return C.lookup(part, part.filter("p_partkey % 3 > 0").groupBy("name").agg(F.min("p_partkey").alias("id")), ["name"], strict=False).select("p_partkey", "name", "id")


# --- prompts ---------------------------------------------------------------------------



def _rendered_sql() -> str:
    """Templates by slot with their fields replaced, from the same fixed list."""
    cases = []
    for task in ("neighbor_listing", "relation_identification"):
        whens = " ".join(f"WHEN {i} THEN '{p.replace(chr(39), chr(39) * 2)}'" for i, p in enumerate(PROMPTS[task]))
        # 16 ** 7 % 5 = 1, so the digits' sum modulo 5 is the slot.
        slot = f"(SELECT CAST(sum(('0x' || d)::BIGINT) % {len(PROMPTS[task])} AS INTEGER) FROM (SELECT unnest(string_split(sha256('13:' || stmt || ':{task}'), '')) AS d))"
        cases.append(f"SELECT stmt, '{task}' AS task, slot, a, b, replace(replace(replace(CASE slot {whens} END, '{{node}}', a), '{{node_a}}', a), '{{node_b}}', b) AS prompt FROM (SELECT stmt, a, b, {slot} AS slot FROM first)")
    return f""", {_LABEL}, first AS (SELECT stmt, s.label AS a, t.label AS b FROM (SELECT stmt, min(struct_pack(src, tgt)) AS e FROM edge GROUP BY stmt) JOIN label s ON s.cid = e.src JOIN label t ON t.cid = e.tgt),
made AS ({" UNION ALL ".join(cases)})"""


def _rendered(t: Tables) -> DataFrame:
    first = t.edge.groupBy("stmt").agg(F.min(F.struct("src", "tgt")).alias("e")).select("stmt", F.col("e.src").alias("src"), F.col("e.tgt").alias("tgt"))
    names = labels(t)
    first = C.lookup(C.lookup(first, names.select(F.col("cid").alias("src"), F.col("label").alias("a")), ["src"]), names.select(F.col("cid").alias("tgt"), F.col("label").alias("b")), ["tgt"])
    parts = []
    for task, fields in (("neighbor_listing", {"node": F.col("a")}), ("relation_identification", {"node_a": F.col("a"), "node_b": F.col("b")})):
        rows = first.withColumn("slot", P.stable_slot(task, F.col("stmt")))
        parts.append(rows.select("stmt", F.lit(task).alias("task"), "slot", "a", "b", P.rendered(task, F.col("slot"), **fields).alias("prompt")))
    return parts[0].unionByName(parts[1])


@query(_rendered_sql() + " SELECT stmt, task, slot, prompt FROM made")
def rendered_prompts(t: Tables) -> DataFrame:
    """Prompts about each graph's first edge, from templates at stable slots."""
    return _rendered(t).select("stmt", "task", "slot", "prompt")


@query(_rendered_sql() + " SELECT stmt, slot, a AS node_a, b AS node_b FROM made WHERE task = 'relation_identification'")
def inverted_prompts(t: Tables) -> DataFrame:
    """Slots and node names, read back from the prompts alone."""
    rows = _rendered(t).filter("task = 'relation_identification'")
    return rows.select("stmt", P.inverted("relation_identification", F.col("prompt")).alias("p")).select("stmt", "p.slot", "p.node_a", "p.node_b")


# --- cohorts and masks -----------------------------------------------------------------


@query(" SELECT stmt, cid, in_choices[1] AS letter FROM node WHERE len(in_choices) = 1")
def exclusive_answers(t: Tables) -> DataFrame:
    return M.exclusive_answers(t.node)


@query(f" SELECT arm, count(*) AS n, avg(CASE WHEN {_OK} THEN 1.0 ELSE 0.0 END) AS accuracy FROM outcome WHERE item IN (SELECT item FROM outcome WHERE arm = 'none' AND seconds <= 50000) GROUP BY arm")
def ceiling_cohort(t: Tables) -> DataFrame:
    """Accuracy of all arms over the items that did not run into the limit in the baseline arm."""
    kept = M.baseline_cohort(t.outcome, ["item"], F.col("arm") == "none", F.col("seconds") > 50000)
    return kept.groupBy("arm").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)).cast("double")).alias("accuracy"))


@query(f""", c AS (SELECT arm, gold, avg(CASE WHEN {_OK} THEN 1.0 ELSE 0.0 END) AS v, avg(CASE WHEN seconds > 120000 THEN 1.0 ELSE 0.0 END) AS share FROM outcome GROUP BY ALL)
SELECT arm, gold, CASE WHEN share <= 0.2 THEN v END AS value, v AS unmasked_value, CASE WHEN share > 0.2 THEN 'illegible' ELSE 'complete' END AS status FROM c""")
def masked_metrics(t: Tables) -> DataFrame:
    """Accuracy by arm and letter, hidden where too many items took too long."""
    cell = t.outcome.groupBy("arm", "gold").agg(F.avg(F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)).cast("double")).alias("v"), F.avg((F.col("seconds") > 120000).cast("double")).alias("share"))
    return cell.select("arm", "gold", M.masked(F.col("v"), F.col("share"), 0.2).alias("m")).select("arm", "gold", "m.*")


@query(""" SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT o_totalprice BETWEEN lo AND hi THEN 'o_totalprice' END, CASE WHEN NOT o_custkey BETWEEN clo AND chi THEN 'o_custkey' END], lambda x: x IS NOT NULL), ',') AS failed
FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_custkey) AS clo, max(o_custkey) AS chi FROM orders WHERE o_orderkey % 211 = 7) WHERE NOT (o_totalprice BETWEEN lo AND hi AND o_custkey BETWEEN clo AND chi)""")
def range_gate(t: Tables) -> DataFrame:
    """Orders whose price or customer lies outside what reference orders have."""
    o = t.read("orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return M.outside_ranges(o, o.filter("o_orderkey % 211 = 7"), ["o_totalprice", "o_custkey"], ["o_orderkey"]).select("o_orderkey", F.array_join("failed", ",").alias("failed"))


# --- orders ----------------------------------------------------------------------------


@query(""", s AS (SELECT stmt, count(*) FILTER (WHERE list_contains(in_choices, 'A')) AS a, count(*) FILTER (WHERE list_contains(in_choices, 'B')) AS b, count(*) FILTER (WHERE list_contains(in_choices, 'C')) AS c, count(*) FILTER (WHERE list_contains(in_choices, 'D')) AS d FROM node GROUP BY stmt)
SELECT stmt, greatest(a, b, c, d) AS score, CASE WHEN a = greatest(a, b, c, d) THEN 'A' WHEN b = greatest(a, b, c, d) THEN 'B' WHEN c = greatest(a, b, c, d) THEN 'C' ELSE 'D' END AS letter FROM s""")
def argmax_letters(t: Tables) -> DataFrame:
    """The choice with most concepts of its own; of equal ones the first letter."""
    score = F.array(*(F.struct(F.count(F.when(F.array_contains("in_choices", x), 1)).alias("score"), F.lit(-i).alias("place"), F.lit(x).alias("letter")) for i, x in enumerate(LETTERS)))
    return t.node.groupBy("stmt").agg(F.array_max(score).alias("best")).select("stmt", "best.score", "best.letter")


@query(""", task(task, place) AS (VALUES ('5-LOW', 0), ('1-URGENT', 1), ('3-MEDIUM', 2), ('2-HIGH', 3), ('4-NOT SPECIFIED', 4))
SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(place, 5), o_orderkey) AS place FROM orders LEFT JOIN task ON task = o_orderpriority""")
def custom_task_order(t: Tables) -> DataFrame:
    """Each customer's orders by an order of tasks that is no alphabetical one; unknown tasks last."""
    places = t.spark.createDataFrame([(x, i) for i, x in enumerate(["5-LOW", "1-URGENT", "3-MEDIUM", "2-HIGH", "4-NOT SPECIFIED"])], "o_orderpriority string, place int")
    rows = t.read("orders").join(F.broadcast(places), "o_orderpriority", "left")
    w = Window.partitionBy("o_custkey").orderBy(F.coalesce("place", F.lit(5)), "o_orderkey")
    return rows.select("o_orderpriority", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query(""", r AS (SELECT p_brand, p_type, count(*) FILTER (WHERE p_size < 10) AS below, median(p_retailprice) AS mid FROM part GROUP BY ALL)
SELECT p_brand, p_type, below, mid FROM r QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY below, mid DESC, p_type) = 1""")
def finalists(t: Tables) -> DataFrame:
    """Of each family the candidate with fewest values below the limit, then the highest median, then the name."""
    r = t.read("part").groupBy("p_brand", "p_type").agg(F.count(F.when(F.col("p_size") < 10, 1)).alias("below"), F.median("p_retailprice").alias("mid"))
    return r.groupBy("p_brand").agg(F.min(F.struct("below", (-F.col("mid")).alias("m"), "p_type")).alias("b")).select("p_brand", "b.p_type", "b.below", (-F.col("b.m")).alias("mid"))


@query(" SELECT arm, count(*) FILTER (WHERE pred IS NOT NULL AND pred = gold) AS committed_right, count(*) FILTER (WHERE pred <> gold) AS committed_wrong, count(*) FILTER (WHERE pred IS NULL AND seconds > 300000) AS withheld FROM outcome GROUP BY arm")
def decision_counts(t: Tables) -> DataFrame:
    """All kinds of decision for each arm, those that never happen with zero."""
    return t.outcome.groupBy("arm").agg(F.count(F.when(F.col("pred") == F.col("gold"), 1)).alias("committed_right"), F.count(F.when(F.col("pred") != F.col("gold"), 1)).alias("committed_wrong"), F.count(F.when(F.col("pred").isNull() & (F.col("seconds") > 300000), 1)).alias("withheld"))


@query(""" SELECT event_type, row_number() OVER (ORDER BY first) AS place, n FROM (SELECT event_type, min(event_id) AS first, count(*) AS n FROM events GROUP BY ALL)""")
def first_seen_groups(t: Tables) -> DataFrame:
    """Kinds of events in the order in which they first came."""
    g = t.read("events").groupBy("event_type").agg(F.min("event_id").alias("first"), F.count("*").alias("n"))  # a handful of kinds
    return g.select("event_type", F.row_number().over(Window.orderBy("first")).cast("long").alias("place"), "n")


# --- validations -----------------------------------------------------------------------


@query(" SELECT stmt, CAST(n AS BIGINT) AS stored, CAST(d AS BIGINT) AS derived FROM (SELECT stmt, count(*) AS n FROM edge GROUP BY stmt) JOIN (SELECT stmt, count(*) AS d FROM choice_edge GROUP BY stmt) USING (stmt) WHERE n <> d")
def validate_derived(t: Tables) -> DataFrame:
    """Statements whose number of edges is not the one that their choices' graphs give."""
    stored = t.edge.groupBy("stmt").agg(F.count("*").alias("n"))
    return V.unequal(stored.join(t.choice_edge.groupBy("stmt").agg(F.count("*").alias("d")), "stmt"), ["stmt"], F.col("n"), F.col("d"))


@query(" SELECT user_id, count(DISTINCT event_type) AS n, (SELECT count(DISTINCT event_type) FROM events) AS expected FROM events WHERE value > 30 GROUP BY user_id HAVING n < (SELECT count(DISTINCT event_type) FROM events WHERE value > 30)")
def validate_product(t: Tables) -> DataFrame:
    """Users without large events of every kind."""
    return V.incomplete_products(t.read("events").filter("value > 30"), ["user_id"], ["event_type"])


@query(""", f AS (SELECT stmt, 'nodes' AS fault FROM node GROUP BY stmt HAVING count(*) NOT BETWEEN 10 AND 35 UNION SELECT stmt, 'edges' FROM edge GROUP BY stmt HAVING count(*) NOT BETWEEN 8 AND 60 UNION SELECT stmt, 'self_loop' FROM edge WHERE src = tgt)
SELECT stmt, fault FROM f""")
def validate_graphs(t: Tables) -> DataFrame:
    """What is wrong with the shape of each graph."""
    return V.graph_faults(t.edge, t.node, (10, 35), (8, 60))


@query(" SELECT o_custkey, CAST(f + o + p AS BIGINT) AS parts, n AS total FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, 0 AS p, count(*) AS n FROM orders GROUP BY ALL) WHERE f + o + p <> n")
def validate_category_sums(t: Tables) -> DataFrame:
    """Customers whose open and filled orders are not all of their orders."""
    kinds = t.read("orders").groupBy("o_custkey").agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("o"), F.count("*").alias("n"))
    return V.unbalanced(kinds, ["o_custkey"], ["f", "o"], "n")


@query(" SELECT item, count(DISTINCT pred) AS n FROM outcome WHERE pred IS NOT NULL GROUP BY item HAVING n > 1")
def validate_same_answer(t: Tables) -> DataFrame:
    """Items to which arms give different answers."""
    return V.inconsistent(t.outcome, ["item"], "pred")

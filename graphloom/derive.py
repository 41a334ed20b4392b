"""Deterministic graphs and outcomes over the driver's tables, once for Spark and once as SQL.

A customer is a statement; parts modulo CONCEPTS are concepts; consecutive lines of an
order are edges.  Orders give outcomes of arms over items.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vocab import RELATION_SQL

CONCEPTS, N_RELATIONS = 40, 17
#: Consecutive orders that are about one item; items grow with the orders.
ORDERS_AN_ITEM = 8
LETTERS = ["A", "B", "C", "D"]


#: Words of the documents' texts that stand for markup in replies, and what for.
MARKUP = [
    (" the ", " [ "), (" and ", " ] "), (" of ", ' "'), (" is ", '" '), (" on ", " “"), (" that ", "” "), (" to ", "\nAnswer: "), (" in ", " is a "), (" it ", " so the "), (" der ", "\n* "), (" le ", " *"), (" el ", "\n- "), (" un ", " not capable of "), (" die ", " (und, [ein, das], und) "), (" la ", ", 7"),
]


class Tables:
    """Lazy DataFrames of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def line(self) -> DataFrame:
        orders = self.read("orders").select("o_orderkey", F.col("o_custkey").alias("stmt"))
        lines = self.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "stmt",
            "l_orderkey",
            F.col("l_linenumber").alias("no"),
            (F.col("l_partkey") % CONCEPTS).cast("int").alias("cid"),
            (F.col("l_suppkey") % N_RELATIONS).cast("int").alias("rel"),
            (F.col("l_suppkey") % 4).cast("int").alias("choice"),
            F.col("l_returnflag").alias("flag"),
        )

    @property
    def choice_edge(self) -> DataFrame:
        """Edges of each choice's graph: line n to line n + 1 of an order (line numbers may repeat)."""
        return self._steps.distinct()

    @property
    def _steps(self) -> DataFrame:
        """Edges as often as they are met, dealt by statement.  An order's few lines are paired in one row, and only then is its statement looked up."""
        lines = self.read("lineitem").select("l_orderkey", F.col("l_linenumber").alias("no"), (F.col("l_partkey") % CONCEPTS).cast("int").alias("cid"), (F.col("l_suppkey") % N_RELATIONS).cast("int").alias("rel"), (F.col("l_suppkey") % 4).cast("int").alias("choice"))
        orders = self.read("orders").select("o_orderkey", F.col("o_custkey").alias("stmt"))
        whole = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("no", "cid", "rel", "choice")).alias("x"))
        after = lambda a: F.transform(F.filter("x", lambda b: b["no"] == a["no"] + 1), lambda b: F.struct(a["choice"].alias("choice"), a["cid"].alias("src"), a["rel"].alias("rel"), b["cid"].alias("tgt")))
        steps = whole.select("l_orderkey", F.array_distinct(F.flatten(F.transform("x", after))).alias("steps")).filter("size(steps) > 0")
        met = steps.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("stmt", F.explode("steps").alias("e")).select("stmt", "e.*")
        return met.repartition("stmt")

    @property
    def seen(self) -> DataFrame:
        """Every time an edge is met, with the order of meeting: order, line, and what tells the edges of one line number apart."""
        after = self.line.select("l_orderkey", (F.col("no") - 1).alias("no"), F.col("cid").alias("tgt"))
        return self.line.join(after, ["l_orderkey", "no"]).select("stmt", F.col("cid").alias("src"), "rel", "tgt", F.struct("l_orderkey", "no", F.col("cid").alias("a"), F.col("rel").alias("r"), F.col("tgt").alias("b")).alias("ord"))

    @property
    def choice_node(self) -> DataFrame:
        q = (F.col("no") == 1) & (F.col("flag") == "R")
        a = (F.col("no") == 3) & (F.col("flag") == "A")
        rows = self.line.select("stmt", "choice", "cid", q.alias("q"), a.alias("a")).repartition("stmt")
        return rows.groupBy("stmt", "choice", "cid").agg(F.bool_or("q").alias("qmask"), F.bool_or("a").alias("amask"))

    @property
    def edge(self) -> DataFrame:
        from .operators.graph import merge_edges

        return merge_edges(self._steps)

    @property
    def node(self) -> DataFrame:
        from .operators.graph import merge_nodes

        return merge_nodes(self.choice_node)

    @cached_property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        """node and edge, written once for queries that read them several times."""
        from .sources.shared import written

        return written(self.spark, self.node), written(self.spark, self.edge)

    @property
    def reply(self) -> DataFrame:
        """Whole texts of documents with markup in place of some common words: doc_id, text."""
        text = F.col("text")
        for word, sign in MARKUP:
            text = F.replace(text, F.lit(word), F.lit(sign))
        return self.read("documents").select("doc_id", text.alias("text"))

    @property
    def outcome(self) -> DataFrame:
        """arm, item, gold and predicted letter (null if unparsed), seconds: the first order of each arm and item."""
        orders = self.read("orders").select("o_orderkey", "o_custkey", "o_totalprice")
        arm = F.element_at(F.array(*map(F.lit, ["image", "kg_text", "none", "text"])), (F.col("o_custkey") % 4 + 1).cast("int"))
        first = orders.groupBy(arm.alias("arm"), F.floor(F.col("o_orderkey") / ORDERS_AN_ITEM).alias("item")).agg(F.min("o_orderkey").alias("k"), F.min("o_totalprice").alias("seconds"))
        letter = lambda n: F.element_at(F.array(*map(F.lit, LETTERS)), (n % 4 + 1).cast("int"))
        pred = F.when(F.col("k") % 13 != 0, letter(F.floor(F.col("k") / 7)))
        return first.select("arm", "item", letter(F.col("item")).alias("gold"), pred.alias("pred"), "seconds")


def reply_sql() -> str:
    text = "text"
    for word, sign in MARKUP:
        text = f"replace({text}, '{word}', '{sign}')"
    return text


@lru_cache(maxsize=1)
def graph_ctes() -> str:
    """The same tables as common table expressions."""
    return f"""
line AS (
  SELECT o_custkey AS stmt, l_orderkey, l_linenumber AS no, CAST(l_partkey % {CONCEPTS} AS INTEGER) AS cid, CAST(l_suppkey % {N_RELATIONS} AS INTEGER) AS rel,
         CAST(l_suppkey % 4 AS INTEGER) AS choice, l_returnflag AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
choice_edge AS (
  SELECT DISTINCT a.stmt, a.choice, a.cid AS src, a.rel, b.cid AS tgt FROM line a JOIN line b ON a.l_orderkey = b.l_orderkey AND a.no + 1 = b.no),
seen AS (
  SELECT a.stmt, a.cid AS src, a.rel, b.cid AS tgt, {{'k': a.l_orderkey, 'no': a.no, 'a': a.cid, 'r': a.rel, 'b': b.cid}} AS ord FROM line a JOIN line b ON a.l_orderkey = b.l_orderkey AND a.no + 1 = b.no),
choice_node AS (
  SELECT stmt, choice, cid, bool_or(no = 1 AND flag = 'R') AS qmask, bool_or(no = 3 AND flag = 'A') AS amask FROM line GROUP BY ALL),
edge AS (SELECT DISTINCT stmt, src, rel, tgt FROM choice_edge),
node AS (
  SELECT stmt, cid, bool_or(qmask) AS in_question, coalesce(list_sort(list(DISTINCT chr(65 + choice)) FILTER (WHERE amask)), []) AS in_choices
  FROM choice_node GROUP BY stmt, cid),
adj AS (SELECT stmt, src AS cid, tgt AS nbr FROM edge UNION SELECT stmt, tgt, src FROM edge),
flag AS (SELECT stmt, cid, in_question AS q, len(in_choices) > 0 AS a FROM node),
{RELATION_SQL},
reply AS (SELECT doc_id, {reply_sql()} AS text FROM documents),
outcome AS (
  SELECT arm, item, chr(CAST(65 + item % 4 AS INTEGER)) AS gold, CASE WHEN k % 13 <> 0 THEN chr(CAST(65 + (k // 7) % 4 AS INTEGER)) END AS pred, seconds
  FROM (SELECT ['image', 'kg_text', 'none', 'text'][CAST(o_custkey % 4 + 1 AS INTEGER)] AS arm, o_orderkey // {ORDERS_AN_ITEM} AS item, min(o_orderkey) AS k, min(o_totalprice) AS seconds
        FROM orders GROUP BY ALL))
"""


def sql(body: str) -> str:
    """body (which may start with more CTEs and a comma) over the derived tables."""
    return f"WITH RECURSIVE {graph_ctes()}{body}"

"""Nested metrics, bags, matchings and question pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..derive import CONCEPTS, Tables
from ..functions.nested import bag_difference, flatten_metrics
from ..operators import matching
from ..operators.question_pair import question_pair as first_pair
from .base import query
from .text_queries import SET_SIZE, wrong_pairs_allowed


@query("SELECT event_id, k AS name, CAST(props ->> k AS DOUBLE) AS number FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE json_valid(props) AND json_type(props) = 'OBJECT') WHERE json_type(props, '$.' || k) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'NULL')")
def flat_props(t: Tables) -> DataFrame:
    """All numbers in the properties of events, by name."""
    rows = t.read("events").select("event_id", F.try_parse_json("props").alias("v"))
    return flatten_metrics(rows, ["event_id"], "v").select("event_id", "name", "number")


def _report(t: Tables) -> DataFrame:
    """A nested report for each user, as it is written by scorers: user_id, v."""
    e = t.read("events")
    by = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.count(F.when(F.col("value") > 50, 1)).alias("high"))
    part = F.struct("event_type", F.struct(F.col("n").alias("record_count"), F.struct(F.col("m").alias("mean"), F.col("high").alias("gold_node_count"), F.lit(None).cast("double").alias("masked"), (F.col("high") / F.col("n")).alias("micro_recall")).alias("value"), (F.col("high") > 0).alias("any")).alias("o"))
    report = by.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.map_from_entries(F.array_sort(F.collect_list(part))).alias("by_type"))
    doc = F.struct(F.col("n").alias("record_count"), F.col("high").alias("parsed_count"), (F.col("high") / 2).alias("mean_absolute_error"), F.lit("text").alias("note"), F.struct(F.col("by_type").alias("by_type"), F.col("high").alias("top")).alias("types"))
    return report.select("user_id", F.parse_json(F.to_json(doc, {"ignoreNullFields": "false"})).alias("v"))


@query(""", t AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS m, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY ALL),
u AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(high) AS BIGINT) AS high FROM t GROUP BY ALL)
SELECT user_id, 'record_count' AS name, CAST(n AS DOUBLE) AS number, n FROM u UNION ALL SELECT user_id, 'parsed_count', high, n FROM u UNION ALL SELECT user_id, 'mean_absolute_error', high / 2, high FROM u
UNION ALL SELECT user_id, 'types.top', high, n FROM u
UNION ALL SELECT user_id, 'types.by_type.' || event_type || '.record_count', n, n FROM t UNION ALL SELECT user_id, 'types.by_type.' || event_type || '.value.mean', m, n FROM t
UNION ALL SELECT user_id, 'types.by_type.' || event_type || '.value.gold_node_count', high, n FROM t UNION ALL SELECT user_id, 'types.by_type.' || event_type || '.value.masked', NULL, n FROM t
UNION ALL SELECT user_id, 'types.by_type.' || event_type || '.value.micro_recall', high / n, high FROM t""")
def nested_metrics(t: Tables) -> DataFrame:
    """Every number of nested reports with its dotted name and its denominator."""
    return flatten_metrics(_report(t), ["user_id"], "v")


@query("""SELECT stmt, rel, CAST(count(*) FILTER (WHERE side = 0) AS BIGINT) AS n_left, CAST(count(*) FILTER (WHERE side = 1) AS BIGINT) AS n_right
FROM (SELECT stmt, rel, 0 AS side FROM choice_edge UNION ALL SELECT stmt, rel, 1 FROM edge) GROUP BY ALL HAVING n_left <> n_right""".replace("SELECT stmt, rel, CAST", " SELECT stmt, rel, CAST", 1))
def bag_differences(t: Tables) -> DataFrame:
    """Relations that a merged graph shows more or less often than its choices' graphs together."""
    return bag_difference(t.choice_edge, t.edge, ["stmt", "rel"])


def _wrong_pairs(t: Tables) -> DataFrame:
    return wrong_pairs_allowed(t).select(F.floor(F.col("graph_a") / SET_SIZE).alias("set"), F.col("graph_a").alias("a"), F.col("graph_b").alias("b"))


@query()
def wrong_pairing_exists(t: Tables) -> DataFrame:
    """For each set of graphs the size of a greatest pairing without collisions, and whether it gives each graph another one."""
    nodes = t.node.select(F.floor(F.col("stmt") / SET_SIZE).alias("set"), F.col("stmt").alias("a"))
    return matching.matching_sizes(nodes, matching.greatest_matching(_wrong_pairs(t)))


_HASH = "sha256('13:' || stmt || ':' || cid)"


@query(f""", reach(stmt, a, b) AS (SELECT stmt, cid, nbr FROM adj UNION SELECT r.stmt, r.a, adj.nbr FROM reach r JOIN adj ON adj.stmt = r.stmt AND adj.cid = r.b),
label AS (SELECT CAST(p_partkey AS INTEGER) AS cid, min(p_name) AS label FROM part WHERE p_partkey < {CONCEPTS} GROUP BY ALL),
n AS (SELECT DISTINCT stmt, cid, {_HASH} AS h, label FROM adj JOIN label USING (cid)),
ok AS (SELECT r.stmt, x.cid AS a, x.h AS ah, y.cid AS b, y.h AS bh FROM reach r JOIN n x ON x.stmt = r.stmt AND x.cid = r.a JOIN n y ON y.stmt = r.stmt AND y.cid = r.b
  WHERE x.h < y.h AND levenshtein(x.label, y.label) > 2 AND NOT EXISTS (SELECT 1 FROM adj WHERE adj.stmt = r.stmt AND adj.cid = r.a AND adj.nbr = r.b))
SELECT stmt, a AS cid_a, b AS cid_b FROM ok QUALIFY row_number() OVER (PARTITION BY stmt ORDER BY ah, bh) = 1""")
def question_pairs(t: Tables) -> DataFrame:
    """Of each graph the first pair that is connected, not adjacent and not alike in name, in a stable random order."""
    label = t.read("part").filter(F.col("p_partkey") < CONCEPTS).groupBy(F.col("p_partkey").cast("int").alias("cid")).agg(F.min("p_name").alias("label"))
    h = F.sha2(F.concat_ws(":", F.lit("13"), F.col("stmt").cast("string"), F.col("cid").cast("string")), 256)
    return first_pair(t.edge, label, h)

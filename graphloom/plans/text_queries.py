"""Scoring, parsing and statistics queries over texts and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..derive import LETTERS, Tables
from ..functions import statistics as S
from ..functions.ranks import equal_bins as equal_bins_of
from ..functions import text as X
from ..operators import graph as G
from ..operators.paths import shortest_paths as paths_between
from ..operators.similar import near_pairs
from .base import query

#: Words of the conversations' texts that stand for statements of an answer, and which.
STATED = [
    (" this ", " answer is B. "), (" or ", " **C** "), (" by ", "\nA)\n"), (" was ", " correct answer: (D) "), (" are ", " is A. "), (" die ", " the answer is **A**, "), (" que ", " **D** "), (" und ", " Answer is [C] "), (" as ", " answer is Apple "), (" with ", "** B **"), (" sich ", " is C. "),
]
#: Names of choices that the fallback looks for.
NAMES = {"A": "they have", "B": "von", "C": "los", "D": "from"}


def answers(t: Tables) -> DataFrame:
    """Whole texts of conversations with statements of answers in place of some words."""
    text = F.col("text")
    for word, statement in STATED:
        text = F.replace(text, F.lit(word), F.lit(statement))
    return t.read("conversations").select("conv_id", "turn", text.alias("response"))


def _said() -> str:
    text = "text"
    for word, statement in STATED:
        text = f"replace({text}, '{word}', '{statement}')"
    one = lambda found: f"CASE WHEN len(list_distinct({found})) = 1 THEN {found}[1] END"
    return rf""", said AS (SELECT conv_id, turn, {text} AS c FROM conversations),
cut AS (SELECT *, regexp_replace(c, '\A{WHITE}+|{WHITE}+\z', '', 'g') AS t FROM said),
found AS (SELECT conv_id, turn, c, regexp_extract(t, '\A([A-D])\z', 1) AS exact, regexp_extract(t, '\A[(\[]?([A-D])[)\]]?[.!]?\z', 1) AS sole,
  CASE WHEN NOT regexp_matches(substring(t, 4), '\b[A-D]\b') THEN regexp_extract(t, '\A([A-D])\. +[^\n.!?]+[.!?]?\z', 1) END AS opt,
  regexp_extract_all(t, '(?i:\b(?:correct{WHITE}+)?answer{WHITE}+is{WHITE}*|\bcorrect{WHITE}+answer{WHITE}*:{WHITE}*)(?:\*\*)?[(\[]?([A-D])(?:{WHITE}|[)\]*.,:;!?]|\z)', 1) AS ex,
  regexp_extract_all(t, '\*\*{WHITE}*[(\[]?([A-D])[)\]]?[.!]?{WHITE}*\*\*', 1) AS bold,
  regexp_extract(list_filter(string_split_regex(c, '\r\n|[\n\x0b\f\r\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_matches(x, '[^ \t-\r]'))[1], '\A{WHITE}*\**\(?([ABCD])\)?[.):]?\**{WHITE}*\z', 1) AS first,
  list_distinct(regexp_extract_all(c, '\bis{WHITE}+([A-D])\.', 1)) AS iz,
  list_filter({list(NAMES)}, lambda x: regexp_matches(c, '(?i)(?:\A|[^\p{{L}}\p{{N}}_])(?:' || map({list(NAMES)}, {list(NAMES.values())})[x] || ')(?:[^\p{{L}}\p{{N}}_]|\z)')) AS named FROM cut),
v1 AS (SELECT *, CASE WHEN exact <> '' THEN [exact, 'exact'] WHEN sole <> '' THEN [sole, 'sole_letter'] WHEN opt <> '' THEN [opt, 'option_prefix']
  WHEN len(ex) > 0 THEN CASE WHEN {one("ex")} IS NOT NULL THEN [ex[1], 'explicit_answer'] END WHEN {one("bold")} IS NOT NULL THEN [bold[1], 'bold_letter'] END AS v FROM found)"""


_FAILED = "['FAILED', 'FAILED']"


def _letters(version: str, otherwise: str):
    oracle = lambda: _said() + f" SELECT conv_id, turn, p[1] AS letter, p[2] AS tier FROM (SELECT conv_id, turn, coalesce(v, {otherwise}) AS p FROM v1)"

    def parse(t: Tables) -> DataFrame:
        return answers(t).select("conv_id", "turn", X.parse_letter(F.col("response"), 4, version).alias("p")).select("conv_id", "turn", "p.letter", "p.tier")

    return oracle, parse


#: What (?U)\\s is in Java, in the words of DuckDB.
WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CLOSING = WHITE[:-1] + r".!?;:]+\z"


for _version, _otherwise in (("explicit_v1", _FAILED), ("explicit_v2", f"CASE WHEN first <> '' THEN [first, 'first_line_letter'] ELSE {_FAILED} END")):
    _oracle, _parse = _letters(_version, _otherwise)
    query(_oracle(), name=f"letter_parse_{_version[-2:]}")(_parse)


@query(_said() + f""" SELECT conv_id, turn, p[1] AS letter, p[2] AS tier FROM (SELECT conv_id, turn, CASE WHEN v IS NOT NULL THEN v WHEN len(iz) = 1 THEN [iz[1], 'is_letter'] WHEN len(iz) > 1 THEN {_FAILED}
WHEN len(named) = 1 THEN [named[1], 'choice_name'] ELSE {_FAILED} END AS p FROM v1)""")
def letter_parse_fallback(t: Tables) -> DataFrame:
    names = F.create_map(*(F.lit(v) for pair in NAMES.items() for v in pair))
    return answers(t).select("conv_id", "turn", X.parse_letter_fallback(F.col("response"), names).alias("p")).select("conv_id", "turn", "p.letter", "p.tier")


@query(rf"""SELECT doc_id, raw, basic, regexp_replace(regexp_replace(basic, '(?i){WHITE}*\[{WHITE}*[A-D]({WHITE}*,{WHITE}*[A-D])*{WHITE}*\]{WHITE}*\z', ''), '{CLOSING}', '') AS annotation_stripped
FROM (SELECT doc_id, raw, regexp_replace(regexp_replace(lower(raw), '{WHITE}+', ' ', 'g'), '{CLOSING}', '') AS basic
FROM (SELECT doc_id, regexp_replace(text, '\A{WHITE}+|{WHITE}+\z', '', 'g') AS raw FROM documents))""")
def normalize_tiers(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", *(X.normalise(F.col("text"), tier).alias(tier) for tier in X.TIERS))


#: DuckDB measures bytes: letters of two bytes that the texts hold stand for signs of one that they do not hold.
LETTERS_2 = "éÉßóÓäÄçÇèÈñÑíÍêÊüÜöÖáÁúÚ"
SIGNS_1 = " || ".join(f"chr({n})" for n in [*range(1, 9), *range(14, 32)][: len(LETTERS_2)])


def one_byte(w: str) -> str:
    return f"translate({w}, '{LETTERS_2}', {SIGNS_1})"


@query(rf""", w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[\x09-\x0d ]+')) AS w FROM benchmark), x AS (SELECT w, {one_byte("w")} AS x FROM w)
SELECT a.w AS a, b.w AS b, CAST(levenshtein(a.x, b.x) AS INTEGER) AS distance FROM x a JOIN x b ON a.w < b.w AND abs(length(a.w) - length(b.w)) <= 2 WHERE levenshtein(a.x, b.x) <= 2""")
def levenshtein_le2(t: Tables) -> DataFrame:
    """All words of the texts that are within two edits of each other, by characters."""
    words = t.read("benchmark").select(F.explode(F.split("text", r"[\x09-\x0d ]+")).alias("w"))
    return near_pairs(words, "w")


@query(r"""SELECT page_id, n[1] AS first_int, n[-1] AS last_int, CAST(len(n) AS INTEGER) AS n_ints, list_contains(n, 2) AS has_two
FROM (SELECT page_id, list_transform(regexp_extract_all(url, '[-+]?[0-9]+'), lambda x: CAST(x AS BIGINT)) AS n FROM pages)""")
def integer_containment(t: Tables) -> DataFrame:
    n = t.read("pages").select("page_id", X.integers(F.col("url")).alias("n"))
    return n.select("page_id", F.get("n", F.lit(0)).alias("first_int"), F.try_element_at("n", F.lit(-1)).alias("last_int"), F.size("n").alias("n_ints"), F.array_contains("n", F.lit(2).cast("long")).alias("has_two"))


@query("SELECT n_nationkey, regexp_replace(lower(n_name || ' 1 Of'), '[^a-z]', '', 'g') AS key FROM nation")
def relation_key(t: Tables) -> DataFrame:
    return t.read("nation").select("n_nationkey", X.relation_key(F.concat("n_name", F.lit(" 1 Of"))).alias("key"))


@query("SELECT p_partkey, CAST((('0x' || substring(sha256('13:' || p_partkey), 58, 7))::BIGINT % 16) AS INTEGER) AS slot FROM part")
def template_slot(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", X.hash_slot(F.concat(F.lit("13:"), F.col("p_partkey").cast("string")), 16).alias("slot"))


@query("SELECT o_orderkey, s AS shift, string_agg(['w', 'x', 'y', 'z'][CAST((i + s) % 4 + 1 AS INTEGER)], '' ORDER BY i) AS choices FROM orders, (SELECT unnest(range(0, 4)) AS s), (SELECT unnest(range(0, 4)) AS i) GROUP BY ALL")
def cyclic_choices(t: Tables) -> DataFrame:
    rows = t.read("orders").select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("shift"))
    return rows.select("o_orderkey", "shift", F.array_join(X.cyclic_choices(F.array(*map(F.lit, "wxyz")), F.col("shift")), "").alias("choices"))


# --- sets ----------------------------------------------------------------------------
SETS = """, g AS (SELECT stmt, list(DISTINCT cid) AS gold FROM flag WHERE q OR a GROUP BY stmt), p AS (SELECT stmt, list(DISTINCT nbr) AS pred FROM adj WHERE nbr % 3 > 0 AND cid % 5 = 0 GROUP BY stmt),
s AS (SELECT stmt, coalesce(gold, []) AS gold, coalesce(pred, []) AS pred FROM (SELECT DISTINCT stmt FROM node) LEFT JOIN g USING (stmt) LEFT JOIN p USING (stmt)),
c AS (SELECT stmt, len(list_intersect(gold, pred)) AS tp, len(pred) - len(list_intersect(gold, pred)) AS fp, len(gold) - len(list_intersect(gold, pred)) AS fn FROM s),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN CASE WHEN tp + fp = 0 THEN 1.0 ELSE 0.0 END ELSE tp / (tp + fn) END AS recall, fp = 0 AND fn = 0 AS exact FROM c),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r)"""


def scored_sets(t: Tables) -> DataFrame:
    node, edge = t.graph
    gold = G.flags(node).filter("q or a").groupBy("stmt").agg(F.collect_set("cid").alias("gold"))
    pred = G.adjacency(edge).filter("nbr % 3 > 0 and cid % 5 = 0").groupBy("stmt").agg(F.collect_set("nbr").alias("pred"))
    none = F.array().cast("array<int>")
    rows = node.select("stmt").distinct().join(gold, "stmt", "left").join(pred, "stmt", "left")
    return rows.select("stmt", X.set_scores(F.coalesce("gold", none), F.coalesce("pred", none)).alias("s")).select("stmt", "s.*")


@query(SETS + " SELECT stmt, CAST(tp AS INTEGER) AS tp, CAST(fp AS INTEGER) AS fp, CAST(fn AS INTEGER) AS fn, precision, recall, f1, exact FROM f")
def set_prf(t: Tables) -> DataFrame:
    return scored_sets(t)


@query(SETS + """ SELECT count(*) AS n, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, avg(CASE WHEN exact THEN 1.0 ELSE 0.0 END) AS exact_rate,
CASE WHEN sum(tp + fp) = 0 THEN 1.0 ELSE sum(tp) / sum(tp + fp) END AS micro_precision, CASE WHEN sum(tp + fn) = 0 THEN 1.0 ELSE sum(tp) / sum(tp + fn) END AS micro_recall FROM f""")
def micro_macro_f1(t: Tables) -> DataFrame:
    tp, pred, gold = F.sum("tp"), F.sum(F.expr("tp + fp")), F.sum(F.expr("tp + fn"))
    micro = lambda d: F.when(d == 0, 1.0).otherwise(tp / F.nullif(d, F.lit(0)))
    return scored_sets(t).agg(F.count("*").alias("n"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.avg(F.col("exact").cast("double")).alias("exact_rate"), micro(pred).alias("micro_precision"), micro(gold).alias("micro_recall"))


def _ends(t: Tables) -> DataFrame:
    f = G.flags(t.graph[0]).groupBy("stmt").agg(F.min(F.when(F.col("q"), F.col("cid"))).alias("source"), F.min(F.when(F.col("a"), F.col("cid"))).alias("target"))
    return f.filter("source is not null and target is not null")


@query(""", ends AS (SELECT stmt, min(cid) FILTER (WHERE q) AS source, min(cid) FILTER (WHERE a) AS target FROM flag GROUP BY stmt HAVING source IS NOT NULL AND target IS NOT NULL),
walk(stmt, cid, d) AS (SELECT stmt, source, 0 FROM ends UNION SELECT w.stmt, adj.nbr, d + 1 FROM walk w JOIN adj ON adj.stmt = w.stmt AND adj.cid = w.cid WHERE d < 41),
lvl AS (SELECT stmt, cid, min(d) AS d FROM walk GROUP BY ALL),
ways(stmt, cid, d, path) AS (
  SELECT stmt, target, (SELECT l.d FROM lvl l WHERE l.stmt = ends.stmt AND l.cid = ends.target), [target] FROM ends
  UNION ALL SELECT w.stmt, l.cid, l.d, list_prepend(l.cid, path) FROM ways w JOIN adj ON adj.stmt = w.stmt AND adj.cid = w.cid JOIN lvl l ON l.stmt = w.stmt AND l.cid = adj.nbr AND l.d = w.d - 1),
done AS (SELECT ways.stmt, min(path) AS path, count(*) AS n FROM ways JOIN ends ON ends.stmt = ways.stmt AND ways.cid = ends.source WHERE d = 0 GROUP BY ALL)
SELECT ends.stmt, source, target, CAST(len(path) - 1 AS INTEGER) AS distance, CAST(coalesce(n, 0) AS INTEGER) AS n_paths, coalesce(array_to_string(path, ','), '') AS first_path, coalesce(n, 0) >= 32 AS truncated
FROM ends LEFT JOIN done USING (stmt)""")
def shortest_paths(t: Tables) -> DataFrame:
    return paths_between(t.graph[1], _ends(t)).withColumn("first_path", F.coalesce(F.array_join("first_path", ","), F.lit("")))


# --- outcomes --------------------------------------------------------------------------
OK = "coalesce(pred = gold, false)"


@query(f" SELECT arm, count(*) AS n, count(*) FILTER (WHERE {OK}) AS correct, count(*) FILTER (WHERE pred IS NULL) AS unparsed, count(*) FILTER (WHERE {OK}) / count(*) AS accuracy, count(*) FILTER (WHERE {OK}) / nullif(count(pred), 0) AS accuracy_parsed FROM outcome GROUP BY arm")
def qa_condition_metrics(t: Tables) -> DataFrame:
    ok = F.count_if(F.col("pred") == F.col("gold"))
    return t.outcome.groupBy("arm").agg(F.count("*").alias("n"), ok.alias("correct"), F.count_if(F.col("pred").isNull()).alias("unparsed"), (ok / F.count("*")).alias("accuracy"), F.try_divide(ok, F.count("pred")).alias("accuracy_parsed"))


@query(" SELECT gold, count(*) FILTER (WHERE pred = 'A') / count(*) AS \"A\", count(*) FILTER (WHERE pred = 'B') / count(*) AS \"B\", count(*) FILTER (WHERE pred = 'C') / count(*) AS \"C\", count(*) FILTER (WHERE pred = 'D') / count(*) AS \"D\" FROM outcome WHERE pred IS NOT NULL GROUP BY gold")
def confusion_matrix(t: Tables) -> DataFrame:
    counts = t.outcome.filter("pred is not null").groupBy("gold").pivot("pred", LETTERS).count().na.fill(0)
    total = sum((F.col(x) for x in LETTERS), F.lit(0))
    return counts.select("gold", *((F.col(x) / total).alias(x) for x in LETTERS))


@query(", l(letter) AS (VALUES ('A'), ('B'), ('C'), ('D')), arms AS (SELECT arm, count(*) AS n, count(pred) AS parsed FROM outcome GROUP BY arm) SELECT a.arm, l.letter, count(o.item) AS chosen, count(o.item) / n AS of_all, count(o.item) / nullif(parsed, 0) AS of_parsed FROM arms a CROSS JOIN l LEFT JOIN outcome o ON o.arm = a.arm AND o.pred = l.letter GROUP BY a.arm, l.letter, n, parsed")
def position_bias(t: Tables) -> DataFrame:
    arms = t.outcome.groupBy("arm").agg(F.count("*").alias("n"), F.count("pred").alias("parsed"))
    grid = arms.withColumn("letter", F.explode(F.array(*map(F.lit, LETTERS))))
    chosen = t.outcome.groupBy("arm", F.col("pred").alias("letter")).agg(F.count("*").alias("chosen"))
    rows = grid.join(chosen, ["arm", "letter"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(0).cast("long")))
    return rows.select("arm", "letter", "chosen", (F.col("chosen") / F.col("n")).alias("of_all"), F.try_divide("chosen", "parsed").alias("of_parsed"))


@query(""", g AS (SELECT arm, gold AS letter, count(*) AS c FROM outcome GROUP BY ALL), p AS (SELECT arm, pred AS letter, count(*) AS c FROM outcome GROUP BY ALL),
n AS (SELECT arm, count(*) AS n, count(*) FILTER (WHERE pred = gold) AS correct FROM outcome GROUP BY arm),
e AS (SELECT arm, sum(p.c * g.c / n) AS expected FROM g JOIN p USING (arm, letter) JOIN n USING (arm) GROUP BY arm)
SELECT arm, n, correct, expected, CASE WHEN expected * (1 - expected / n) > 0 THEN (correct - expected) / sqrt(expected * (1 - expected / n)) ELSE 0.0 END AS z FROM n JOIN e USING (arm)""")
def expected_correct_z(t: Tables) -> DataFrame:
    o = t.outcome
    n = o.groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("gold")).alias("correct"))
    gold = o.groupBy("arm", F.col("gold").alias("letter")).agg(F.count("*").alias("g"))
    pred = o.groupBy("arm", F.col("pred").alias("letter")).agg(F.count("*").alias("p"))
    e = gold.join(pred, ["arm", "letter"]).join(n, "arm").groupBy("arm", "n", "correct").agg(F.sum(F.col("p") * F.col("g") / F.col("n")).alias("expected"))
    var = F.col("expected") * (1 - F.col("expected") / F.col("n"))
    return e.withColumn("z", F.when(var > 0, (F.col("correct") - F.col("expected")) / F.sqrt(F.nullif(var, F.lit(0.0)))).otherwise(0.0))


PAIRED = f""", w AS (SELECT item, max(CASE WHEN arm = 'image' THEN CAST({OK} AS INTEGER) END) AS i, max(CASE WHEN arm = 'text' THEN CAST({OK} AS INTEGER) END) AS t FROM outcome GROUP BY item HAVING count(DISTINCT arm) FILTER (WHERE arm IN ('image', 'text')) = 2)"""


def paired(t: Tables) -> DataFrame:
    ok = F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))
    side = lambda arm, name: t.outcome.filter(F.col("arm") == arm).select("item", ok.alias(name))
    return side("image", "i").join(side("text", "t"), "item")


@query(PAIRED + """, d AS (SELECT count(*) AS n, count(*) FILTER (WHERE i = 1 AND t = 0) AS b, count(*) FILTER (WHERE i = 0 AND t = 1) AS c FROM w)
SELECT n, b AS image_only, c AS text_only, (b - c) / n AS difference, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (
  SELECT sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) + (b + c) * ln(0.5))) FROM (SELECT unnest(range(0, least(b, c) + 1)) AS k))) END AS p FROM d""")
def mcnemar(t: Tables) -> DataFrame:
    d = paired(t).agg(F.count("*").alias("n"), F.count_if(F.expr("i and not t")).alias("image_only"), F.count_if(F.expr("t and not i")).alias("text_only"))
    return d.select("*", ((F.col("image_only") - F.col("text_only")) / F.col("n")).alias("difference"), S.mcnemar(F.col("image_only"), F.col("text_only")).alias("p"))


@query(PAIRED + " SELECT count(*) FILTER (WHERE i > t) AS improved, count(*) FILTER (WHERE i < t) AS worsened, count(*) FILTER (WHERE i = t) AS tied, avg(i) - avg(t) >= -0.05 - 1e-12 AS non_inferior FROM w")
def paired_sign_counts(t: Tables) -> DataFrame:
    i, x = F.col("i").cast("int"), F.col("t").cast("int")
    return paired(t).agg(F.count_if(i > x).alias("improved"), F.count_if(i < x).alias("worsened"), F.count_if(i == x).alias("tied"), (F.avg(i) - F.avg(x) >= -0.05 - 1e-12).alias("non_inferior"))


@query(f" SELECT arm, gold, CAST(grouping_id(arm, gold) AS BIGINT) AS level, count(*) AS n, avg(CASE WHEN {OK} THEN 1.0 ELSE 0.0 END) AS accuracy FROM outcome GROUP BY GROUPING SETS ((), (arm), (arm, gold))")
def grouping_sets_accuracy(t: Tables) -> DataFrame:
    t.outcome.createOrReplaceTempView("__outcome")
    return t.spark.sql("SELECT arm, gold, grouping_id(arm, gold) AS level, count(*) AS n, avg(CASE WHEN coalesce(pred = gold, false) THEN 1.0D ELSE 0.0D END) AS accuracy FROM __outcome GROUP BY GROUPING SETS ((), (arm), (arm, gold))")


RANKED = """, x AS (SELECT p_brand AS grp, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part),
k AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY a) + (count(*) OVER (PARTITION BY grp, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY grp ORDER BY b) + (count(*) OVER (PARTITION BY grp, b) - 1) / 2 AS rb FROM x)"""


@query(RANKED + " SELECT grp, count(*) AS n, CASE WHEN var_pop(ra) > 0 AND var_pop(rb) > 0 THEN corr(ra, rb) END AS rho FROM k GROUP BY grp")
def spearman(t: Tables) -> DataFrame:
    x = t.read("part").select(F.col("p_brand").alias("grp"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return S.spearman(x, "a", "b", "grp")


@query(RANKED.replace("AS b FROM part", "AS b, p_partkey % 97 AS c FROM part").replace("k AS (SELECT *,", "k AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY c) + (count(*) OVER (PARTITION BY grp, c) - 1) / 2 AS rc,") + """ SELECT grp, n, CASE WHEN n > 2 AND isfinite(ab) AND isfinite(ac) AND isfinite(bc) THEN (ab - ac * bc) / sqrt(greatest(1e-12, (1 - ac * ac) * (1 - bc * bc))) END AS rho
FROM (SELECT grp, count(*) AS n, corr(ra, rb) AS ab, corr(ra, rc) AS ac, corr(rb, rc) AS bc FROM k GROUP BY grp)""")
def partial_spearman(t: Tables) -> DataFrame:
    """Rank correlation of size and price of a brand's parts, their age held fixed."""
    x = t.read("part").select(F.col("p_brand").alias("grp"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (F.col("p_partkey") % 97).alias("c"))
    return S.partial_spearman(x, "a", "b", "c", "grp")


@query(RANKED + " SELECT grp, count(*) AS n, corr(a, b) AS r FROM k GROUP BY grp")
def pearson(t: Tables) -> DataFrame:
    x = t.read("part").select(F.col("p_brand").alias("grp"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return S.pearson(x, "a", "b", "grp")


@query(RANKED + " SELECT grp, a, b, ra, rb FROM k")
def average_ranks(t: Tables) -> DataFrame:
    x = t.read("part").select(F.col("p_brand").alias("grp"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return x.withColumn("ra", S.average_rank("a", "grp")).withColumn("rb", S.average_rank("b", "grp"))


@query("SELECT c_mktsegment AS grp, count(*) AS n, median(c_acctbal) AS med, quantile_cont(c_acctbal, 0.9) AS p90, quantile_disc(c_acctbal, 0.3) AS low_cut, quantile_disc(c_acctbal, 0.7) AS high_cut FROM customer GROUP BY ALL")
def quantile_rules(t: Tables) -> DataFrame:
    v = "c_acctbal"
    return t.read("customer").groupBy(F.col("c_mktsegment").alias("grp")).agg(F.count("*").alias("n"), F.median(v).alias("med"), F.percentile(v, F.lit(0.9)).alias("p90"), S.nearest_rank(v, 0.3).alias("low_cut"), S.nearest_rank(v, 0.7).alias("high_cut"))


@query(", c AS (SELECT stmt, count(*) AS nodes FROM node GROUP BY stmt), q AS (SELECT quantile_disc(nodes, 0.3333333333333333) AS a, quantile_disc(nodes, 0.6666666666666666) AS b FROM c) SELECT stmt, nodes, CASE WHEN nodes <= a THEN 'low' WHEN nodes <= b THEN 'middle' ELSE 'high' END AS tercile FROM c, q")
def nearest_rank_strata(t: Tables) -> DataFrame:
    c = t.node.groupBy("stmt").agg(F.count("*").alias("nodes"))
    cuts = c.agg(S.nearest_rank("nodes", 1 / 3).alias("a"), S.nearest_rank("nodes", 2 / 3).alias("b"))  # one row
    return c.join(F.broadcast(cuts)).select("stmt", "nodes", F.when(F.expr("nodes <= a"), "low").when(F.expr("nodes <= b"), "middle").otherwise("high").alias("tercile"))


@query(", c AS (SELECT stmt, count(*) AS nodes FROM node GROUP BY stmt), q AS (SELECT list_sort(list_distinct([quantile_disc(nodes, 0.25), quantile_disc(nodes, 0.5), quantile_disc(nodes, 0.75), max(nodes)])) AS u FROM c) SELECT len(list_filter(u, lambda x: x < nodes)) AS bin, count(*) AS n, min(nodes) AS lower, max(nodes) AS upper FROM c, q GROUP BY ALL")
def size_bins(t: Tables) -> DataFrame:
    c = t.node.groupBy("stmt").agg(F.count("*").alias("nodes"))
    u = c.agg(F.array_sort(F.array_distinct(F.array(*(S.nearest_rank("nodes", q) for q in (0.25, 0.5, 0.75)), F.max("nodes")))).alias("u"))
    rows = c.join(F.broadcast(u)).withColumn("bin", F.size(F.filter("u", lambda x: x < F.col("nodes"))).cast("long"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.min("nodes").alias("lower"), F.max("nodes").alias("upper"))


@query("SELECT bin, count(*) AS n, min(p_retailprice) AS lower, max(p_retailprice) AS upper FROM (SELECT p_retailprice, CAST(rn > round_even(total / 4, 0) AS INTEGER) + CAST(rn > round_even(total * 2 / 4, 0) AS INTEGER) + CAST(rn > round_even(total * 3 / 4, 0) AS INTEGER) AS bin FROM (SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice) AS rn, count(*) OVER () AS total FROM part)) GROUP BY bin")
def equal_bins(t: Tables) -> DataFrame:
    rows = equal_bins_of(t.read("part").select("p_retailprice"), "p_retailprice", 4)
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("lower"), F.max("p_retailprice").alias("upper"))


@query()
def bootstrap_ci(t: Tables) -> DataFrame:
    per = t.outcome.groupBy("arm", (F.col("item") % 50).alias("graph")).agg(F.avg(F.coalesce((F.col("pred") == F.col("gold")).cast("double"), F.lit(0.0))).alias("v"))
    return S.bootstrap_mean(per, "arm", "v")


@query()
def permutation_p(t: Tables) -> DataFrame:
    rows = t.outcome.select("arm", F.col("seconds").alias("v"), F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)).alias("high"))
    return S.permutation_p(rows, "arm", "v", "high")


# --- cohorts -----------------------------------------------------------------------------
@query(" SELECT item FROM outcome GROUP BY item HAVING count(DISTINCT arm) = (SELECT count(DISTINCT arm) FROM outcome)")
def cohort_intersection(t: Tables) -> DataFrame:
    arms = t.outcome.agg(F.count_distinct("arm").alias("arms"))
    per = t.outcome.groupBy("item").agg(F.count_distinct("arm").alias("n"))
    return per.join(F.broadcast(arms), F.col("n") == F.col("arms")).select("item")


@query(" SELECT item FROM outcome WHERE arm = 'image' EXCEPT SELECT item FROM outcome WHERE arm <> 'image'")
def only_in_arm(t: Tables) -> DataFrame:
    return t.outcome.filter("arm = 'image'").select("item").join(t.outcome.filter("arm <> 'image'"), "item", "left_anti").distinct()


@query(" SELECT count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS joined, count(*) FILTER (WHERE l.doc_id IS NULL) AS left_only, count(*) FILTER (WHERE d.doc_id IS NULL) AS right_only FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def one_sided_counts(t: Tables) -> DataFrame:
    d, l_ = t.read("documents").select(F.col("doc_id").alias("d")), t.read("labels").select(F.col("doc_id").alias("l"))
    both = d.join(l_, F.col("d") == F.col("l"), "full")
    return both.agg(F.count_if(F.expr("d is not null and l is not null")).alias("joined"), F.count_if(F.expr("l is null")).alias("left_only"), F.count_if(F.expr("d is null")).alias("right_only"))


@query(" SELECT a.item, coalesce(b.pred, a.pred) AS pred, b.item IS NOT NULL AS replaced FROM (SELECT * FROM outcome WHERE arm = 'image') a LEFT JOIN (SELECT * FROM outcome WHERE arm = 'text' AND pred IS NOT NULL) b ON a.item = b.item AND a.pred IS NULL")
def override_rows(t: Tables) -> DataFrame:
    a = t.outcome.filter("arm = 'image'").select("item", "pred")
    b = t.outcome.filter("arm = 'text' and pred is not null").select(F.col("item").alias("i2"), F.col("pred").alias("p2"))
    return a.join(b, (F.col("item") == F.col("i2")) & F.col("pred").isNull(), "left").select("item", F.coalesce("p2", "pred").alias("pred"), F.col("i2").isNotNull().alias("replaced"))


@query(" SELECT a.item, array_to_string(list_filter([CASE WHEN a.gold IS DISTINCT FROM b.gold THEN 'gold' END, CASE WHEN a.pred IS DISTINCT FROM b.pred THEN 'pred' END, CASE WHEN a.seconds IS DISTINCT FROM b.seconds THEN 'seconds' END], lambda x: x IS NOT NULL), ',') AS changed FROM outcome a JOIN outcome b ON a.item = b.item AND a.arm = 'image' AND b.arm = 'text'")
def field_diff(t: Tables) -> DataFrame:
    a, b = (t.outcome.filter(F.col("arm") == x).alias(y) for x, y in (("image", "a"), ("text", "b")))
    names = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in ("gold", "pred", "seconds"))))
    return a.join(b, F.col("a.item") == F.col("b.item")).select("a.item", F.array_join(names, ",").alias("changed"))


@query(" SELECT a.arm AS arm_a, b.arm AS arm_b, count(*) AS n, count(*) FILTER (WHERE coalesce(a.pred = a.gold, false) AND NOT coalesce(b.pred = b.gold, false)) AS better, count(*) FILTER (WHERE NOT coalesce(a.pred = a.gold, false) AND coalesce(b.pred = b.gold, false)) AS worse FROM outcome a JOIN outcome b ON a.item = b.item AND a.arm < b.arm GROUP BY ALL")
def all_pairs_arms(t: Tables) -> DataFrame:
    ok = F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))
    a = t.outcome.select("item", F.col("arm").alias("arm_a"), ok.alias("x"))
    b = t.outcome.select("item", F.col("arm").alias("arm_b"), ok.alias("y"))
    return a.join(b, "item").filter("arm_a < arm_b").groupBy("arm_a", "arm_b").agg(F.count("*").alias("n"), F.count_if(F.expr("x and not y")).alias("better"), F.count_if(F.expr("y and not x")).alias("worse"))


@query(f", m AS (SELECT arm, gold, avg(CASE WHEN {OK} THEN 1.0 ELSE 0.0 END) AS v FROM outcome GROUP BY ALL) SELECT m.arm, m.gold, m.v - b.v AS delta FROM m LEFT JOIN m b ON b.gold = m.gold AND b.arm = 'text'")
def baseline_delta(t: Tables) -> DataFrame:
    m = t.outcome.groupBy("arm", "gold").agg(F.avg(F.coalesce((F.col("pred") == F.col("gold")).cast("double"), F.lit(0.0))).alias("v"))
    base = m.filter("arm = 'text'").select("gold", F.col("v").alias("b"))
    return m.join(base, "gold", "left").select("arm", "gold", (F.col("v") - F.col("b")).alias("delta"))


@query(f", g AS (SELECT arm, item % 20 AS graph, count(*) AS n, avg(CASE WHEN {OK} THEN 1.0 ELSE 0.0 END) AS v FROM outcome GROUP BY ALL), c AS (SELECT *, max(n) OVER (PARTITION BY graph) AS full_n FROM g) SELECT arm, count(*) FILTER (WHERE n = full_n) AS graphs, count(*) FILTER (WHERE n < full_n) AS incomplete, avg(v) FILTER (WHERE n = full_n) AS mean FROM c GROUP BY arm")
def two_level_mean(t: Tables) -> DataFrame:
    ok = F.coalesce((F.col("pred") == F.col("gold")).cast("double"), F.lit(0.0))
    g = t.outcome.groupBy("arm", (F.col("item") % 20).alias("graph")).agg(F.count("*").alias("n"), F.avg(ok).alias("v")).withColumn("full_n", F.max("n").over(Window.partitionBy("graph")))
    return g.groupBy("arm").agg(F.count_if(F.expr("n = full_n")).alias("graphs"), F.count_if(F.expr("n < full_n")).alias("incomplete"), F.avg(F.expr("case when n = full_n then v end")).alias("mean"))


@query(" SELECT s, m, p FROM (SELECT unnest(['plain', 'boxed']) AS s), (SELECT DISTINCT arm AS m FROM outcome), (SELECT unnest(range(0, 4)) AS p)")
def grid_product(t: Tables) -> DataFrame:
    """The grid of styles, arms and permutations: a product of three short fixed lists."""
    arms = t.outcome.select(F.col("arm").alias("m")).distinct()
    return arms.select(F.explode(F.array(F.lit("plain"), F.lit("boxed"))).alias("s"), "m").withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))


# --- validation, increments ------------------------------------------------------------
def _violations(name: str, oracle: str):
    return query(oracle, name=f"validate_{name}")


@_violations("unique_key", " SELECT stmt, src, rel, tgt, count(*) AS n FROM edge GROUP BY ALL HAVING count(*) > 1")
def _unique(t: Tables) -> DataFrame:
    from ..operators.validate import duplicate_keys

    return duplicate_keys(t.edge, ["stmt", "src", "rel", "tgt"])


@_violations("endpoints", " SELECT e.* FROM edge e ANTI JOIN node n ON n.stmt = e.stmt AND n.cid = e.src UNION SELECT e.* FROM edge e ANTI JOIN node n ON n.stmt = e.stmt AND n.cid = e.tgt")
def _endpoints(t: Tables) -> DataFrame:
    from ..operators.validate import dangling_edges

    return dangling_edges(t.edge, t.node)


@_violations("label_cover", " SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def _cover(t: Tables) -> DataFrame:
    from ..operators.validate import cover

    return cover(t.read("documents"), t.read("labels"), ["doc_id"])


@_violations("domain", "SELECT doc_id, 'lang' AS field FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de', 'fr')")
def _domain(t: Tables) -> DataFrame:
    from ..operators.validate import outside

    return outside(t.read("documents"), "lang", ["en", "de", "fr"], ["doc_id"])


@_violations("required", "SELECT doc_id, 'text' AS field FROM documents WHERE text IS NULL UNION ALL SELECT doc_id, 'source' FROM documents WHERE source IS NULL")
def _required(t: Tables) -> DataFrame:
    from ..operators.validate import missing_fields

    return missing_fields(t.read("documents"), ["doc_id"], ["text", "source"])


@_violations("consistent", "SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def _consistent(t: Tables) -> DataFrame:
    from ..operators.validate import inconsistent

    return inconsistent(t.read("events"), ["user_id"], "event_type")


@_violations("stored_counts", "SELECT doc_id, n_chars AS stored, length(text) AS counted FROM documents WHERE abs(n_chars - length(text)) > 1e-12")
def _stored(t: Tables) -> DataFrame:
    from ..operators.validate import differing

    return differing(t.read("documents"), ["doc_id"], F.col("n_chars"), F.length("text").cast("long"))


@query("SELECT event_id FROM events ANTI JOIN (SELECT DISTINCT event_id FROM events WHERE event_id % 3 = 0) d USING (event_id)")
def resume_antijoin(t: Tables) -> DataFrame:
    from ..streaming.resume import pending

    e = t.read("events").select("event_id")
    return pending(e, e.filter("event_id % 3 = 0"), ["event_id"])


@query("SELECT event_type, count(*) AS n, avg(value) AS mean_value, avg(value) > 3 * 10 AS tripped FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= 20 GROUP BY event_type")
def tripwire_first20(t: Tables) -> DataFrame:
    from ..streaming.resume import tripwire

    return tripwire(t.read("events"), "event_type", ["ts", "event_id"], "value", 10.0)


@query("SELECT user_id, arg_max(event_type, struct_pack(ts := ts, id := event_id)) AS status, max(ts) AS ts FROM events GROUP BY user_id")
def latest_status(t: Tables) -> DataFrame:
    from ..streaming.resume import latest

    return latest(t.read("events"), ["user_id"], ["ts", "event_id"], ["event_type", "ts"]).withColumnRenamed("event_type", "status")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, event_type FROM events) WHERE r <= 2 OR event_type = 'purchase'")
def checkpoint_retention(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.read("events").withColumn("r", F.row_number().over(w)).filter("r <= 2 or event_type = 'purchase'").select("user_id", "event_id")


@query("SELECT event_type, event_id, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) ORDER BY r, event_type LIMIT 30")
def round_robin(t: Tables) -> DataFrame:
    """First 30 rows, one of each bucket in turn."""
    w = Window.partitionBy("event_type").orderBy("event_id")
    return t.read("events").withColumn("r", F.row_number().over(w)).orderBy("r", "event_type").limit(30).select("event_type", "event_id", "r")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')")
def json_number(t: Tables) -> DataFrame:
    """A number at a path of a JSON text; booleans and texts are not numbers."""
    v = F.try_parse_json("props")
    number = F.when(F.schema_of_variant(F.try_variant_get(v, "$.k", "variant")).rlike("BIGINT|DOUBLE|DECIMAL"), F.try_variant_get(v, "$.k", "double"))
    return t.read("events").select("event_id", number.alias("k")).filter("k is not null")


@query(f" SELECT arm, 'accuracy' AS metric, avg(CASE WHEN {OK} THEN 1.0 ELSE 0.0 END) AS value, count(*) AS n FROM outcome GROUP BY arm UNION ALL SELECT arm, 'seconds', avg(seconds), count(*) FROM outcome GROUP BY arm")
def long_metrics(t: Tables) -> DataFrame:
    m = t.outcome.groupBy("arm").agg(F.avg(F.coalesce((F.col("pred") == F.col("gold")).cast("double"), F.lit(0.0))).alias("accuracy"), F.avg("seconds").alias("seconds"), F.count("*").alias("n"))
    return m.unpivot(["arm", "n"], ["accuracy", "seconds"], "metric", "value").select("arm", "metric", "value", "n")


@query(f" SELECT gold AS task, avg(CASE WHEN {OK} THEN 1.0 ELSE 0.0 END) FILTER (WHERE arm = 'image') AS image, avg(CASE WHEN {OK} THEN 1.0 ELSE 0.0 END) FILTER (WHERE arm = 'text') AS text FROM outcome GROUP BY gold")
def metric_pivot(t: Tables) -> DataFrame:
    rows = t.outcome.select(F.col("gold").alias("task"), "arm", F.coalesce((F.col("pred") == F.col("gold")).cast("double"), F.lit(0.0)).alias("v"))
    return rows.groupBy("task").pivot("arm", ["image", "text"]).agg(F.avg("v"))


@query("SELECT l_returnflag AS task, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS loss FROM lineitem GROUP BY ALL")
def token_weighted_loss(t: Tables) -> DataFrame:
    return t.read("lineitem").groupBy(F.col("l_returnflag").alias("task")).agg((F.sum(F.expr("l_extendedprice * l_quantity")) / F.sum("l_quantity")).alias("loss"))


@query("SELECT l_returnflag AS task, count(*) AS n, count(*) FILTER (WHERE (CAST(l_discount AS FLOAT) >= CAST(0.05 AS FLOAT)) <> (l_discount >= 0.05)) AS flips, count(*) FILTER (WHERE abs(l_discount - 0.05) <= 1e-4) AS near_cut FROM lineitem GROUP BY ALL")
def precision_diagnostic(t: Tables) -> DataFrame:
    d, cut = F.col("l_discount"), F.lit(0.05)
    return t.read("lineitem").groupBy(F.col("l_returnflag").alias("task")).agg(F.count("*").alias("n"), F.count_if((d.cast("float") >= cut.cast("float")) != (d >= cut)).alias("flips"), F.count_if(F.abs(d - cut) <= 1e-4).alias("near_cut"))


@query("SELECT lang, 1 - count(DISTINCT text) / count(*) AS repeated FROM documents GROUP BY lang")
def repeated_fraction(t: Tables) -> DataFrame:
    return t.read("documents").groupBy("lang").agg((1 - F.count_distinct("text") / F.count("*")).alias("repeated"))


@query(" SELECT arm, count(*) FILTER (WHERE pred IS NOT NULL) AS parsed, avg(abs(ascii(pred) - ascii(gold))) AS mae, count(*) FILTER (WHERE ascii(pred) - ascii(gold) > 0) AS over, count(*) FILTER (WHERE ascii(pred) - ascii(gold) < 0) AS under FROM outcome GROUP BY arm")
def error_summary(t: Tables) -> DataFrame:
    e = F.ascii("pred") - F.ascii("gold")
    return t.outcome.groupBy("arm").agg(F.count("pred").alias("parsed"), F.avg(F.abs(e)).alias("mae"), F.count_if(e > 0).alias("over"), F.count_if(e < 0).alias("under"))


@query("SELECT c_mktsegment AS grp, list_reduce(list_prepend(0.0::DOUBLE, list(c_acctbal ORDER BY c_custkey)), lambda a, b: a + b) / count(*) AS mean FROM customer GROUP BY ALL")
def ordered_mean(t: Tables) -> DataFrame:
    """Left-to-right mean: values are added in key order."""
    v = F.array_sort(F.collect_list(F.struct("c_custkey", "c_acctbal")))
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x["c_acctbal"])
    return t.read("customer").groupBy(F.col("c_mktsegment").alias("grp")).agg((total / F.count("*")).alias("mean"))


@query(" SELECT degree, count(*) AS n FROM (SELECT stmt, cid, count(*) AS degree FROM (SELECT stmt, src AS cid FROM edge UNION ALL SELECT stmt, tgt FROM edge) GROUP BY ALL) GROUP BY degree")
def degree_histogram(t: Tables) -> DataFrame:
    return G.edge_degree(t.edge).groupBy("degree").agg(F.count("*").alias("n"))


#: Graphs of one set, as many as are paired with each other.
SET_SIZE = 50


@query(f""", s AS (SELECT DISTINCT stmt, stmt // {SET_SIZE} AS k FROM node), p AS (SELECT stmt, stmt // {SET_SIZE} AS k, cid FROM node WHERE len(in_choices) > 0)
SELECT a.stmt AS graph_a, b.stmt AS graph_b FROM s a JOIN s b ON a.k = b.k AND a.stmt <> b.stmt ANTI JOIN (SELECT DISTINCT x.stmt AS i, y.stmt AS j FROM p x JOIN p y USING (k, cid)) o ON o.i = a.stmt AND o.j = b.stmt""")
def wrong_pairs_allowed(t: Tables) -> DataFrame:
    """Pairs of graphs of one set whose answer concepts are disjoint."""
    graphs = t.node.groupBy("stmt").agg(F.collect_set(F.when(F.size("in_choices") > 0, F.col("cid"))).alias("people")).withColumn("k", F.floor(F.col("stmt") / SET_SIZE))
    a, b = graphs.alias("a"), graphs.alias("b")
    return a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.stmt") != F.col("b.stmt"))).filter(~F.arrays_overlap("a.people", "b.people")).select(F.col("a.stmt").alias("graph_a"), F.col("b.stmt").alias("graph_b"))

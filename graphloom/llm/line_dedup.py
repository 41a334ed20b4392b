"""Line dedup with a log-template tree of fixed depth.

A line's tokens that hold digits, '@' or '://' are variable fields, masked <*>.  The
tree's levels are the number of tokens and the first LEAD tokens.  A line with MIN_TOKENS
or more fixed tokens, at least the share FIXED of them all, is of several templates of
its leaf: the tokens behind the lead are cut into runs of a fifth of the line, and each
template leaves one run open.  So a leaf has as many templates as it needs, and lines of
one template agree in four fifths of their tokens.

All other lines, and those of fewer than OPEN tokens, are templates of their own: masked,
or, if nothing in them is fixed, as they are.  A template that MIN_DOCS or more documents have (LONG_DOCS, if it is of LONG
or more tokens) is recurring.  Of several recurring templates a line is of the one that
most documents have (ties: the foremost open run).  Lines of a recurring template are
dropped but for the first (smallest doc_id, then line).

Cases: a null text has no lines and stays null; blank lines are never dropped.  Rows
with one doc_id and text are one document and are cut alike; null doc_ids come last.
Documents are never removed; other columns pass through clean_documents unchanged; an
empty table gives an empty result.  Templates are told apart by hashes of 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_hash, written

MIN_DOCS, LONG_DOCS, LONG = 5, 2, 50
LEAD, MIN_TOKENS, FIXED, OPEN = 3, 3, 0.6, 5
VARIABLE = "[0-9@]|://"


#: A whole token that holds a variable field; tried at token starts only, so long tokens cost their length.
_FIELD = r"(?<![^\x20])[^\x20]*?(?:[0-9@]|://)[^\x20]*"


def squeezed(text: Column) -> Column:
    """The lines of a text, their tokens one space apart."""
    plain = F.when(text.rlike(r"[\x09\x0B-\x0D]"), F.regexp_replace(text, r"[\x09\x0B-\x0D]", " ")).otherwise(text)
    one = lambda line: F.trim(F.when(F.contains(line, F.lit("  ")), F.regexp_replace(line, " +", " ")).otherwise(line))
    return F.transform(F.split(plain, "\n"), one)


def masked(line: Column) -> Column:
    """A squeezed line with <*> for variable fields."""
    return F.when(line.rlike(VARIABLE), F.regexp_replace(line, _FIELD, "<*>")).otherwise(line)


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds the content key without nulls: k0 (doc_id is null), k1, k2."""
    id_ = F.col("doc_id").cast("long")
    return docs.withColumn("k0", id_.isNull()).withColumn("k1", F.coalesce(id_, F.lit(0).cast("long"))).withColumn("k2", text_hash(F.col("text").cast("string")))


KEY = ["k0", "k1", "k2"]


def _lines(docs: DataFrame) -> DataFrame:
    """Every line that is not blank, with its number of tokens and the hash of its leaf."""
    text = F.col("text").cast("string")
    rows = _keyed(docs.select("doc_id", text.alias("text")))
    # Squeezed inside the generator: filters on what it gives can't make Spark do it again.
    rows = rows.select(*KEY, F.posexplode(squeezed(F.col("text"))).alias("no", "line")).filter("line <> ''")
    n = (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1).cast("int")
    return rows.withColumn("n", n).withColumn("leaf", F.xxhash64("n", masked(F.substring_index("line", " ", LEAD))))


def _enough(docs: str, min_docs: int) -> Column:
    return F.col(docs) >= F.when(F.col("n") >= LONG, F.lit(min(min_docs, LONG_DOCS))).otherwise(F.lit(min_docs))


def _templates() -> Column:
    """Names of the templates that a line (leaf, n, line, masked, fixed) may be of; in the order of their open runs."""
    # A leading space, which no squeezed line has, marks lines that stand as they are.
    own = F.array(F.xxhash64("leaf", F.when(F.col("fixed") == 0, F.concat(F.lit(" "), "line")).otherwise(F.col("masked"))))
    width = F.floor(F.col("n") / OPEN).cast("int")
    runs = F.ceil((F.col("n") - LEAD) / F.greatest(width, F.lit(1))).cast("int")

    def opened(tokens: Column) -> Column:
        rest = lambda at: F.xxhash64("leaf", at, F.slice(tokens, F.lit(1), at), F.slice(tokens, at + width + 1, F.col("n")))
        return F.transform(F.sequence(F.lit(0), runs - 1), lambda j: rest(LEAD + j * width))

    general = (F.col("fixed") >= MIN_TOKENS) & (F.col("fixed") >= FIXED * F.col("n")) & (F.col("n") >= OPEN)
    return F.when(general, F.element_at(F.transform(F.array(F.split("masked", " ")), opened), 1)).otherwise(own)


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Lines to drop: the content key and an array of line numbers.  Only hashes are shuffled."""
    spark = docs.sparkSession
    lines = _lines(docs)
    shared = lines.select("leaf", "n", F.xxhash64(*KEY).alias("doc")).distinct().groupBy("leaf", "n").agg(F.count("*").alias("docs"))
    leaves = written(spark, shared.filter(_enough("docs", min_docs)).select("leaf"))
    fields = F.when(F.contains("masked", F.lit("<*>")), F.size(F.filter(F.split("masked", " "), lambda t: t == "<*>"))).otherwise(0)
    full = lines.withColumn("masked", masked(F.col("line"))).withColumn("fixed", F.col("n") - fields)
    some = full.select(*KEY, "no", "leaf", "n", _templates().alias("names")).join(leaves, "leaf")
    # posexplode_outer: with posexplode Spark would compute all names once more, to filter by their number.
    named = written(spark, some.select(*KEY, "no", "n", F.posexplode_outer("names").alias("run", "name")))
    counted = named.select("name", "n", *KEY).distinct().groupBy("name", "n").agg(F.count("*").alias("docs"))
    # Small tables, written so that their size is known: the joins with them are broadcast if it allows, else split where skewed.
    often = written(spark, counted.filter(_enough("docs", min_docs)).select("name", "docs"))
    most = F.max(F.struct("docs", (-F.col("run")).alias("run"), "name"))
    chosen = written(spark, named.join(often, "name").groupBy(*KEY, "no").agg(most.alias("t")).select(*KEY, "no", "t.name"))
    firsts = written(spark, chosen.groupBy("name").agg(F.min(F.struct(*KEY, "no")).alias("first")))
    dropped = chosen.join(firsts, "name").filter(F.struct(*KEY, "no") != F.col("first"))
    return dropped.groupBy(*KEY).agg(F.collect_set("no").alias("drop"))


def _cut(docs: DataFrame, min_docs: int) -> DataFrame:
    """All columns of docs (as a struct, row), its lines, and the lines left."""
    held = _keyed(docs.select(F.col("doc_id"), F.col("text"), F.struct(*docs.columns).alias("row"))).select(*KEY, "row")
    cut = held.join(recurring(docs, min_docs), KEY, "left").withColumn("lines", F.split(F.col("row.text").cast("string"), "\n"))
    left = F.filter("lines", lambda line, i: ~F.array_contains("drop", i))
    return cut.withColumn("left", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(left))


def clean_documents(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with recurring lines dropped from text; n_chars, where there is one, follows."""
    cut = _cut(docs, min_docs).withColumn("text", F.array_join("left", "\n"))
    kinds = dict(docs.dtypes)
    new = {"text": F.col("text").cast(kinds["text"])}
    if "n_chars" in kinds:
        new["n_chars"] = F.when(F.col("drop").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast(kinds["n_chars"])
    return cut.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _cut(table(spark, sf_dir, "documents").select("doc_id", "text"), MIN_DOCS)
    text = F.coalesce(F.array_join("left", "\n"), F.lit(""))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return cut.select(F.col("row.doc_id").alias("doc_id"), size("lines").alias("n_lines"), (size("lines") - size("left")).alias("n_dropped"), F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("text_sha256"))


ORACLE_SQL = rf"""
WITH lines AS (
  SELECT doc_id, no, raw, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '{VARIABLE}') THEN '<*>' ELSE t END) AS tokens
  FROM (SELECT doc_id, no, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda t: t <> '') AS raw
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents))
  WHERE len(raw) > 0),
counts AS (SELECT *, len(tokens) AS n, len(list_filter(tokens, lambda t: t <> '<*>')) AS fixed FROM lines),
usable AS (
  SELECT doc_id, no, n, tokens, array_to_string(list_slice(tokens, 1, {LEAD}), ' ') AS lead, fixed >= {MIN_TOKENS} AND fixed >= {FIXED} * n AS general,
         CASE WHEN fixed = 0 THEN ' ' || array_to_string(raw, ' ') ELSE array_to_string(tokens, ' ') END AS masked, CASE WHEN n >= {LONG} THEN {LONG_DOCS} ELSE {MIN_DOCS} END AS enough
  FROM counts),
leaves AS (SELECT n, lead FROM usable GROUP BY n, lead, enough HAVING count(DISTINCT doc_id) >= enough),
shared AS (SELECT u.* FROM usable u JOIN leaves USING (n, lead)),
named AS (
  SELECT n, lead, enough, doc_id, no, unnest(
         CASE WHEN NOT general OR n < {OPEN} THEN [{{'run': 0, 'name': '=' || masked}}]
              ELSE list_transform(range(0, CAST(ceil((n - {LEAD}) / (n // {OPEN})) AS BIGINT)), lambda j: {{'run': j, 'name': '+' || j || ' ' || array_to_string(list_concat(
                list_concat(list_slice(tokens, 1, {LEAD} + j * (n // {OPEN})), ['<+>']), list_slice(tokens, {LEAD} + (j + 1) * (n // {OPEN}) + 1, n)), ' ')}}) END, recursive := true)
  FROM shared),
often AS (SELECT n, lead, name, count(DISTINCT doc_id) AS docs FROM named GROUP BY n, lead, name, enough HAVING count(DISTINCT doc_id) >= enough),
chosen AS (
  SELECT n, lead, name, doc_id, no FROM (
    SELECT n, lead, name, doc_id, no, row_number() OVER (PARTITION BY doc_id, no ORDER BY docs DESC, run) AS r FROM named JOIN often USING (n, lead, name)) WHERE r = 1),
firsts AS (SELECT n, lead, name, min(doc_id) AS first_doc, arg_min(no, doc_id * 1000000 + no) AS first_no FROM chosen GROUP BY n, lead, name),
dropped AS (SELECT doc_id, list(no) AS gone FROM chosen JOIN firsts USING (n, lead, name) WHERE NOT (doc_id = first_doc AND no = first_no) GROUP BY doc_id),
cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines,
         list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: string_split(text, chr(10))[i]) AS rest
  FROM documents LEFT JOIN dropped USING (doc_id))
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(rest) AS BIGINT) AS n_dropped,
       CAST(length(coalesce(array_to_string(rest, chr(10)), '')) AS BIGINT) AS n_chars_left, sha256(coalesce(array_to_string(rest, chr(10)), '')) AS text_sha256
FROM cut
"""

"""Answer spans, splitting with nesting, relation mentions, repetition and format of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..derive import Tables
from ..functions import spans as X
from .base import query

_S = X.SPACE
#: The same patterns with \b for the edges of a relation: digits and underscores are made dashes first, which keeps places.
_CLEAN = f"regexp_replace(regexp_replace(text, '(?m)^({_S}*)\\*{_S}+', '\\1- ', 'g'), '[*`]', '', 'g')"
_STRIP = f"'\\A{_S}+|{_S}+\\z', '', 'g'"


def _parts(tokens: str) -> str:
    """Tokens with the depth of brackets at each, and the parts between separators at depth 0."""
    return rf""", tok AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{tokens}') AS t FROM reply)),
run AS (SELECT *, sum(CASE tok WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM tok),
deep AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY i)) AS depth FROM run),
cut AS (SELECT *, tok IN (',', ';', chr(10)) AND depth = 0 AS sep FROM deep),
numbered AS (SELECT *, count(*) FILTER (WHERE sep) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM cut),
part AS (SELECT doc_id, no, string_agg(tok, '' ORDER BY i) AS part FROM numbered WHERE NOT sep GROUP BY doc_id, no),
whole AS (SELECT doc_id, unnest(range(0, n + 1)) AS no FROM (SELECT r.doc_id, count(*) FILTER (WHERE sep) AS n FROM reply r LEFT JOIN cut c ON c.doc_id = r.doc_id WHERE r.text IS NOT NULL GROUP BY r.doc_id))
SELECT doc_id, CAST(no AS INTEGER) AS no, coalesce(part, '') AS part FROM whole LEFT JOIN part USING (doc_id, no)"""


@query(_parts(r"[\[\],;\n]|[^\[\],;\n]+"))
def split_outside_brackets(t: Tables) -> DataFrame:
    """Every part of every text between commas, semicolons and line ends that stand outside brackets."""
    return t.reply.select("doc_id", F.posexplode(X.split_outside_brackets(F.col("text"))).alias("no", "part"))


@query(_parts('"[^"]*"?|“[^”]*”?|[\\[\\],;\\n]|[^"“\\[\\],;\\n]+'))
def split_outside_quotes(t: Tables) -> DataFrame:
    """Every part between separators that stand outside brackets and quotes."""
    return t.reply.select("doc_id", F.posexplode(X.split_outside_quotes(F.col("text"))).alias("no", "part"))


@query(rf""", clean AS (SELECT doc_id, {_CLEAN} AS c FROM reply),
cut AS (SELECT doc_id, c, string_split_regex(c, '(?i){X.MARKER}') AS p, string_split_regex(c, '(?im){X.ANSWER_LINE}') AS b,
  list_filter(list_transform(string_split_regex(c, '{X.LINE_END}'), lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> '') AS l FROM clean)
SELECT doc_id, CASE WHEN len(p) > 1 THEN regexp_replace(p[-1], '\A[ \t\r\n:,]+', '') WHEN len(l) > 1 THEN l[-1] ELSE c END AS span, CASE WHEN len(b) > 1 THEN b[-1] END AS block FROM cut""")
def answer_spans(t: Tables) -> DataFrame:
    """What follows each text's last answer marker, and its last line that begins with 'Answer:'."""
    return t.reply.select("doc_id", X.answer_span(F.col("text")).alias("span"), X.final_block(F.col("text")).alias("block"))


@query(rf""", plain AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZſK0123456789_', 'abcdefghijklmnopqrstuvwxyzsk-----------') AS x FROM reply),
pattern AS (SELECT unnest([{", ".join(f"'{k}'" for k in X.RELATION_KEYS)}]) AS relation, unnest([{", ".join("'" + chr(92) + "b" + "[^a-z]*".join(k) + chr(92) + "b'" for k in X.RELATION_KEYS)}]) AS p),
hit AS ({" UNION ALL ".join("SELECT doc_id, '" + k + "' AS relation, unnest(regexp_extract_all(x, '" + chr(92) + "b" + "[^a-z]*".join(k) + chr(92) + "b')) AS m, unnest(string_split_regex(x, '" + chr(92) + "b" + "[^a-z]*".join(k) + chr(92) + "b')[:-2]) AS gap, generate_subscripts(regexp_extract_all(x, '" + chr(92) + "b" + "[^a-z]*".join(k) + chr(92) + "b'), 1) AS no FROM plain" for k in X.RELATION_KEYS)}),
placed AS (SELECT doc_id, relation, len(m) AS size, sum(len(gap) + len(m)) OVER (PARTITION BY doc_id, relation ORDER BY no) AS stop FROM hit),
spans AS (SELECT doc_id, relation, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed)
SELECT * FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND a.stop <= b.stop AND (a.start <> b.start OR a.stop <> b.stop))""")
def relation_mentions(t: Tables) -> DataFrame:
    """Relations named in whole texts; of mentions inside each other the longest."""
    return X.relation_mentions(t.reply, "doc_id", "text")


@query(rf""", clean AS (SELECT doc_id, lower({_CLEAN}) AS c FROM reply),
one AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(c, '{X.LINE_END}'), lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> '')) AS l FROM clean),
bare AS (SELECT doc_id, regexp_replace(regexp_replace(l, '\A{_S}*[0-9]+[.)]{_S}*', ''), {_STRIP}) AS l FROM one),
loops AS (SELECT DISTINCT doc_id FROM bare WHERE len(regexp_extract_all(l, '[^{_S[1:-1]}]+')) >= 3 GROUP BY doc_id, l HAVING count(*) >= 3),
tok AS (SELECT doc_id, regexp_extract_all(c, '{X.TOKEN.replace("'", "''")}') AS t FROM clean),
run AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 10), lambda i: array_to_string(t[i : i + 11], ' '))) AS g FROM tok WHERE len(t) >= 36),
runs AS (SELECT DISTINCT doc_id FROM run GROUP BY doc_id, g HAVING count(*) >= 3)
SELECT doc_id, doc_id IN (SELECT doc_id FROM loops) AS repeated_line, doc_id IN (SELECT doc_id FROM runs) AS repeated_run FROM documents""")
def repetition_loops(t: Tables) -> DataFrame:
    """Texts in which a line of three words or more, or a run of twelve tokens, stands three times."""
    from ..functions.text import let

    found = let(F.lower(X.strip_markdown(F.coalesce("text", F.lit("")))), lambda c: F.struct(X.repeated_lines(c).alias("repeated_line"), X.repeated_runs(c).alias("repeated_run")))
    return t.reply.select("doc_id", found.alias("f")).select("doc_id", "f.*")


@query(rf""", clean AS (SELECT doc_id, regexp_replace({_CLEAN.replace("text", "coalesce(text, '')")}, {_STRIP}) AS c FROM reply),
cut AS (SELECT doc_id, c, string_split_regex(c, '(?im){X.ANSWER_LINE}') AS b FROM clean),
body AS (SELECT doc_id, c, CASE WHEN len(b) > 1 THEN b[-1] END AS payload FROM cut),
j AS (SELECT *, payload IS NOT NULL AS marker, regexp_replace(payload, {_STRIP}) AS x, NOT contains(regexp_replace(payload, '{_S}+\z', ''), chr(10)) AS flat,
  list_filter(list_transform(string_split_regex(payload, '{X.LINE_END}'), lambda y: regexp_replace(y, {_STRIP})), lambda y: y <> '') AS l FROM body)
SELECT doc_id, marker, coalesce(regexp_matches(x, '\A[-+]?[0-9]+\z'), false) AS number,
  coalesce(regexp_matches(x, '(?s)\A(?:[^,\[\]]|\[[^\[\]]*\])*,{_S}*[-+]?[0-9]+\z') AND regexp_matches(x, '\A[^,]*[^, "''“”]') AND flat, false) AS pair,
  coalesce(flat AND x <> '', false) AS items,
  coalesce(regexp_matches(payload, '\A[ \t]*(?:\n|\z)') AND len(l) > 0 AND len(list_filter(l, lambda y: NOT regexp_matches(y, '\A{X.TRIPLE}\z'))) = 0, false) AS triples,
  regexp_matches(c, '(?i){X.MARKUP_DUMP}') AS markup_dump FROM j""")
def format_diagnostics(t: Tables) -> DataFrame:
    """Whether whole texts end in an 'Answer:' line, and in which of the forms that are asked for."""
    return t.reply.select("doc_id", X.format_diagnostics(F.col("text")).alias("f")).select("doc_id", "f.*")


@query(rf"SELECT page_id, CAST(len(string_split_regex(html, '(?i){X.MARKUP_DUMP}')) - 1 AS INTEGER) AS tags FROM pages")
def markup_dumps(t: Tables) -> DataFrame:
    """How often markup of a recognised page shows in each page."""
    return t.read("pages").select("page_id", (F.size(F.split("html", rf"(?iu){X.MARKUP_DUMP}")) - 1).alias("tags"))

"""Answer spans, bracket- and quote-aware splitting, relation mentions, repetition loops.

Everything is a Catalyst expression but for the two scanners with nesting state, which
are vectorised functions, linear in the text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import let

# What counts as white space and as the end of a line, by the rules for Unicode texts that scores were made with.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Words that announce an answer.
MARKER = rf"\b(?:final{SPACE}+answer\b{SPACE}*(?:is\b)?|answer{SPACE}*:|therefore\b|in{SPACE}+conclusion\b|so{SPACE}+the\b|the{SPACE}+answer{SPACE}+is\b)"
ANSWER_LINE = rf"^{SPACE}*Answer{SPACE}*:"
LIST_ITEM = rf"^{SPACE}*(?:[-*•]|[0-9]+[.)]){SPACE}+(.+)$"
MARKUP_DUMP = rf"<{SPACE}*/?{SPACE}*(?:table|tr|td|th|html)\b|<\|(?:ref|det)\|>|```(?:html|xml)"
# Keys of the relations.
RELATION_KEYS = (
    "antonym", "atlocation", "capableof", "causes", "createdby", "isa", "desires", "hassubevent", "partof", "hascontext", "hasproperty", "madeof", "notcapableof", "notdesires", "receivesaction", "relatedto", "usedfor",
)
# A word or a sign.
TOKEN = rf"[\p{{L}}\p{{N}}_']+|[^\p{{L}}\p{{N}}_{SPACE[1:-1]}]"
#: Lines that repeat, and their least words; runs of words that repeat, their length and the least words of the text.
LINE_REPEATS, LINE_WORDS, RUN_REPEATS, RUN, RUN_WORDS = 3, 3, 3, 12, 36


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def lines(c: Column) -> Column:
    """The lines of a text, stripped, without blank ones."""
    return F.filter(F.transform(F.split(c, LINE_END), strip), lambda x: x != "")


def strip_markdown(c: Column) -> Column:
    """Bullets by stars become dashes; stars and back ticks that emphasise go."""
    return F.regexp_replace(F.regexp_replace(c, rf"(?md)^({SPACE}*)\*{SPACE}+", "$1- "), "[*`]", "")


def _after_last(clean: Column, marker: str) -> Column:
    """What follows the last place where a scan from the left finds the marker; null if there is none."""
    return let(F.split(clean, marker), lambda p: F.when(F.size(p) > 1, F.element_at(p, -1)))


def answer_span(c: Column) -> Column:
    """What follows the last answer marker, else the last line of several, else the whole text; Markdown is stripped first."""

    def pick(clean: Column) -> Column:
        marked = F.regexp_replace(_after_last(clean, rf"(?iuU){MARKER}"), r"\A[ \t\r\n:,]+", "")
        return F.coalesce(marked, let(lines(clean), lambda x: F.when(F.size(x) > 1, F.element_at(x, -1))), clean)

    return let(strip_markdown(c), pick)


def final_block(c: Column) -> Column:
    """What follows the last line that begins with 'Answer:'; null if none does."""
    return let(strip_markdown(c), lambda clean: _after_last(clean, rf"(?imud){ANSWER_LINE}"))


def structured_span(c: Column) -> Column:
    """answer_span, but without a marker the region from the first list item or triple to the last one."""

    def region(clean: Column) -> Column:
        items = let(lines(clean), lambda x: F.transform(x, lambda line: F.struct(line.alias("line"), (line.rlike(rf"(?u){LIST_ITEM}") | holds_triple(line)).alias("item"))))
        flags = lambda x: F.transform(x, lambda e: e["item"])
        first = lambda x: F.array_position(flags(x), True).cast("int")
        last = lambda x: F.size(x) + 1 - F.array_position(F.reverse(flags(x)), True).cast("int")
        return let(items, lambda x: F.when(first(x) > 0, F.array_join(F.transform(F.slice(x, first(x), last(x) - first(x) + 1), lambda e: e["line"]), "\n")))

    return F.coalesce(let(strip_markdown(c), lambda clean: F.when(~clean.rlike(rf"(?iuU){MARKER}"), region(clean))), answer_span(c))


_KEPT = r"\[[^\[\]()]*\]"
_FULL = rf"{SPACE}*(?:[^{SPACE[1:-1]},()\[\]]|{_KEPT})(?:[^,()\[\]]|{_KEPT})*"
#: A bracketed group of three fields, none of them blank; commas inside [...] do not count.
TRIPLE = rf"\({_FULL},{_FULL},{_FULL}\)"
#: The same without a way back, of which a repeated group needs none here: its alternatives start with different signs and
#: none of them with the sign that follows.  Java's groups that may go back take stack for every sign of a text.
_TRIPLE_ONCE = TRIPLE.replace(")*", ")*+")


def holds_triple(line: Column) -> Column:
    """Whether a line holds a bracketed group of three fields, none of them blank."""
    return line.rlike(_TRIPLE_ONCE)


# --- scanners --------------------------------------------------------------------------


def fields(text: str | None, separators: str = ",;\n", quotes: bool = False) -> list[str] | None:
    """The parts of a text between separators outside [...] and, if asked for, outside "..." and curly quotes.

    Brackets may be nested; a closing one without its opening one is ordinary; one that
    is never closed, or a quote that is not, keeps all that follows together.
    """
    if text is None:
        return None
    parts, start, depth, closing = [], 0, 0, ""
    for m in re.finditer("[\\[\\]" + re.escape(separators) + ('"“”' if quotes else "") + "]", text):
        sign = m[0]
        if closing:
            closing = "" if sign == closing else closing
        elif sign in "[]":
            depth = depth + 1 if sign == "[" else max(0, depth - 1)
        elif quotes and sign in '"“':
            closing = "”" if sign == "“" else '"'
        elif sign in separators and not depth:
            parts.append(text[start : m.start()])
            start = m.end()
    return [*parts, text[start:]]


@F.pandas_udf(ArrayType(StringType()))
def split_outside_brackets(text: pd.Series) -> pd.Series:
    return text.map(fields, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def split_outside_quotes(text: pd.Series) -> pd.Series:
    return text.map(lambda t: fields(t, quotes=True), na_action="ignore")


def unquote(c: Column) -> Column:
    """A stripped value without the pair of quotes around it."""
    return let(strip(c), lambda v: F.when(v.rlike(r'(?s)\A(?:".*"|“.*”)\z'), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v))


def label_list(c: Column) -> Column:
    """Labels of a list: all quoted ones, if nothing but commas, 'and' and 'or' stands between them; else its fields without bullets and quotes."""
    quoted = r'("[^"]*"|“[^”]*”)'
    body = strip(F.regexp_replace(strip(c), r"\.\z", ""))
    only = F.regexp_replace(body, quoted, "").rlike(rf"(?iu)\A(?:{SPACE}|[,;])*(?:(?:and|or)(?:{SPACE}|[,;])*)*\z")
    whole = F.transform(F.regexp_extract_all(body, F.lit(quoted), 1), unquote)
    loose = F.transform(split_outside_quotes(body), lambda p: unquote(F.regexp_replace(p, rf"\A{SPACE}*(?:[-•]|[0-9]+[.)]){SPACE}*", "")))
    return F.filter(F.when(only & (F.size(whole) > 0), whole).otherwise(loose), lambda x: x != "")


# --- relation mentions -----------------------------------------------------------------


#: Letters of any case as small ones, the two signs that fold into ASCII letters among them.
_FOLD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ\u017f\u212a", "abcdefghijklmnopqrstuvwxyzsk")


def _found(text: Column, key: str) -> Column:
    """The matches of a relation's letters with anything but letters between them: size of the gap before each, and its own."""
    pattern = "(?<![a-z])" + "[^a-z]*".join(key) + "(?![a-z])"
    both = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern), lambda m, gap: F.struct(F.length(m).alias("size"), F.length(gap).alias("gap")))
    return F.transform(F.filter(both, lambda x: x["size"].isNotNull()), lambda x, i: F.struct(F.lit(key).alias("relation"), i.alias("no"), x["gap"].alias("gap"), x["size"].alias("size")))


def relation_mentions(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, start, stop, relation of every mention that lies inside no longer one.

    Places (from 0, in code points) come from the gaps between matches; a match is
    inside another if one that starts no later stops no sooner.  Only matches are shuffled.
    """
    none = F.array().cast("array<struct<relation:string,no:int,gap:int,size:int>>")

    def found(x: Column) -> Column:
        # A relation can only be named where its letters follow each other once all else is left out.
        return let(F.regexp_replace(x, "[^a-z]+", ""), lambda bare: F.concat(*(F.when(F.contains(bare, F.lit(k)), _found(x, k)).otherwise(none) for k in RELATION_KEYS)))

    every = rows.select(key, F.explode(let(F.translate(F.col(text), *_FOLD), found)).alias("m")).select(key, "m.*")
    past = Window.partitionBy(key, "relation").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap") + F.col("size")).over(past)
    placed = every.withColumn("stop", stop).select(key, "relation", (F.col("stop") - F.col("size")).alias("start"), "stop")
    # Spans in order of start, the longer first; equal spans are peers and don't hide each other.
    order = Window.partitionBy(key).orderBy("start", F.desc("stop"))
    spans = placed.groupBy(key, "start", "stop").agg(F.collect_list("relation").alias("relations"))
    seen = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = spans.withColumn("seen", seen).filter("seen is null or seen < stop")
    return kept.select(key, "start", "stop", F.explode("relations").alias("relation"))


# --- repetition ------------------------------------------------------------------------


def _thrice(sorted_items: Column, n: int, same) -> Column:
    """Whether some item of a sorted array stands n times in it."""
    return let(sorted_items, lambda s: F.when(F.size(s) < n, F.lit(False)).otherwise(F.exists(F.sequence(F.lit(0), F.size(s) - n), lambda i: same(s, i))))


def repeated_lines(clean: Column) -> Column:
    """Whether a line of LINE_WORDS words or more, without its number, stands LINE_REPEATS times."""
    bare = F.transform(lines(clean), lambda x: strip(F.regexp_replace(x, rf"\A{SPACE}*[0-9]+[.)]{SPACE}*", "")))
    long = F.filter(bare, lambda x: x.rlike(rf"(?:[^{SPACE[1:-1]}]+{SPACE}+){{{LINE_WORDS - 1}}}[^{SPACE[1:-1]}]"))
    return _thrice(F.array_sort(long), LINE_REPEATS, lambda s, i: F.get(s, i) == F.get(s, i + (LINE_REPEATS - 1)))


def repeated_runs(clean: Column) -> Column:
    """Whether a run of RUN tokens stands RUN_REPEATS times.  Runs are sorted by hash and compared by their tokens where hashes agree."""

    def check(tokens: Column) -> Column:
        def same(s: Column, i: Column) -> Column:
            a, b = F.get(s, i), F.get(s, i + (RUN_REPEATS - 1))
            return (a["h"] == b["h"]) & (F.slice(tokens, a["at"], RUN) == F.slice(tokens, b["at"], RUN))

        def some(hashes: Column) -> Column:
            runs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("at")))
            # A run that stands RUN_REPEATS times leaves as many fewer distinct ones, less itself; most texts need no sort.
            few = F.size(F.array_distinct(hashes)) > F.size(hashes) - (RUN_REPEATS - 1)
            return F.when(few, F.lit(False)).otherwise(_thrice(F.array_sort(runs), RUN_REPEATS, same))

        hashes = let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (RUN - 1)), lambda i: F.xxhash64(F.slice(w, i, RUN))))
        return F.when(F.size(tokens) < RUN_WORDS, F.lit(False)).otherwise(let(hashes, some))

    return let(F.regexp_extract_all(clean, F.lit(rf"({TOKEN})"), 1), check)


def repetition_loop(c: Column) -> Column:
    """Whether a text goes round in circles: the same line or the same run of tokens three times.  Null counts as empty."""
    return let(F.lower(strip_markdown(F.coalesce(c, F.lit("")))), lambda clean: repeated_lines(clean) | repeated_runs(clean))


def format_diagnostics(c: Column) -> Column:
    """struct: whether there is a final 'Answer:' line and what it holds is in the form asked for, by kind of task.

    number: one integer; pair: a name, a comma and an integer, on the marker's line;
    items: something on the marker's line; triples: one triple a line below it.
    """
    head = rf"(?imud){ANSWER_LINE}"

    def judge(clean: Column) -> Column:
        def form(payload: Column) -> Column:
            has = F.coalesce(payload.isNotNull(), F.lit(False))
            body = strip(payload)
            tail = F.regexp_replace(payload, rf"{SPACE}+\z", "")  # stripped with the marker before it
            one_line = ~tail.contains("\n")
            rows = lines(payload)
            number = body.rlike(r"\A[-+]?[0-9]+\z")
            pair = body.rlike(rf"(?s)\A(?=[^,]*[^, \"'“”])(?:[^,\[\]]|\[[^\[\]]*\])*+,{SPACE}*[-+]?[0-9]+\z") & one_line
            triples = payload.rlike(r"\A[ \t]*(?:\n|\z)") & (F.size(rows) > 0) & F.forall(rows, lambda x: x.rlike(rf"\A{_TRIPLE_ONCE}\z"))
            yes = lambda x: F.coalesce(has & x, F.lit(False))
            return F.struct(has.alias("marker"), yes(number).alias("number"), yes(pair).alias("pair"), yes(one_line & (body != "")).alias("items"), yes(triples).alias("triples"), clean.rlike(rf"(?iu){MARKUP_DUMP}").alias("markup_dump"))

        return let(_after_last(clean, head), form)

    return let(strip(strip_markdown(F.coalesce(c, F.lit("")))), judge)


def ceiling_class(diagnostics: Column, compliant: str, loop: Column) -> Column:
    """Why a reply that ran into the length limit did: its answer block, a loop, or neither."""
    return F.when(diagnostics["marker"] & ~diagnostics[compliant], "answer_block_too_long").when(loop, "repetition_loop").otherwise("progressing_reasoning")

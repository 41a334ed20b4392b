"""Text functions as Catalyst expressions: normalising, letters, integers, relation keys, set scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"
TIERS = ("raw", "basic", "annotation_stripped")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def normalise(c: Column, tier: str) -> Column:
    """raw: trimmed.  basic: also lower case, single spaces, no closing punctuation.  annotation_stripped: also without a closing [A,B]."""
    value = strip(c)
    if tier == "raw":
        return value
    if tier not in TIERS:
        raise ValueError(tier)
    closing = r"(?U)[\s.!?;:]+\z"
    value = F.regexp_replace(strip(F.regexp_replace(F.lower(value), r"(?U)\s+", " ")), closing, "")
    if tier == "annotation_stripped":
        value = F.regexp_replace(value, r"(?iU)\s*\[\s*[A-D](?:\s*,\s*[A-D])*\s*\]\s*\z", "")
        value = strip(F.regexp_replace(value, closing, ""))
    return value


def near(a: Column, b: Column, distance: int = 2) -> Column:
    """Edit distance at most so much, after a closing [A,B] is dropped."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s*\[[A-Z](?:,[A-Z])*\]\z", "")
    return F.levenshtein(bare(a), bare(b), distance) >= 0


def integers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"([-+]?[0-9]+)"), 1), lambda x: x.try_cast("bigint"))


def relation_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def let(value: Column, then) -> Column:
    """then(value), with value computed once and not repeated in generated code."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _one_letter(found: Column) -> Column:
    distinct = F.array_distinct(found)
    return F.when(F.size(distinct) == 1, F.element_at(distinct, 1))


def parse_letter(c: Column, n_choices: int = 4, version: str = "explicit_v1") -> Column:
    """struct(letter, tier); FAILED where there is no unambiguous answer.

    Tiers in order: the whole text is a letter; a sole letter in brackets or with a
    stop; one option with its text; explicit answers; bold letters.  explicit_v2 also
    takes the first line that is not blank.
    """
    if version not in ("explicit_v1", "explicit_v2"):
        raise ValueError(version)
    last = "ABCD"[n_choices - 1]
    valid = lambda x: F.when(x.between("A", last), x)
    some = lambda x, pattern: valid(F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")))
    explicit = F.lit(r"(?iU:\b(?:correct\s+)?answer\s+is\s*|\bcorrect\s+answer\s*:\s*)(?:\*\*)?[(\[]?([A-D])(?=(?U:[\s)\]*.,:;!?])|\z)")
    bold = F.lit(r"\*\*(?U:\s*)[(\[]?([A-D])[)\]]?[.!]?(?U:\s*)\*\*")
    tag = lambda t: lambda x: F.struct(x.alias("letter"), F.lit(t).alias("tier"))

    def named(x: Column, tier: str) -> Column:
        return let(x, lambda v: F.when(v.isNotNull(), tag(tier)(v)))

    def stated(text: Column) -> Column:
        pick = lambda found, tier: named(valid(_one_letter(found)), tier)
        return let(F.regexp_extract_all(text, explicit, 1), lambda found: F.when(F.size(found) > 0, pick(found, "explicit_answer")).otherwise(let(F.regexp_extract_all(text, bold, 1), lambda b: pick(b, "bold_letter"))))

    def tiers(text: Column) -> Column:
        prose = F.substring(text, 4, 1 << 30).rlike(r"(?U)\b[A-D]\b")
        option = F.when(~prose, some(text, r"\A([A-D])\. +[^\n.!?]+[.!?]?\z"))
        return F.coalesce(named(some(text, r"\A([A-D])\z"), "exact"), named(some(text, r"\A[(\[]?([A-D])[)\]]?[.!]?\z"), "sole_letter"), named(option, "option_prefix"), stated(text))

    found = [let(strip(c), tiers)]
    if version == "explicit_v2":
        first = F.get(F.filter(F.split(c, r"\R"), lambda x: x.rlike(r"(?U)\S")), F.lit(0))
        found.append(named(some(F.coalesce(first, F.lit("")), r"(?U)\A\s*\**\(?([ABCD])\)?[.):]?\**\s*\z"), "first_line_letter"))
    return F.coalesce(*found, tag("FAILED")(F.lit("FAILED")))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """The phrase stands in the text between non-word characters, whatever the case; an empty phrase never does."""
    quoted = F.regexp_replace(phrase, r"([\\^$.|?*+()\[\]{}\-#&~\s])", r"\\$1")
    return F.when(phrase == "", F.lit(False)).otherwise(F.regexp_like(text, F.concat(F.lit(r"(?iuU)(?<!\w)"), quoted, F.lit(r"(?!\w)"))))


def parse_letter_fallback(c: Column, choices: Column) -> Column:
    """explicit_v1, then 'is X.', then one choice named in the text; choices: map letter -> name."""
    letters = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\bis\s+([A-D])\."), 1))
    named = F.map_keys(F.map_filter(choices, lambda _, name: contains_phrase(c, name)))
    tag = lambda x, t: F.struct(x.alias("letter"), F.lit(t).alias("tier"))
    failed = tag(F.lit("FAILED"), "FAILED")
    by_name = F.when(F.size(named) == 1, tag(F.element_at(named, 1), "choice_name")).otherwise(failed)
    by_is = F.when(F.size(letters) == 1, tag(F.element_at(letters, 1), "is_letter")).when(F.size(letters) > 1, failed)
    return let(parse_letter(c), lambda first: F.when(first["letter"] != "FAILED", first).otherwise(F.coalesce(by_is, by_name)))


def cyclic_choices(choices: Column, shift: Column, n: int = 4) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(choices, (F.pmod(i + shift, F.lit(n)) + 1).cast("int")))


def hash_slot(key: Column, n: int) -> Column:
    """A stable slot: the hexadecimal SHA-256 of the key, modulo n, digit by digit."""
    digits = F.split(F.sha2(key, 256), "")
    value = lambda d: F.conv(d, 16, 10).cast("int")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda acc, d: (acc * 16 + value(d)) % n)


def set_scores(gold: Column, predicted: Column, malformed: Column | int = 0) -> Column:
    """struct of true and false positives, false negatives, precision, recall, f1 and exact, over distinct items.

    An empty prediction has precision 0; with empty gold its recall is 1.  Malformed items are false positives and leave recall alone.
    """
    bad = F.lit(malformed) if isinstance(malformed, int) else malformed
    g, p = F.array_distinct(gold), F.array_distinct(predicted)
    tp = F.size(F.array_intersect(g, p))
    fp, fn = F.size(F.array_except(p, g)) + bad, F.size(F.array_except(g, p))
    precision = F.when(tp + fp == 0, 0.0).otherwise(tp / F.nullif(tp + fp, F.lit(0)))
    recall = F.when(F.size(g) == 0, (F.size(p) == 0).cast("double")).otherwise(tp / F.nullif(F.size(g), F.lit(0)))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))
    return F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), ((fp == 0) & (fn == 0)).alias("exact"))

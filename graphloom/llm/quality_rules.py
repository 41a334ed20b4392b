"""Quality rules whose cutoffs come with a bound on false rejections.

Each rule rejects a document whose ratio lies above a cutoff.  In every stratum
(language) the labelled documents are halved by a hash of their id.  One half fits a
cutoff for each rule and orders the rules by what they gain.  The other half, not
looked at before, tests the nested rule sets (the first rule, the first two, ...) one
after another with exact binomial probabilities, up to the first that fails: with
confidence 1 - DELTA over all strata together (each has an equal share), at most a
share ALPHA of a stratum's good documents is rejected.  Strata with too few labelled
documents share one pooled stratum, fitted and tested over all languages.

Cases: null and empty texts have no words and fail the base rule.  Null languages are a
stratum like any other; labels that are null, or whose document is absent, are passed
over; of several labels of one document the lowest counts.  Repeated rows are judged
each, and alike; null doc_ids stay null; other columns are ignored.  Without labels only
the base rule rejects.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

ALPHA, DELTA = 0.03, 0.05
MIN_WORDS, MAX_REPEATED = 50, 0.5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

#: rule -> cutoffs, lenient to strict.
_SHARES = [round(0.9 * 0.88**i, 5) for i in range(40)]
RULES = {
    "symbols": _SHARES,
    "upper": _SHARES,
    "exclaims": _SHARES,
    "dup_lines": _SHARES,
    "repeats": _SHARES,
    "top_word": _SHARES,
    "word_len": [round(60 * 0.93**i, 3) for i in range(32)],
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(text: str | None) -> tuple:
    """The five counts of a text, then the ratio of each rule."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    n = len(words)
    symbols = sum(map(text.count, SYMBOLS))
    if not n:
        return (0, 0, symbols, 0, 0, *[0.0] * len(RULES))
    chars = len(text) - sum(map(text.count, BLANKS))
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            dup += line in seen
            seen.add(line)
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], dtype=np.int64)
    repeated = 0
    if n >= 3:
        pair = w[:-1] * len(ids) + w[1:]
        if len(ids) >= 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1]
        windows = pair[:-1] * len(ids) + w[2:]
        _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeated = int(covered.sum())
    upper = sum(1 for x in words if len(x) > 1 and x.isupper())
    top = int(np.bincount(w).max())
    ratios = (symbols / n, upper / n, text.count("!") / n, dup / lines, repeated / n, top / n if n >= MIN_WORDS else 0.0, chars / n)
    return (n, chars, symbols, dup, repeated, *ratios)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*COUNTS, *RULES]
    kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(RULES)
    for b in batches:
        rows = [measure(t.as_py()) for t in b["text"]]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["lang"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "lang", *names])


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the counts and the ratios: the only pass over texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_measured, "doc_id long, lang string, " + ", ".join([f"{c} long" for c in COUNTS] + [f"{r} double" for r in RULES]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words"))


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for a binomial X of n trials, exactly summed from log terms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


@dataclass(frozen=True)
class Chosen:
    """A stratum's tested rule set: cutoffs by rule; rejected and tested are of the holdout."""

    cutoffs: tuple[tuple[str, float], ...]
    rejected: int
    tested: int


def order_rules(good: dict[str, list[int]], bad: dict[str, list[int]]) -> list[tuple[str, float]]:
    """Rules with a gain on the fitting half, best first.  good[r][j]: documents rejected at cutoff j; the last entry has all."""
    found = []
    for rule, cutoffs in RULES.items():
        n_good, n_bad = max(good[rule][-1], 1), max(bad[rule][-1], 1)
        gains = [b / n_bad - 10 * g / n_good for g, b in zip(good[rule][:-1], bad[rule][:-1], strict=True)]
        best = max(gains)
        if best > 0:
            # Of cutoffs that gain nearly as much, the one midway between the most lenient and the strictest.
            near = [j for j, x in enumerate(gains) if x >= best - 0.002]
            found.append((-best, rule, cutoffs[near[len(near) // 3]]))
    return [(rule, cut) for _, rule, cut in sorted(found)]


def _stratum() -> Column:
    return F.concat(F.lit("="), F.coalesce("lang", F.lit("\0")))


def select_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, Chosen]:
    """Tested rule sets by stratum ('*' is the pooled one), from rows with lang, good, half and the ratios."""
    spark = labelled.sparkSession
    sizes = written(spark, labelled.groupBy("stratum").agg(F.count(F.when(F.col("good") & (F.col("half") == 1), 1)).alias("n")))
    enough = 2 * math.log((sizes.count() + 1) / delta) / alpha
    own = written(spark, sizes.filter(F.col("n") >= enough).select("stratum", F.lit(True).alias("own")))
    # As many as the labelled documents have room for.
    strata = sorted(r["stratum"] for r in own.collect())
    level = delta / (len(strata) + 1)
    # Two rows for a document of an own stratum: its own and the pooled one.
    each = labelled.join(own, "stratum", "left").withColumn("stratum", F.explode(F.when(F.col("own"), F.array("stratum", F.lit("*"))).otherwise(F.array(F.lit("*"))))).drop("own")
    counts = [F.count(F.when(F.col(r) > c, 1)).alias(f"{r}_{j}") for r, cs in RULES.items() for j, c in enumerate(cs)]
    fit: dict[tuple, dict] = {}
    for row in each.filter("half = 0").groupBy("stratum", "good").agg(F.count("*").alias("n"), *counts).collect():
        fit[row["stratum"], row["good"]] = {r: [row[f"{r}_{j}"] for j in range(len(cs))] + [row["n"]] for r, cs in RULES.items()}
    none = {r: [0] * (len(cs) + 1) for r, cs in RULES.items()}
    ordered = {s: order_rules(fit.get((s, True), none), fit.get((s, False), none)) for s in [*strata, "*"]}
    # Position (from 1) of the first of its stratum's rules that rejects a row; 0 if none does.
    first = F.array_position(F.transform("cuts", lambda c: F.element_at(_ratios(), c["rule"]) > c["cut"]), True)
    held = each.filter("half = 1 and good").join(_table(spark, ordered), "stratum").groupBy("stratum", first.alias("at")).agg(F.count("*").alias("n"))
    hits: dict[str, dict] = {s: {} for s in ordered}
    for r in held.collect():
        hits[r["stratum"]][r["at"]] = r["n"]
    out = {}
    for s, rules in ordered.items():
        n, passed, rejected = sum(hits[s].values()), 0, 0
        while passed < len(rules) and n and at_most(rejected + hits[s].get(passed + 1, 0), n, alpha) <= level:
            passed += 1
            rejected += hits[s].get(passed, 0)
        out[s] = Chosen(tuple(rules[:passed]), rejected, n)
    return out


def _ratios() -> Column:
    return F.create_map(*(x for r in RULES for x in (F.lit(r), F.col(r))))


def _table(spark: SparkSession, rules: dict[str, list]) -> DataFrame:
    """stratum, cuts: each stratum's rules and cutoffs in their order."""
    return spark.createDataFrame([(s, [(r, float(c)) for r, c in rs]) for s, rs in rules.items()], "stratum string, cuts array<struct<rule string, cut double>>")


def verdicts(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Adds base_failed and kept to measured documents (read several times: a table)."""
    quality = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q")).filter("doc_id is not null and q is not null").groupBy("doc_id").agg(F.min("q").alias("q"))
    judged = measured.withColumn("stratum", _stratum())
    labelled = judged.filter(~base_failed()).join(quality, "doc_id").withColumn("good", F.col("q") == 1).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)))
    chosen = select_cutoffs(written(measured.sparkSession, labelled.select("stratum", "good", "half", *RULES)), alpha, delta)

    cuts = _table(measured.sparkSession, {k: c.cutoffs for k, c in chosen.items() if k != "*"})
    pooled = F.lit(True)
    for rule, cut in chosen["*"].cutoffs:
        pooled = pooled & (F.col(rule) <= cut)
    verdict = F.when(F.col("cuts").isNull(), pooled).otherwise(F.forall("cuts", lambda c: F.element_at(_ratios(), c["rule"]) <= c["cut"]))
    judged = judged.join(F.broadcast(cuts), "stratum", "left")
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict).drop("stratum", "cuts")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = written(spark, measures(table(spark, sf_dir, "documents")))
    return verdicts(measured, table(spark, sf_dir, "labels")).select("doc_id", *COUNTS, "base_failed", "kept")

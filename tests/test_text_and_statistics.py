import math
from itertools import product

import pytest
from pyspark.sql import functions as F

from graphloom.functions import statistics as S
from graphloom.functions import text as X
from graphloom.operators import validate as V
from graphloom.streaming.resume import append_once


def values(spark, expression, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


LETTERS = {
    "A": ("A", "exact"), "(B)": ("B", "sole_letter"), "C.": ("C", "sole_letter"), "D. a long tail": ("D", "option_prefix"), "D. B is wrong": ("FAILED", "FAILED"), "The answer is B.": ("B", "explicit_answer"),
    "the correct answer: **C**": ("C", "explicit_answer"), "answer is A, or the answer is B": ("FAILED", "FAILED"), "I say **D**": ("D", "bold_letter"), "**A** and **B**": ("FAILED", "FAILED"), "maybe A": ("FAILED", "FAILED"),
    "answer is a": ("FAILED", "FAILED"), " B \n": ("B", "exact"), "": ("FAILED", "FAILED"), "ANSWER IS  (C)": ("C", "explicit_answer"), "**A** but the answer is B": ("B", "explicit_answer"), "answer is Apple": ("FAILED", "FAILED"), "A\nbecause": ("FAILED", "FAILED"),
}


def test_letters_v1(spark):
    got = values(spark, X.parse_letter(F.col("t")), list(LETTERS))
    assert {t: tuple(g) for t, g in zip(LETTERS, got)} == LETTERS
    assert tuple(values(spark, X.parse_letter(F.col("t"), 2), ["C"])[0]) == ("FAILED", "FAILED")


def test_letters_v2_reads_the_first_line(spark):
    got = values(spark, X.parse_letter(F.col("t"), 4, "explicit_v2"), ["\n\nB.\nbecause", "\n\n**B.**\nbecause", "A)\nthe answer is D", "So: B\nA"])
    assert [tuple(g) for g in got] == [("B", "first_line_letter"), ("B", "bold_letter"), ("D", "explicit_answer"), ("FAILED", "FAILED")]


def test_fallback(spark):
    names = F.create_map(F.lit("A"), F.lit("red fox"), F.lit("B"), F.lit("a+b"))
    got = values(spark, X.parse_letter_fallback(F.col("t"), names), ["it is B.", "is A. is B.", "The Red Fox ran", "red foxes", "so a+b it is", "red fox, a+b"])
    assert [g[0] for g in got] == ["B", "FAILED", "A", "FAILED", "B", "FAILED"]


def test_normalise(spark):
    texts = ["  Garden  Soil [A,B]. ", "Café [a]", " x y "]
    assert values(spark, X.normalise(F.col("t"), "raw"), texts) == ["Garden  Soil [A,B].", "Café [a]", "x y"]
    assert values(spark, X.normalise(F.col("t"), "basic"), texts) == ["garden soil [a,b]", "café [a]", "x y"]
    assert values(spark, X.normalise(F.col("t"), "annotation_stripped"), texts) == ["garden soil", "café", "x y"]


def test_near(spark):
    df = spark.createDataFrame([("jewelry box [A,B]", "jewlery box [C]", True), ("garden soil", "water bottle", False)], "a string, b string, w boolean")
    assert all(r.w == r.n for r in df.select("w", X.near(F.col("a"), F.col("b")).alias("n")).collect())


@pytest.mark.parametrize("gold,pred,bad,want", [([1, 2], [1, 2], 0, (1, 1, 1)), ([], [], 0, (0, 1, 0)), ([1], [], 0, (0, 0, 0)), ([], [1], 0, (0, 0, 0)), ([1, 2], [1, 2], 1, (2 / 3, 1, 0.8)), ([1, 1, 2], [2, 2], 0, (1, 0.5, 2 / 3))])
def test_set_scores(spark, gold, pred, bad, want):
    s = spark.createDataFrame([(gold, pred)], "g array<int>, p array<int>").select(X.set_scores(F.col("g"), F.col("p"), bad).alias("s")).first().s
    assert (s.precision, s.recall, s.f1) == pytest.approx(want)


def test_mcnemar(spark):
    cases = [(0, 0), (0, 5), (5, 10), (12, 30), (3, 3), (400, 900)]
    got = spark.createDataFrame(cases, "b long, c long").select(S.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    for (b, c), r in zip(cases, got):
        exact = 1.0 if b + c == 0 else min(1.0, 2 * sum(math.comb(b + c, k) for k in range(min(b, c) + 1)) / 2 ** (b + c))
        assert r.p == pytest.approx(exact, rel=1e-9)


def test_ranks_and_correlation(spark):
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in ((1, 1), (2, 3), (2, 2), (3, 4))] + [("c", 1.0, 2.0), ("c", 1.0, 3.0)], "k string, x double, y double")
    ranks = sorted(r[0] for r in df.filter("k = 'g'").select(S.average_rank("x", "k")).collect())
    assert ranks == [1.0, 2.5, 2.5, 4.0]
    rho = {r.k: r.rho for r in S.spearman(df, "x", "y", "k").collect()}
    assert rho["g"] == pytest.approx(0.9486832980505138) and rho["c"] is None


def test_resampling_is_stable(spark):
    df = spark.createDataFrame([("a", v, v > 0.5) for v in (0.0, 0.5, 0.5, 1.0)], "k string, v double, h boolean")
    one, two = (S.bootstrap_mean(x, "k", "v", 2000).collect() for x in (df, df.repartition(4)))
    assert one == two and one[0].ci_low <= one[0].mean <= one[0].ci_high
    assert 0 < S.permutation_p(df, "k", "v", "h", 200).first().p <= 1


def test_contains_phrase(spark):
    for text, phrase, want in (("a (b)", "(b)", True), ("abc", "b", False), ("A.B", "a.b", True), ("axb", "a.b", False), ("x", "", False)):
        assert spark.createDataFrame([(text, phrase)], "t string, p string").select(X.contains_phrase(F.col("t"), F.col("p"))).first()[0] == want


def test_checks_find_corruption(spark):
    good = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, kind string, n int")
    bad = spark.createDataFrame([(1, "a", 1), (1, "c", 1), (3, None, 2)], "id int, kind string, n int")
    checks = [lambda d: V.duplicate_keys(d, ["id"]), lambda d: V.missing_fields(d, ["id"], ["kind"]), lambda d: V.outside(d, "kind", ["a", "b"], ["id"]), lambda d: V.cover(good, d, ["id"]), lambda d: V.inconsistent(d, ["id"], "kind"), lambda d: V.differing(d, ["id"], F.col("n"), F.col("id"))]
    for check in checks:
        assert check(good).isEmpty() and not check(bad).isEmpty()


def test_append_once_survives_replay(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(10).withColumnRenamed("id", "k")
    df.write.parquet(src)
    for run in ("c1", "c2"):  # a new checkpoint replays everything
        append_once(spark.readStream.schema(df.schema).parquet(src), out, ["k"], str(tmp_path / run)).awaitTermination()
    assert spark.read.parquet(out).count() == 10


def test_cyclic_and_slots(spark):
    got = [r[0] for r in spark.range(4).select(F.array_join(X.cyclic_choices(F.array(*map(F.lit, "wxyz")), F.col("id")), "")).collect()]
    assert got == ["wxyz", "xyzw", "yzwx", "zwxy"]
    import hashlib

    for key, n in product(("a", "b"), (5, 7)):
        assert spark.range(1).select(X.hash_slot(F.lit(key), n)).first()[0] == int(hashlib.sha256(key.encode()).hexdigest(), 16) % n

"""Texts long enough to end a pattern that goes back sign by sign, and the same results as before."""

from pyspark.sql import functions as F

from graphloom.functions import spans as X


def test_format_of_long_texts(spark):
    long = "wörd " * 60_000
    cases = [
        (f"Answer: {long}[a, b], 12", (True, False, True, True, False)),
        (f"Answer:\n({long}, isa, [x, y] {long})", (True, False, False, False, True)),
        (f"Answer:\n({long}, isa, {long}", (True, False, False, False, False)),
        ("Answer: " + "[a, b] " * 40_000 + ", 3", (True, False, True, True, False)),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: tuple(r.f)[:5] for r in df.select("i", X.format_diagnostics(F.col("t")).alias("f")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    assert df.filter(X.holds_triple(F.col("t"))).select("i").first().i == 1

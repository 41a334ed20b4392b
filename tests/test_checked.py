"""Checked joins, prompts, masks, validations and files with rules."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from graphloom.functions import prompts as P
from graphloom.operators import checked as C
from graphloom.operators import masks as M
from graphloom.operators import validate as V
from graphloom.sources import tables as T
from graphloom.vocab import PROMPTS

KV = StructType([StructField("k", IntegerType()), StructField("v", StringType())])


def frame(spark, rows, schema="k int, v string"):
    return spark.createDataFrame(rows, schema)


def test_joins_stop_with_the_key(spark):
    a, b = frame(spark, [(1, "x"), (2, "y")]), frame(spark, [(1, "p"), (2, "q")], "k int, w string")
    assert sorted(map(tuple, C.exact_cover(a, b, ["k"]).collect())) == [(1, "x", "p"), (2, "y", "q")]
    for left, right, says in ((a, b.filter("k = 1"), 'left side only: {"k":2}'), (a.filter("k = 2"), b, 'right side only: {"k":1}'), (a.union(a), b, "left side has a key twice"), (a, b.union(b), "right side has a key twice")):
        with pytest.raises(Exception, match=says.replace("{", r"\{").replace("}", r"\}")):
            C.exact_cover(left, right, ["k"]).count()  # also where no column is used


def test_lookups_are_strict_or_lenient(spark):
    rows, table = frame(spark, [(1, "a"), (1, "b"), (3, "c")]), frame(spark, [(1, "one"), (2, "two")], "k int, name string")
    assert sorted(r.v for r in C.lookup(rows, table, ["k"], strict=False).collect()) == ["a", "b"]
    with pytest.raises(Exception, match=r'not in the lookup table: \{"k":3\}'):
        C.lookup(rows, table, ["k"]).collect()
    with pytest.raises(Exception, match="not in the lookup table"):
        C.lookup(frame(spark, [(None, "x")]), table, ["k"]).collect()
    with pytest.raises(Exception, match="lookup table has a key twice"):
        C.lookup(rows.filter("k = 1"), table.union(table), ["k"]).collect()
    assert C.lookup(rows.limit(0), table, ["k"]).count() == 0


def test_prompts_round_trip(spark):
    df = frame(spark, [(i, n) for i, n in enumerate(["node", "a {node}", 'say "x" to', "ü", "(a|b)*"])])
    for task in ("neighbor_listing", "node_degree"):
        made = df.withColumn("slot", P.stable_slot(task, F.col("k"))).withColumn("p", P.rendered(task, F.col("slot"), node=F.col("v")))
        for r in made.select("k", "v", "slot", "p", P.inverted(task, F.col("p")).alias("back")).collect():
            assert r.p == PROMPTS[task][r.slot].replace("{node}", r.v) and (r.back.slot, r.back.node) == (r.slot, r.v)
    two = frame(spark, [(0, "x"), (4, "y")]).select("k", P.rendered("shortest_path_listing", F.col("k"), node_a=F.col("v"), node_b=F.lit("z")).alias("p"))
    assert [tuple(r.b) for r in two.select(P.inverted("shortest_path_listing", F.col("p")).alias("b")).collect()] == [(0, "x", "z"), (4, "y", "z")]
    assert frame(spark, [(0, "nothing of the kind")]).select(P.inverted("node_degree", F.col("v")).alias("b")).first().b is None


def test_masks_and_cohorts(spark):
    rows = frame(spark, [("base", 1, False), ("base", 2, True), ("base", 3, None), ("new", 1, True), ("new", 2, False), ("new", 4, False)], "arm string, k int, capped boolean")
    assert sorted(tuple(r)[:2] for r in M.baseline_cohort(rows, ["k"], F.col("arm") == "base", F.col("capped")).collect()) == [("base", 1), ("base", 3), ("new", 1)]
    df = frame(spark, [(0.5, 0.1, False), (0.5, 0.3, False), (None, 0.1, False), (0.5, 0.1, True), (0.5, None, None)], "v double, c double, f boolean")
    got = [tuple(r.m) for r in df.select(M.masked(F.col("v"), F.col("c"), 0.2, F.col("f")).alias("m")).collect()]
    assert got == [(0.5, 0.5, "complete"), (None, 0.5, "illegible"), (None, None, "no_items"), (None, 0.5, "illegible"), (0.5, 0.5, "complete")]
    x = frame(spark, [(1, 5.0, 1.0), (2, 10.0, 9.0), (3, 11.0, None)], "k int, a double, b double")
    ref = frame(spark, [(0, 5.0, 0.0), (0, 10.0, 2.0)], "k int, a double, b double")
    assert sorted((r.k, r.failed) for r in M.outside_ranges(x, ref, ["a", "b"], ["k"]).collect()) == [(2, ["b"]), (3, ["a", "b"])]


def test_validations(spark):
    maps = frame(spark, [(1, {"a": 1, "b": 2}), (1, {"b": 2, "a": 1}), (2, {"a": 1}), (2, {"a": 2})], "k int, m map<string,int>")
    assert [r.k for r in V.inconsistent_maps(maps, ["k"], "m").collect()] == [2]
    grid = frame(spark, [("m", "x"), ("m", "y"), ("n", "x"), ("n", "x")], "a string, b string")
    assert [tuple(r) for r in V.incomplete_products(grid, ["a"], ["b"]).collect()] == [("n", 1, 2)]
    sums = frame(spark, [(1, 1, 2, 3), (2, None, 2, 2), (3, 1, 1, 3), (4, 0, 0, None)], "k int, p int, q int, t int")
    assert sorted(r.k for r in V.unbalanced(sums, ["k"], ["p", "q"], "t").collect()) == [3, 4]
    assert [r.k for r in V.unequal(frame(spark, [(1, "a"), (2, None), (3, None)]).withColumn("w", F.expr("if(k = 3, null, 'a')")), ["k"], F.col("v"), F.col("w")).collect()] == [2]
    node = frame(spark, [(1, 1), (1, 2), (2, 1), (2, 1)], "stmt int, cid int")
    edge = frame(spark, [(1, 1, 0, 2), (2, 1, 0, 1), (2, 1, 0, 3)], "stmt int, src int, rel int, tgt int")
    assert sorted(map(tuple, V.graph_faults(edge, node, (2, 2), (1, 1)).collect())) == [(2, "dangling_edge"), (2, "duplicate_node"), (2, "edges"), (2, "self_loop")]


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_files_with_keys(spark, tmp_path):
    lines(tmp_path / "predictions_m_a.jsonl", [{"k": 1, "v": "a"}, {"k": 2, "v": "a"}])
    lines(tmp_path / "predictions_m_b.jsonl", [{"k": 3, "v": "b"}])
    every = str(tmp_path / "predictions_*.jsonl")
    assert T.read_unique(spark, every, KV, ["k"]).count() == 3
    assert T.read_keyed(spark, every, KV, r"predictions_m_(\w+)\.jsonl", "v").count() == 3
    lines(tmp_path / "predictions_m_b.jsonl", [{"k": 2, "v": "a"}])
    with pytest.raises(Exception, match=r'key twice: \{"k":2\}'):
        T.read_unique(spark, every, KV, ["k"]).collect()
    with pytest.raises(Exception, match="file of another key"):
        T.read_keyed(spark, every, KV, r"predictions_m_(\w+)\.jsonl", "v").collect()


def test_documents_csv_and_matrices(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": {"y": [1,\n 2.5]}}')
    (tmp_path / "b.json").write_text("{broken")
    docs = {r.file[-6:]: r.y for r in T.read_documents(spark, str(tmp_path / "*.json")).select("file", F.expr("try_variant_get(document, '$.x.y[1]', 'double')").alias("y")).collect()}
    assert docs == {"a.json": 2.5, "b.json": None}
    schema = StructType([StructField("name", StringType()), StructField("loss", DoubleType())])
    (tmp_path / "c.csv").write_text('name,loss\n"a, b",0.5\n,\nc,\n')
    assert [tuple(r) for r in T.read_csv(spark, str(tmp_path / "c.csv"), schema).collect()] == [("a, b", 0.5), (None, None), ("c", None)]
    (tmp_path / "d.csv").write_text("name,loss\na,none\n")
    with pytest.raises(Exception, match="MALFORMED|CAST_INVALID|FAILFAST|BAD"):
        T.read_csv(spark, str(tmp_path / "d.csv"), schema).collect()
    m = frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])], "k int, v array<double>")
    assert T.matrix_rows(m, "k", "v", 2).count() == 2
    for bad in ([1.0], [1.0, None], [1.0, float("nan")], None):
        with pytest.raises(Exception, match="matrix's shape"):
            T.matrix_rows(frame(spark, [(9, bad)], "k int, v array<double>"), "k", "v", 2).collect()


def test_ordered_and_exclusive_writes(spark, tmp_path):
    out = str(tmp_path / "out")
    df = frame(spark, [((i * 37) % 200, f"é{i}") for i in range(200)])
    T.write_ordered(df, out, ["k"])
    got = [json.loads(x)["k"] for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text(encoding="utf-8").splitlines()]
    assert got == list(range(200))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        T.write_ordered(df, out, ["k"])
    nested = df.limit(2).select("k", F.struct("v").alias("s"), F.array("v", F.lit('q"')).alias("a"))
    T.write_csv(nested.coalesce(1), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()
    assert {json.loads(r.s)["v"] for r in back} == {r.s.v for r in nested.collect()} and all(json.loads(r.a)[1] == 'q"' for r in back)


def test_hashes_tell_changed_inputs(spark, tmp_path):
    import hashlib

    (tmp_path / "a").write_bytes(b"1")
    (tmp_path / "b").write_bytes(b"2")
    first = spark.createDataFrame(T.file_hashes(spark, str(tmp_path)).collect())
    assert {r.sha256 for r in first.collect()} == {hashlib.sha256(x).hexdigest() for x in (b"1", b"2")}
    (tmp_path / "b").write_bytes(b"3")
    (tmp_path / "c").write_bytes(b"4")
    changed = {r.path[-1]: (r.was is None, r.now is None) for r in V.changed_inputs(T.file_hashes(spark, str(tmp_path)), first).collect()}
    assert changed == {"b": (False, False), "c": (True, False)}

"""Forms of queries that grow with their input, beside the plain ones."""

import random

from pyspark.sql import functions as F

from graphloom.functions import path_scores, spans
from graphloom.functions import statistics as S
from graphloom.operators.similar import near_in_rows, near_matches


def test_near_strings_inside_rows(spark):
    r = random.Random(4)
    rows = []
    for k in range(30):
        words = sorted({"".join(r.choice("abé") for _ in range(r.randrange(9))) for _ in range(40)} | {"x" * (k + 20), "x" * 300 + "a" * (k % 4)})
        rows.append((k, words[::2], words[1::2] + (["x" * (k + 21), "x" * 301] if k % 2 else [])))
    df = spark.createDataFrame(rows, "k int, l array<string>, r array<string>")
    got = near_in_rows(df, "k", "l", "r")
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString() and "Exchange" not in got._jdf.queryExecution().toString()
    want = near_matches(df.select("k", F.explode("l").alias("a")), df.select("k", F.explode("r").alias("b")), ["k"]).collect()
    rows = sorted(map(tuple, got.collect()))
    assert [x[:4] for x in rows] == sorted(map(tuple, want)) and len(want) > 100
    for k, a, _, _, place in rows:
        line = sorted((d, b, p) for j, c, b, d, p in rows if (j, c) == (k, a))
        assert [p for *_, p in line] == list(range(1, len(line) + 1)) and 0 < place <= len(line)


def test_walks_of_a_statement_against_each_other(spark):
    r = random.Random(6)
    rows = [(r.randrange(12), k, [r.randrange(6) for _ in range(r.randrange(5))]) for k in range(80)] + [(99, 1000, [1]), (None, 1001, [1, 2]), (None, 1002, [1, 2])]
    df = spark.createDataFrame(rows, "stmt long, k long, nodes array<int>")
    every = df.groupBy("stmt").agg(F.array_sort(F.collect_list(F.struct("k", "nodes"))).alias("every"))
    gold = F.transform(F.filter("every", lambda s: s["k"] != F.col("k")), lambda s: s["nodes"])
    plain = df.join(every, "stmt").select("k", "nodes", gold.alias("gold"))
    s = path_scores.against_paths(F.col("nodes"), F.col("gold"), F.size(F.get("gold", F.lit(0))) - 1)
    want = {tuple(x) for x in plain.select("k", F.size("nodes"), s.alias("s")).select("k", "size(nodes)", "s.*").collect()}
    ours = {tuple(x) for x in path_scores.score_groups(df).collect()}
    fix = lambda rows: {(k, n, e, bool(h), b, f) for k, n, e, h, b, f in rows}
    assert fix(want) == {x for x in fix(ours) if x[0] < 1001}
    assert {x for x in fix(ours) if x[0] > 1000} == {(1001, 2, False, False, None, 0.0), (1002, 2, False, False, None, 0.0)}


def test_permutations_dealt_over_shards(spark):
    r = random.Random(8)
    rows = [("a", r.gauss(0, 1), i % 3 == 0) for i in range(900)] + [("b", float(r.randrange(3)), i % 2 == 0) for i in range(900)]
    rows += [("c", r.gauss(0.3 * (i % 2), 1), i % 2 == 1) for i in range(400)] + [("d", 1.0 * i, True) for i in range(300)] + [("e", 1.0 * i, i > 4) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, v double, h boolean")
    one = {x.k: (x.n, x.p) for x in S.permutation_p(df, "k", "v", "h", 2000).collect()}
    cut = {x.k: (x.n, x.p) for x in S.permutation_p(df, "k", "v", "h", 2000, shard=100).collect()}
    again = {x.k: (x.n, x.p) for x in S.permutation_p(df.repartition(7), "k", "v", "h", 2000, shard=100).collect()}
    assert cut == again and cut["d"] == one["d"] == (300, None) and cut["e"] == one["e"]
    assert all(cut[k][0] == one[k][0] and abs(cut[k][1] - one[k][1]) < 0.06 for k in "abc")


def test_runs_that_repeat(spark):
    r = random.Random(2)
    for n, want in ((2, False), (3, True)):
        run = " ".join(f"w{i}" for i in range(12))
        text = " ".join(x for _ in range(n) for x in (run, *(f"x{r.randrange(10**9)}" for _ in range(20))))
        assert spark.createDataFrame([(text,)], "t string").select(spans.repeated_runs(F.col("t"))).first()[0] is want


def test_matchings_in_rows_and_by_rounds(spark):
    from graphloom.operators.matching import greatest_matching

    r = random.Random(13)
    edges = {(k, r.randrange(12), r.randrange(12)) for k in range(40) for _ in range(r.randrange(1, 40))}
    df = spark.createDataFrame(sorted(edges), "set int, a int, b int")
    sizes = []
    for limit in (0, 20, 100):
        rows = [tuple(x) for x in greatest_matching(df, limit).collect()]
        assert set(rows) <= edges and len({x[:2] for x in rows}) == len({(k, b) for k, _, b in rows}) == len(rows)
        sizes.append({k: sum(x[0] == k for x in rows) for k in range(40)})
    assert sizes[0] == sizes[1] == sizes[2]


def test_graphs_are_walked_without_rounds_of_joins(spark):
    from graphloom.operators import graph

    edges = spark.createDataFrame([(1, i, 0, i + 1) for i in range(300)] + [(2, 0, 0, 0), (3, 1, 0, 2)], "stmt long, src int, rel int, tgt int")
    sources = spark.createDataFrame([(1, 0), (1, 300), (2, 0), (4, 7)], "stmt long, cid int")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    got = graph.frontier_distance(edges, sources)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before
    want = {(1, i, min(i, 300 - i)) for i in range(301)} | {(2, 0, 0), (4, 7, 0)}
    assert {tuple(x) for x in got.collect()} == want
    assert {tuple(x) for x in graph.frontier_distance(edges, sources, 2).collect()} == {x for x in want if x[2] <= 2}


def test_faults_of_graphs_without_nodes_or_edges(spark):
    from graphloom.operators.validate import graph_faults

    node = spark.createDataFrame([(1, 0), (1, 0), (2, 5)], "stmt long, cid int")
    edge = spark.createDataFrame([(1, 0, 0, 0), (3, 1, 0, 2), (3, None, 0, 2)], "stmt long, src int, rel int, tgt int")
    got = {tuple(x) for x in graph_faults(edge, node, (2, 9), (1, 1)).collect()}
    assert got == {(1, "self_loop"), (1, "duplicate_node"), (2, "nodes"), (3, "edges"), (3, "dangling_edge")}

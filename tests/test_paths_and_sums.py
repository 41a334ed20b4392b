"""Path containment, best right paths, exact sums, nested metrics, matchings, question pairs, numbered lines."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from graphloom.functions import exact_sum, nested, path_scores
from graphloom.operators import matching, question_pair
from graphloom.sources import jsonl
from graphloom.streaming.resume import replay_check


def test_names_in_order(spark):
    def plain(text, paths):
        for path in paths:
            rest = text
            for node in path:
                m = re.search(r"(?<!\w)" + re.escape(node) + r"(?!\w)", rest)
                if not m:
                    break
                rest = rest[m.end() :]
            else:
                return True
        return False

    r = random.Random(1)
    nodes = ["a", "b", "a b", "c.d", "[x]", "é", "ab"]
    rows = [(" ".join(r.choice(nodes) for _ in range(r.randrange(8))), [[r.choice(nodes) for _ in range(r.randrange(1, 4))] for _ in range(r.randrange(3))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "t string, p array<array<string>>")
    assert [r[0] for r in df.select(path_scores.names_a_path(F.col("t"), F.col("p"))).collect()] == [plain(t, p) for t, p in rows]


def test_first_of_the_best_paths(spark):
    rows = [(["a", "b"], [["a", "c"], ["b", "a"], ["a", "b"]], 1), (["x"], [["a"], ["b"]], 0), ([], [["a", "b"]], 1), (["a"], [], 0)]
    got = spark.createDataFrame(rows, "p array<string>, g array<array<string>>, d int").select(path_scores.against_paths(F.col("p"), F.col("g"), F.col("d")).alias("s")).collect()
    assert [(r.s.exact, r.s.hop_correct, r.s.best, r.s.overlap_f1) for r in got] == [(True, True, 1, 1.0), (False, True, 0, 0.0), (False, False, 0, 0.0), (False, True, None, 0.0)]


def test_sums_are_rounded_once_under_any_partitioning(spark):
    r = random.Random(3)
    groups = {
        "cancel": [1e308, 1.0, -1e308, 1e-300, -1.0],
        "tenth": [0.1] * 1000,
        "mixed": [r.uniform(-1, 1) * 10 ** r.randrange(-300, 300) for _ in range(3000)],
        "tiny": [5e-324, 5e-324, 2.0**-1022, -(2.0**-1030)],
        "powers": [2.0**k for k in range(-60, 60)] + [-(2.0**59), 2.0**53 + 2],
        "zero": [0.0, -0.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("inf", math.inf), ("inf", 1.0), ("nan", math.inf), ("nan", -math.inf), ("tenth", None)]
    for parts in (1, 7):
        r.shuffle(rows)
        got = {x.g: x for x in exact_sum.exact_sums(spark.createDataFrame(rows, "g string, v double").repartition(parts), ["g"], "v").collect()}
        for g, vs in groups.items():
            assert got[g].exact_sum == math.fsum(vs) and got[g].n == len(vs)
        assert got["tenth"].exact_mean == 0.1 and got["none"].n == 0 and got["none"].exact_sum is None
        assert got["inf"].exact_sum == math.inf and math.isnan(got["nan"].exact_mean)


def plain_flat(value, at=""):
    out = {}
    for k, v in value.items():
        name = f"{at}.{k}" if at else k
        if isinstance(v, dict):
            out |= plain_flat(v, name)
        elif v is None or isinstance(v, int | float) and not isinstance(v, bool):
            out[name] = v
    return out


def test_nested_metrics_of_any_depth(spark):
    import json

    deep = {"record_count": 9, "mean_absolute_error": 2.5, "parsed_count": 4, "flag": True, "text": "x", "list": [1, {"a": 2}], "none": None, "empty": {}}
    deep["l1"] = {"a": 1, "l2": {"record_count": 3, "l3": {"l4": {"l5": {"deep": 1e300, "micro_recall": 0.5, "gold_node_count": 7}}, "b": False}}}
    docs = [json.dumps(deep), "{}", "[1]", "3", None, "{broken"]
    rows = spark.createDataFrame(list(enumerate(docs)), "i int, t string").select("i", F.try_parse_json("t").alias("v"), F.lit(100).alias("items"))
    got = [r for r in nested.flatten_metrics(rows, ["i"], "v", "items").collect()]
    assert {r.name: r.number for r in got} == plain_flat(deep) and {r.i for r in got} == {0}
    n = {r.name: r.n for r in got}
    assert n["mean_absolute_error"] == 4 and n["parsed_count"] == 9 and n["l1.a"] == 9 and n["l1.l2.l3.l4.l5.deep"] == 3 and n["l1.l2.l3.l4.l5.micro_recall"] == 7


def test_bag_difference(spark):
    a = spark.createDataFrame([("x", 1)] * 3 + [("y", None)], "k string, v int")
    b = spark.createDataFrame([("x", 1)] * 2 + [("y", None), ("z", 2)], "k string, v int")
    assert sorted(map(tuple, nested.bag_difference(a, b, ["k", "v"]).collect())) == [("x", 1, 3, 2), ("z", 2, 0, 1)]


def greatest(edges):
    adj, partner = {}, {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)

    def augment(a, seen):
        for b in adj[a] - seen:
            seen.add(b)
            if b not in partner or augment(partner[b], seen):
                partner[b] = a
                return True
        return False

    return sum(augment(a, set()) for a in adj)


def test_greatest_matchings(spark):
    r = random.Random(3)
    edges = [(k, r.randrange(9), r.randrange(9)) for k in range(12) for _ in range(r.randrange(1, 30))]
    edges += [(50, i, j) for i in range(6) for j in range(2)]  # no more than two partners for six
    got = [tuple(x) for x in matching.greatest_matching(spark.createDataFrame([*edges, (1, None, 2)], "set int, a int, b int")).collect()]
    for k in {k for k, *_ in edges}:
        own, mine = {(a, b) for q, a, b in edges if q == k}, [(a, b) for q, a, b in got if q == k]
        assert set(mine) <= own and len({a for a, _ in mine}) == len({b for _, b in mine}) == len(mine) == greatest(own)
    left = spark.createDataFrame([(50, i) for i in range(6)] + [(51, 0)], "set int, a int")
    sizes = matching.matching_sizes(left, spark.createDataFrame([x for x in got if x[0] == 50], "set int, a int, b int")).collect()
    assert sorted(map(tuple, sizes)) == [(50, 6, 2, False), (51, 1, 0, False)]


def test_question_pair_is_the_first_eligible_one(spark):
    r = random.Random(5)
    labels = {c: r.choice(["stone", "stones", "river", "mountain", "rivers", "cloud", "valley"]) for c in range(14)}
    edges = {(s, r.randrange(14), 0, r.randrange(14)) for s in range(25) for _ in range(r.randrange(1, 16))}
    order = lambda s, c: (c * 7 + s * 5) % 17

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = set()
    for s in range(25):
        near = {}
        for q, a, _, b in edges:
            if q == s:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        line = sorted(near, key=lambda c: (order(s, c), c))
        reach = {}
        for c in near:
            todo, seen = [c], {c}
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            reach[c] = seen
        pair = next(((a, b) for i, a in enumerate(line) for b in line[i + 1 :] if b in reach[a] and b not in near[a] and distance(labels[a], labels[b]) > 2), None)
        if pair:
            want.add((s, *pair))
    e = spark.createDataFrame(sorted(edges), "stmt long, src int, rel int, tgt int")
    named = spark.createDataFrame(sorted(labels.items()), "cid int, label string")
    got = question_pair.question_pair(e, named, (F.col("cid") * 7 + F.col("stmt") * 5) % 17)
    assert {tuple(x) for x in got.collect()} == want and 5 < len(want)


ROW = StructType([StructField("k", IntegerType()), StructField("v", StringType())])


def test_line_numbers_over_splits(spark, tmp_path):
    lines = [f"name {i} é" if i % 7 else "" for i in range(3000)]
    for part in ("a", "b"):
        (tmp_path / f"{part}.txt").write_text("\n".join(lines) + ("\n" if part == "a" else ""), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = jsonl.numbered_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 1
        got = df.collect()
        names = {r.id: r.name for r in jsonl.numbered_names(spark, str(tmp_path / "a.txt")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for part in ("a", "b"):
        own = sorted((r.number, r.line) for r in got if r.file.endswith(f"{part}.txt"))
        assert own == list(enumerate(lines, 1))
    assert [r.file[-5:] for r in got if r.unfinished] == ["b.txt"] and names == dict(enumerate(lines))


def test_only_the_last_line_may_be_unfinished(spark, tmp_path):
    torn, bad, other = tmp_path / "torn.jsonl", tmp_path / "bad.jsonl", tmp_path / "other.jsonl"
    torn.write_text('{"k": 1, "v": "a"}\n\n{"k": 2, "v": "b"}\n{"k": 3, "v": "c"}')
    bad.write_text('{"k": 1, "v": "a"}\n{"k": 2, "v"\n{"k": 3, "v": "c"}\n')
    other.write_text('{"k": 1, "v": "a"}\r\n[4]\n')
    assert sorted(r.k for r in jsonl.read_growing(spark, str(torn), ROW).collect()) == [1, 2]
    with pytest.raises(Exception, match=r"unfinished last line: file:.*torn\.jsonl:4"):
        jsonl.read_growing(spark, str(torn), ROW, growing=False).collect()
    with pytest.raises(Exception, match=r"no object of the schema: file:.*bad\.jsonl:2"):
        jsonl.read_growing(spark, str(bad), ROW).collect()
    assert [(r.number, r.line) for r in jsonl.malformed(spark, str(other), ROW).collect()] == [(2, "[4]")]


def test_replay_check(spark):
    log = [(1, 0, "a"), (1, 1, None), (2, 0, "a"), (3, 0, "a"), (3, 1, "b")]
    again = [(1, 0, "a"), (1, 1, None), (1, 2, "c"), (2, 0, "b"), (3, 0, "a"), (4, 0, "x")]
    make = lambda rows: spark.createDataFrame(rows, "run int, step int, x string")
    got = {r.run: tuple(r)[1:] for r in replay_check(make(log), make(again), "run", ["step"], ["x"]).collect()}
    assert got == {1: (2, 3, None), 2: (1, 1, 1), 3: (2, 1, 2), 4: (0, 1, None)}

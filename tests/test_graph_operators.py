import random

import pytest
from pyspark.sql import functions as F

from graphloom import vocab
from graphloom.operators import graph as G
from graphloom.operators import prune as P
from graphloom.operators.paths import shortest, shortest_paths

REL = {name: i for i, (name, *_) in enumerate(vocab.RELATIONS)}


@pytest.fixture(scope="module")
def make(spark):
    """Edges and nodes of one statement: edges (src, relation, tgt); q and a: question and answer nodes."""

    def build(edges, n, q=(), a=()):
        rows = [(1, s, REL[r], t) for s, r, t in edges]
        random.Random(1).shuffle(rows)
        edge = spark.createDataFrame(rows, "stmt long, src int, rel int, tgt int").repartition(3)
        node = spark.createDataFrame([(1, c, c in q, ["A"] if c in a else []) for c in range(n)], "stmt long, cid int, in_question boolean, in_choices array<string>")
        return edge, node

    return build


def pairs(df):
    return sorted((r.src, r.tgt) for r in df.select("src", "tgt").collect())


def ids(df):
    return {r.cid for r in df.select("cid").collect()}


HUB = [(0, "relatedto", i) for i in range(1, 10)] + [(i, "isa", 10) for i in range(1, 10)]


def test_degrees_count_loops_twice(make):
    edge, _ = make([(0, "isa", 0), (0, "isa", 1), (0, "causes", 1)], 3)
    assert {(r.cid, r.degree) for r in G.edge_degree(edge).collect()} == {(0, 4), (1, 2)}
    assert {(r.cid, r.nbrs) for r in G.neighbor_count(edge).collect()} == {(0, 2), (1, 1)}
    top = G.highest_nodes(G.edge_degree(edge)).collect()
    assert [(r.degree, r.cids) for r in top] == [(4, [0])]


def test_hub_caps(spark, make):
    edge, node = make(HUB, 11, q={0}, a={10})
    rel = vocab.relation_table(spark)
    degree = lambda df, n: sum((r.src == n) + (r.tgt == n) for r in df.collect())
    whole = P.prune(node, edge, rel, max_nodes=0, max_edges=0)
    assert whole["edges"].count() == 18 and degree(whole["edges"], 0) == 9
    assert degree(P.prune(node, edge, rel, max_nodes=0, max_edges=0, max_degree=5)["edges"], 0) == 5
    assert P.prune(node, edge, rel, max_nodes=0, max_edges=3)["edges"].count() == 3
    for cap, fillers in ((6, 4), (5, 3)):
        assert P.prune(node, edge, rel, max_nodes=cap, policy="keep")["info"].collect()[0].bridges_added == fillers


def test_bridge_rules(make):
    edge, node = make([(0, "isa", 1), (0, "isa", 2), (2, "isa", 1), (0, "isa", 3), (4, "isa", 5)], 7, q={0}, a={1})
    for rule, want in (("qa-bridge", {2}), ("core-neighbor", {2, 3}), ("any", {2, 3, 4, 5, 6}), ("none", set())):
        assert ids(P.chosen_fillers(node, edge, rule, 0)) == want


def test_core_retention(spark, make):
    edge, node = make([], 22, q=set(range(20)), a={20, 21})
    assert P.core(node, edge, 0).count() == 22 and P.core(node, edge, 18).count() == 18
    assert P.core(node, edge, 3, "keep").count() == 22
    assert P.chosen_fillers(node, edge, "any", 3, "keep").count() == 0


def test_hard_and_soft_degree_cap(spark, make):
    edge, node = make([(0, "isa", i) for i in range(1, 6)], 6, a=set(range(6)))
    rel = vocab.relation_table(spark)
    soft = P.prune(node, edge, rel, max_nodes=0, max_edges=0, max_degree=2)["edges"]
    hard = P.prune(node, edge, rel, max_nodes=0, max_edges=0, max_degree=2, use_lifelines=False)["edges"]
    assert soft.count() == 5 and hard.count() == 2
    loop, one = make([(0, "isa", 0)], 1, q={0})
    assert P.prune(one, loop, rel, max_nodes=0, max_edges=0, max_degree=1, use_lifelines=False)["edges"].count() == 0


def test_filler_ties(make):
    edge, node = make([(3, "isa", 4), (3, "isa", 5)], 6, q={0})
    assert ids(P.chosen_fillers(node, edge, "any", 3)) == {3, 4}


DIAMOND = [(0, 1), (0, 2), (1, 3), (2, 3), (4, 5)]


def test_shortest_paths_of_the_diamond(spark):
    assert shortest(DIAMOND, 0, 3) == [[0, 1, 3], [0, 2, 3]] and shortest(DIAMOND, 0, 5) == []
    assert shortest(DIAMOND, 0, 3, cap=1) == [[0, 1, 3]]
    edge = spark.createDataFrame([(1, s, 5, t) for s, t in DIAMOND], "stmt long, src int, rel int, tgt int")
    ends = spark.createDataFrame([(1, 0, 3), (1, 0, 5), (2, 0, 1)], "stmt long, source int, target int")
    got = {(r.stmt, r.target): (r.distance, r.n_paths, r.first_path) for r in shortest_paths(edge, ends).collect()}
    assert got == {(1, 3): (2, 2, [0, 1, 3]), (1, 5): (None, 0, None), (2, 1): (None, 0, None)}


def test_frontier_distance(make):
    edge, node = make([(0, "isa", 1), (1, "isa", 2), (3, "isa", 2), (4, "isa", 4)], 5, q={0})
    got = {(r.cid, r.dist) for r in G.frontier_distance(edge, node.filter("in_question")).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_visible_policy(spark, make):
    edge, node = make([(0, "isa", 1)], 4, q={0, 2}, a={1, 3})
    assert ids(P.prune(node, edge, vocab.relation_table(spark), max_nodes=0)["visible"]) == {0, 1, 3}


def test_boxes(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 2.0, 0.0, 2.0), (1, 2, 1.0, 3.0, 1.0, 3.0), (1, 3, 2.0, 4.0, 0.0, 1.0), (2, 4, 0.0, 9.0, 0.0, 9.0)], "graph int, id int, x0 double, x1 double, y0 double, y1 double")
    assert [tuple(r) for r in G.boxes_overlap(boxes).collect()] == [(1, 1, 2)]


def test_prompts_have_five_slots(spark):
    assert all(len(p) == 5 for p in vocab.PROMPTS.values()) and vocab.prompt_table(spark).count() == 45
    assert vocab.relation_table(spark).filter(F.col("priority") == 0).count() == 5


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_near_strings_equal_brute_force(spark):
    import random

    from graphloom.operators.similar import near_matches, near_pairs

    r = random.Random(3)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randrange(9))) for _ in range(150)} | {"x" * 5000, "x" * 4999 + "yz"})
    df = spark.createDataFrame([(w,) for w in [*words, words[0], None]], "w string")
    want = {(a, b, edits(a, b)) for a in words for b in words if a < b and abs(len(a) - len(b)) <= 2 and len(a) < 100 and edits(a, b) <= 2}
    assert {tuple(x) for x in near_pairs(df, "w").collect()} == want | {("x" * 5000, "x" * 4999 + "yz", 2)}
    rows = [(i % 2, w) for i, w in enumerate(words) if len(w) < 100]
    left, right = rows[::3], rows[1::3]
    got = near_matches(spark.createDataFrame(left, "k int, a string"), spark.createDataFrame(right, "k int, b string"), ["k"]).collect()
    assert {tuple(x) for x in got} == {(k, a, b, edits(a, b)) for k, a in left for j, b in right if j == k and edits(a, b) <= 2}
    assert near_pairs(df.limit(0), "w").isEmpty()

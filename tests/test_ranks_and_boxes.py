import random

from pyspark.sql import functions as F

from graphloom.functions import ranks, statistics
from graphloom.operators import graph, paths


def test_numbers_and_bins_over_ranges(spark):
    r = random.Random(1)
    values = [r.randrange(1000) / 4 for _ in range(503)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    got, total = ranks.numbered(df, [F.col("v")])
    assert total == 503 and [x.v for x in sorted(got.collect(), key=lambda x: x.no)] == sorted(values) and sorted(x.no for x in got.collect()) == list(range(1, 504))
    for n in (1, 2, 4, 7):
        sizes = [0] * n
        for row in ranks.equal_bins(df, "v", n).collect():
            sizes[row.bin] += 1
        bounds = [round(503 * b / n) for b in range(n + 1)]
        assert sizes == [b - a for a, b in zip(bounds, bounds[1:])]
    empty, none = ranks.numbered(df.limit(0), [F.col("v")])
    assert none == 0 and empty.count() == 0 and ranks.equal_bins(df.limit(0), "v", 3).count() == 0


def test_halves_go_to_the_even_number():
    assert [ranks.half_even(a, b) for a, b in ((5, 2), (7, 2), (1, 2), (3, 2), (9, 4), (11, 4), (0, 3), (6, 3))] == [round(x) for x in (2.5, 3.5, 0.5, 1.5, 2.25, 2.75, 0, 2)]


def test_boxes_on_a_grid_equal_all_pairs(spark):
    r = random.Random(2)
    boxes = []
    for i in range(150):
        x, y = r.uniform(-50, 50), r.uniform(-50, 50)
        boxes.append((i % 3, i, x, x + r.choice([0.0, 1.0, 5.0, 20.0]), y, y + r.choice([0.0, 2.0, 15.0])))
    boxes += [(0, 200, 0.0, 10.0, 0.0, 10.0), (0, 201, 10.0, 20.0, 0.0, 10.0), (0, 202, 0.0, 10.0, 0.0, 10.0)]  # edges that only touch; equal boxes
    want = {(a[0], a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and b[2] < a[3] and a[4] < b[5] and b[4] < a[5]}
    df = spark.createDataFrame(boxes, "graph int, id int, x0 double, x1 double, y0 double, y1 double")
    got = [tuple(x) for x in graph.boxes_overlap(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert graph.boxes_overlap(df.filter("id = 0")).count() == 0 and graph.boxes_overlap(df.limit(0)).count() == 0


def test_distances_have_no_limit(spark):
    edges = spark.createDataFrame([(1, i, 0, i + 1) for i in range(55)], "stmt long, src int, rel int, tgt int")
    got = {x.cid: x.dist for x in graph.frontier_distance(edges, spark.createDataFrame([(1, 0)], "stmt long, cid int")).collect()}
    assert got == {i: i for i in range(56)}


def test_paths_by_batches(spark):
    edges = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 0, 2), (1, 1, 0, 3), (1, 2, 0, 3), (2, 0, 0, 1)], "stmt long, src int, rel int, tgt int")
    ends = spark.createDataFrame([(1, 0, 3), (2, 0, 5), (3, 1, 2), (1, 1, 1)], "stmt long, source int, target int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in paths.shortest_paths(edges, ends).collect()}
    assert got == {(1, 0, 3): (2, 2, [0, 1, 3], False), (2, 0, 5): (None, 0, None, False), (3, 1, 2): (None, 0, None, False), (1, 1, 1): (0, 1, [1], False)}


def test_partial_rank_correlation(spark):
    rows = [("a", 1.0, 2.0, 3.0), ("a", 2.0, 1.0, 1.0), ("a", 3.0, 4.0, 2.0), ("a", 4.0, 3.0, 4.0), ("b", 1.0, 1.0, 1.0), ("b", 2.0, 2.0, 2.0), ("c", 1.0, 1.0, 2.0), ("c", 1.0, 2.0, 1.0), ("c", 1.0, 3.0, 3.0)]
    got = {x.g: (x.n, x.rho) for x in statistics.partial_spearman(spark.createDataFrame(rows, "g string, x double, y double, z double"), "x", "y", "z", "g").collect()}
    xy, xz, yz = 0.6, 0.4, 0.4
    assert got["b"] == (2, None) and got["c"] == (3, None) and abs(got["a"][1] - (xy - xz * yz) / ((1 - xz * xz) * (1 - yz * yz)) ** 0.5) < 1e-9

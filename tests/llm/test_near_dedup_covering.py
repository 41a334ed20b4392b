"""The pipeline's near-dedup stage gets its pairs by SimHash prints and anchors; sets are only checked after them."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_shingle_dedup import brute_keep, edited

from graphloom.llm import shingle_dedup


def least_similar(r, n, grow):
    """Two sets of n or more shingles whose similarity is 0.8, or as little above it as their sizes allow."""
    base = [r.getrandbits(64) for _ in range(n)]
    if grow:  # one holds the other
        return base, base + [r.getrandbits(64) for _ in range(n // 4)]
    other = n // 9
    return base, base[: n - other] + [r.getrandbits(64) for _ in range(other)]


def prints(sets):
    return np.stack([shingle_dedup.simhash_bits(np.array(sorted(x), np.uint64)) for x in sets])


@pytest.mark.parametrize("classes", [1000, 1 << 22])
def test_pairs_at_the_least_similarity_meet(classes):
    cover, r = shingle_dedup.Covering(classes), random.Random(3)
    for n in (4, 8, 9, 12, 13, 30, 45, 90, 400):
        for grow in (True, False) if n >= 9 else (True,):
            pairs = [least_similar(r, n, grow) for _ in range(150)]
            a, b = (prints(x) for x in zip(*pairs, strict=True))
            parts = cover.all if max(map(len, pairs[0])) <= shingle_dedup.TINY else cover.parts
            assert (cover.homes(a, parts) == cover.homes(b, parts)).any(1).all()
            assert np.bitwise_count(a ^ b).sum(1).max() <= shingle_dedup.RADIUS
            assert np.bitwise_count((a ^ b)[:, : shingle_dedup.SKETCH // 64]).sum(1).max() <= shingle_dedup.SKETCH_RADIUS
    far = prints([[r.getrandbits(64) for _ in range(50)] for _ in range(100)])
    assert min(np.bitwise_count(far[i] ^ far[j]).sum() for i in range(100) for j in range(i)) > shingle_dedup.RADIUS


def test_all_similar_pairs_are_candidates(spark):
    r = random.Random(4)
    sets = []
    for g in range(3):
        pool = [r.getrandbits(64) for _ in range(60 + 100 * g)]
        for _ in range(150):  # over 64 at one anchor
            sets.append(sorted({*(x for x in pool if r.random() < 0.96), *(r.getrandbits(64) for _ in range(r.randrange(9)))}))
    rows = [(i, i % 7 if i < 20 else i, len(x), p.view(np.int64).tolist()) for i, (x, p) in enumerate(zip(sets, prints(sets), strict=True))]
    classes = spark.createDataFrame(rows, "cls long, label long, n long, print array<long>")
    similar = set()
    for a, x in enumerate(sets):
        for b in range(a + 1, len(sets)):
            both = len(set(x) & set(sets[b]))
            if 5 * both >= 4 * (len(x) + len(sets[b]) - both) and rows[a][1] != rows[b][1]:
                similar.add((a, b))
    cover = shingle_dedup.Covering(len(rows))
    got = [tuple(x) for x in shingle_dedup.candidates(classes, cover, chain=False).collect()]
    assert len(similar) > 1000 and similar <= set(got) and len(set(got)) == len(got)
    assert not any(rows[a][1] == rows[b][1] for a, b in got) and all(a // 150 == b // 150 for a, b in got)
    grown = {tuple(x) for x in shingle_dedup.candidates(classes, cover, chain=True).collect()}
    assert grown <= set(got) and len(grown) <= shingle_dedup.GROW * len(rows)
    assert shingle_dedup.candidates(classes.filter(F.lit(False)), cover, chain=False).count() == 0


def test_no_pair_goes_beside_the_prints(spark, make_docs, monkeypatch):
    r = random.Random(6)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(edited(r, base, i % 3))) for i in range(30)]
    docs = make_docs([(d, t, "en", "s") for d, t in rows])
    want = brute_keep(rows)
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(want) and len(want) < 10
    monkeypatch.setattr(shingle_dedup, "RADIUS", -1)
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == len({t for _, t in rows})  # equal sets are one class


def test_rows_of_a_group_nearly_alike_grow_with_it(spark, make_docs, monkeypatch):
    """Pairs below 0.8 but within the radius stay inside their anchor; only rows and forests are written."""
    r, base = random.Random(8), [f"g{i}" for i in range(120)]
    texts = [" ".join(edited(r, base, 2)) for _ in range(320)]
    most, was = [], shingle_dedup.written

    def counted(spark, df):
        out = was(spark, df)
        most[-1] = max(most[-1], out.count())
        return out

    monkeypatch.setattr(shingle_dedup, "written", counted)
    for m in (80, 320):
        most.append(0)
        rows = list(enumerate(texts[:m]))
        got = corpus_pipeline.near_dedup(spark, make_docs([(d, t, "en", "s") for d, t in rows]), "").collect()
        want = brute_keep(rows)
        assert sorted(x.doc_id for x in got) == sorted(want) and 1 < len(want) < m
    assert most[1] <= 6 * most[0] and most[1] <= shingle_dedup.Covering(m).parts * m


def test_links_are_a_forest_of_the_labels(spark):
    r = random.Random(10)
    pool = [r.getrandbits(64) for _ in range(100)]
    sets = [sorted({*(x for x in pool if r.random() < 0.95), r.getrandbits(64)}) for _ in range(120)]
    label = [i if i >= 12 else i % 3 for i in range(120)]
    classes = spark.createDataFrame([(i, label[i], len(x), p.view(np.int64).tolist()) for i, (x, p) in enumerate(zip(sets, prints(sets), strict=True))], "cls long, label long, n long, print array<long>")
    grams = spark.createDataFrame([(i, np.array(x, np.uint64).view(np.int64).tolist()) for i, x in enumerate(sets)], "cls long, grams array<long>")
    at = [(k, i) for k in (3, 4) for i in range(k - 3, 120)]
    asks = spark.createDataFrame(at, "anchor long, cls long")
    sets = [set(x) for x in sets]
    pairs = {(a, b) for a in range(120) for b in range(a) if label[a] != label[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    got = [(max(x), min(x)) for x in shingle_dedup.linked(asks, classes, grams).collect()]

    def groups(links):
        name = list(range(120))
        for a, b in [*((i, j) for i in range(120) for j in range(i) if label[i] == label[j]), *links]:
            name = [name[b] if x == name[a] else x for x in name]
        return [name.index(x) for x in name]

    assert set(got) <= pairs and groups(got) == groups(pairs) and len(set(groups(got))) < 60
    assert len(got) < 2 * len(set(label)) < len(pairs)

"""op11 to op13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from test_shingle_dedup import edited

from graphloom.llm import collocations, jaccard_join, resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- op11 ------------------------------------------------------------------------------


def word_sets(rows):
    out = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute_join(rows):
    """(doc_id, size, component) of each row, by all pairs."""
    sets = word_sets(rows)
    label = list(range(len(sets)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if x and y and 100 * both >= 80 * (len(x) + len(y) - both):
                p, q = sorted((top(a), top(b)))
                label[q] = p
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[top(k)] = min(low.get(top(k), i), i)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(((i, len(s), low.get(top(k)) if s else i) for k, (i, s) in enumerate(sets)), key=key)


def joined(spark, docs):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted((tuple(r) for r in jaccard_join.joined(docs).select("doc_id", "n_shingles", "component_id").collect()), key=key)


def test_join_of_odd_rows_and_empty_tables(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert joined(spark, odd) == brute_join(rows)
    assert joined(spark, empty) == []


def test_join_of_groups_half_alike(spark, make_docs):
    r = random.Random(21)
    rows = []
    for g in range(25):  # copies with few and many edits around the threshold
        base = [f"v{r.randrange(4000)}" for _ in range(r.choice([5, 9, 30, 80, 200]))]
        rows += [(len(rows) + k, " ".join(edited(r, base, min(len(base), k * len(base) // 60)))) for k in range(1 + g % 5)]
    passage = [f"p{i}" for i in range(40)]  # a passage that many share, in texts that are else their own
    rows += [(1000 + i, " ".join([*(f"o{i}x{k}" for k in range(r.randrange(3, 60))), *passage])) for i in range(80)]
    near = [f"n{i}" for i in range(60)]  # a large group of near copies with strays at its edge
    rows += [(2000 + i, " ".join(edited(r, near, r.choice([0, 1, 1, 2, 3])))) for i in range(90)]
    got = joined(spark, make_docs([(i, t, "en", "s") for i, t in rows]))
    want = brute_join(rows)
    assert got == want and len({c for *_, c in want}) < len(rows) - 60


def test_any_order_of_shingles_gives_the_same_links(spark, make_docs, monkeypatch):
    r = random.Random(22)
    base = [f"n{i}" for i in range(70)]
    rows = [(i, " ".join(edited(r, base[: r.choice([50, 60, 70])], r.choice([0, 1, 2, 3])))) for i in range(120)]
    want = brute_join(rows)
    docs = make_docs([(i, t, "en", "s") for i, t in rows])
    for repeats, most in ((8, 1 << 20), (2, 1 << 20), (2, 16), (10**9, 1)):
        monkeypatch.setattr(jaccard_join, "REPEATS", repeats)
        monkeypatch.setattr(jaccard_join, "COMMON", most)
        assert joined(spark, docs) == want


def test_documents_table_joined(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert joined(spark, docs) == brute_join(rows)


def test_similar_sets_share_a_prefix_and_places_bound_the_overlap():
    r = random.Random(23)
    for _ in range(3000):
        pool = [r.getrandbits(60) for _ in range(r.randrange(1, 40))]
        x = {p for p in pool if r.random() < 0.95} or {pool[0]}
        y = {p for p in pool if r.random() < 0.95} or {pool[0]}
        both = len(x & y)
        if 100 * both < 80 * (len(x) + len(y) - both):
            continue
        common = np.array(sorted(r.sample(pool, r.randrange(len(pool)))), np.uint64)
        place = np.array(r.sample(range(len(common)), len(common)), np.int64)
        a, b = (jaccard_join.ordered_prefix(np.array(sorted(s), np.uint64), common, place)[0].tolist() for s in (x, y))
        assert set(a) & set(b)
        first = min(set(a) & set(b), key=a.index)
        assert 1 + min(len(x) - a.index(first) - 1, len(y) - b.index(first) - 1) >= -(-80 * (len(x) + len(y)) // 180)


# --- op12 ------------------------------------------------------------------------------


def brute_collocations(rows, least, top):
    pieces = {}
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            pieces.setdefault("und" if lang is None else lang, []).append(re.findall(r"[^\x20\x09]+", piece))
    out = []
    for lang, runs in pieces.items():
        f = Counter(tuple(w[i : i + m]) for w in runs for m in range(1, 6) for i in range(len(w) - m + 1))
        n = sum(len(w) for w in runs)
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + m] for p in cand for m in range(2, len(p)) for i in range(len(p) - m + 1) if cand[p] >= f[p[i : i + m]]}
        scored = []
        for p, a in cand.items():
            if p not in inside:
                score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def test_collocations_equal_brute_force(spark, make_docs, monkeypatch):
    r = random.Random(31)
    words = ["a", "B", "c", "dé", "e'", "f", " g", "x1", "zz", "中"]
    rows = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for _ in range(r.randrange(200)))) for _ in range(60)]
    rows += [("en", "the same words all over again " * 40)] * 3 + [("en", None), (None, ""), ("de", " .,\n")]
    docs = make_docs([(i, t, g, "s") for i, (g, t) in enumerate(rows)])
    for shard in (1 << 20, 50):  # words in one bucket, and cut into shards
        monkeypatch.setattr(collocations, "SHARD", shard)
        for least, top in ((3, 2000), (10, 5)):
            got = sorted(tuple(x) for x in collocations.collocations(docs, least, top).collect())
            assert got == brute_collocations(rows, least, top)


def test_collocations_of_odd_rows_and_empty_tables(spark, odd, empty):
    rows = [(x.lang, x.text) for x in odd.collect()]
    assert sorted(tuple(x) for x in collocations.collocations(odd, 2).collect()) == brute_collocations(rows, 2, 2000)
    assert collocations.collocations(empty).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    df = spark.createDataFrame([(big, 10**15 + 7, big + 1, big + 5)], "a long, n long, l long, r long")
    assert df.selectExpr(f"{collocations.SCORE} AS s").first().s == 1000 * big * (10**15 + 7) // ((big + 1) * (big + 5))


# --- op13 ------------------------------------------------------------------------------


def brute_resampling(docs, target, buckets=10000, percent=25, least=20, seed=7):
    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(f.encode()) % buckets for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    own = [(i, *feats(t)) for i, t in docs]
    s, t = Counter(b for *_, f in own for b in f), Counter(b for x in target for b in feats(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    line = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = [(line[k][0], *line[k][2:], k + 1 if k < percent * len(line) // 100 else None) for k in range(len(line))]
    return sorted(ranks + [(r[0], *r[2:], None) for r in rows if r[1] < least], key=str)


def drawn(spark, docs, target, **kw):
    return sorted((tuple(r) for r in resampling.resampled(docs, target, **kw).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling_equals_brute_force(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "benchmark"))
    want = brute_resampling([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    assert drawn(spark, docs, bench) == want and any(r[-1] for r in want)


def test_resampling_of_odd_rows_and_empty_tables(spark, odd, empty, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for percent, least in ((25, 20), (60, 1), (100, 0), (0, 1)):
        assert drawn(spark, odd, odd.limit(3), percent=percent, min_words=least) == brute_resampling(rows, [t for _, t in rows[:3]], percent=percent, least=least)
    assert drawn(spark, odd, empty) == brute_resampling(rows, [])
    assert drawn(spark, empty, odd) == []
    monkeypatch.setattr(resampling, "SLICE", 7)
    assert drawn(spark, odd, odd, min_words=1) == brute_resampling(rows, [t for _, t in rows], least=1)


def test_ties_go_to_smaller_ids(spark, make_docs):
    rows = [(i % 7 if i % 3 else None, "some words of a text " * 6) for i in range(40)]
    docs = make_docs([(i, t, "en", "s") for i, t in rows])
    got, want = drawn(spark, docs, docs, percent=50), brute_resampling(rows, [t for _, t in rows], percent=50)
    assert Counter(got) == Counter(want)


def test_slices_give_the_same_features(monkeypatch):
    text = "Ab c1 é  ,, d-e\x00f " * 50 + "x" * 500
    whole = [(n, b.tolist()) for n, b in resampling.feature_buckets(text)]
    monkeypatch.setattr(resampling, "SLICE", 3)
    cut = list(resampling.feature_buckets(text))
    assert sum(n for n, _ in cut) == whole[0][0] and Counter(x for _, b in cut for x in b.tolist()) == Counter(whole[0][1])

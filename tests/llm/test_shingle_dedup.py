import random

import corpus_pipeline
import numpy as np
from test_search_pack_hash import brute_fp

from graphloom.llm import shingle_dedup


def grams(text):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_keep(rows):
    """Smallest doc_id of each component of pairs with similarity of 0.8 or more, by all pairs."""
    sets = {d: grams(t) for d, t in rows}
    ids, parent = sorted(sets), {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d for d in ids if top(d) == d}


def edited(r, words, n):
    words = list(words)
    for at in r.sample(range(len(words)), n):
        words[at] = f"w{r.randrange(10**9)}"
    return words


def test_near_copies_of_similarity_08_go(spark, sf, make_docs):
    r = random.Random(5)
    rows, bits = [], []
    for g in range(40):
        base = [f"v{r.randrange(5000)}" for _ in range(r.choice([60, 150, 400]))]
        for copy in range(1 + g % 4):
            rows.append((len(rows), " ".join(edited(r, base, copy * len(base) // 80))))
            bits.append((brute_fp(" ".join(base)) ^ brute_fp(rows[-1][1])).bit_count())
    base = [f"u{r.randrange(5000)}" for _ in range(200)]  # a large group, whose members are often less than 0.8 alike
    rows += [(len(rows) + i, " ".join(edited(r, base, 3))) for i in range(120)]
    rows += [(10**6, "A few words"), (10**6 + 1, "a  few words"), (10**6 + 2, "a few Words more"), (10**6 + 3, ""), (10**6 + 4, None)]
    want = brute_keep(rows)
    got = corpus_pipeline.near_dedup(spark, make_docs([(d, t, "en", "s") for d, t in rows]), sf).collect()
    assert sorted(x.doc_id for x in got) == sorted(want)
    assert sum(b > 4 for b in bits) > 10  # op3's radius would keep these


def test_stage_on_the_documents_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    out = corpus_pipeline.near_dedup(spark, docs, sf)
    assert out.columns == docs.columns and sorted(x.doc_id for x in out.collect()) == sorted(brute_keep(rows))


def test_a_large_bucket_of_texts_half_alike(spark, sf, make_docs):
    r = random.Random(9)
    base = [f"s{i}" for i in range(9)]
    rows = [(i, " ".join([f"a{i}", f"b{i}", *base])) for i in range(150)]  # 5 shingles of 7 shared: all apart
    long = [f"t{i}" for i in range(40)]
    rows += [(1000 + i, " ".join(edited(r, long, 2))) for i in range(150)]  # some linked, some not
    got = corpus_pipeline.near_dedup(spark, make_docs([(d, t, "en", "s") for d, t in rows]), sf).collect()
    assert sorted(x.doc_id for x in got) == sorted(brute_keep(rows)) and len(got) > 150


def test_large_buckets_of_long_sets(spark, sf, make_docs):
    r = random.Random(11)
    base = [f"m{i}" for i in range(230)]
    rows = []
    for i in range(200):  # 100 to 230 words, alike up to edits
        rows.append((i, " ".join(edited(r, base[: r.choice([100, 128, 137, 150, 168, 171, 185, 230])], r.randrange(7)))))
    sizes = [len(grams(t)) for _, t in rows]
    assert min(sizes) < 132 and max(sizes) > 165
    got = corpus_pipeline.near_dedup(spark, make_docs([(d, t, "en", "s") for d, t in rows]), sf).collect()
    want = brute_keep(rows)
    assert sorted(x.doc_id for x in got) == sorted(want) and 1 < len(want) < 200


def test_fine_bands_find_every_similar_pair():
    r = random.Random(12)
    sets = []
    for g in range(6):
        pool = [r.getrandbits(40) for _ in range(12 + 25 * g)]
        for _ in range(30):
            keep = [x for x in pool if r.random() < 0.93]
            sets.append(sorted({*keep, *(r.getrandbits(40) for _ in range(r.randrange(1 + len(pool) // 8)))}))
    at = {}
    for i, x in enumerate(sets):
        for bucket in shingle_dedup.bands(np.array(x, np.uint64), shingle_dedup.FINE):
            at.setdefault(bucket, set()).add(i)
    found = {(a, b) for c in at.values() for a in c for b in c if a < b}
    similar = set()
    for a, x in enumerate(sets):
        for b in range(a + 1, len(sets)):
            both = len(set(x) & set(sets[b]))
            if 5 * both >= 4 * (len(x) + len(sets[b]) - both):
                similar.add((a, b))
    assert similar and similar <= found

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import maxscore, packing, simhash, url_filter


# --- exact top-k -------------------------------------------------------------------
def brute_topk(rows, is_query, k):
    ok = {i: [int(np.floor(1024 * float(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in filter(is_query, ok):
        score = lambda c: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ok[q], ok[c]))))  # noqa: B023, E731
        best = sorted(((-score(c), c) for c in ok if c != q))[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [7, 10_000])
def test_topk_equals_brute_force(spark, shard_rows):
    g = random.Random(5)
    rows = [(i, [round(g.gauss(0, 0.2), 2) for _ in range(12)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(15)]  # ties
    rows += [(300, None), (301, [None] + [0.1] * 11), (302, [float("nan")] * 12), (303, [float("inf")] * 12), (None, [0.1] * 12), (0, rows[0][1]), (304, []), (310, [1e30] * 12)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int")
    got = maxscore.top_k(df, F.col("vec_id") % 10 == 0, 10, shard_rows=shard_rows, query_block=4)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, lambda i: i % 10 == 0, 10)


def test_topk_small_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert maxscore.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1)], schema)
    assert [tuple(r) for r in maxscore.top_k(two, F.col("vec_id") % 10 == 0).collect()] == [(0, 1, 1, 1024 * 2048)]


#: Texts with the vocabulary's added token, whole, cut, doubled and beside spaces.
MARKED = ["<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> x", "<|endoftext|><|endoftext|>", "<|endoftext|", "|endoftext|>", "<<|endoftext|>>", "don't<|endoftext|>'s", "<|ENDOFTEXT|>", "中<|endoftext|>\n\n", "<|pad|> <|endoftext|> é"]


# --- packing -----------------------------------------------------------------------
def check_packing(docs, got, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_path())
    want = defaultdict(int)
    for d in docs.select("doc_id", "text").collect():
        ids = t.encode(d.text or "", add_special_tokens=False).ids + [0]
        head = len(ids) % capacity or capacity
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(d.doc_id, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    have, sequences = defaultdict(int), defaultdict(list)
    for r in got:
        have[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= capacity
    return len(sequences)


def test_packing_round_trip(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack(docs, packing.default_path()).collect()
    tokens = sum(r.length for r in got)
    assert check_packing(docs, got, 2048) <= -(-tokens // 2048) + 1
    check_packing(odd, packing.pack(odd, packing.default_path(), 64).collect(), 64)
    marked = spark.createDataFrame([(i, t) for i, t in enumerate(MARKED)], "doc_id long, text string")
    check_packing(marked, packing.pack(marked, packing.default_path(), 8).collect(), 8)
    assert packing.pack(empty, packing.default_path()).count() == 0


def test_plan_uses_the_histogram_exactly():
    g = random.Random(1)
    for capacity in (8, 64, 500):
        for _ in range(5):
            counts = {g.randint(1, capacity): g.randint(1, 40) for _ in range(g.randint(1, 60))}
            used = defaultdict(int)
            for pattern, n in packing.plan(counts, capacity):
                assert sum(pattern) <= capacity and n > 0
                for x in pattern:
                    used[x] += n
            assert used == counts


# --- near-duplicates ---------------------------------------------------------------
def brute_fp(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """(doc_id, fingerprint, component) by comparing all fingerprints."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[root(b)] = root(a)
    low = defaultdict(list)
    for d, f in rows:
        if d is not None:
            low[root(f)].append(d)
    return sorted(((d, f"{f:016x}", min(low[root(f)], default=None)) for d, f in rows), key=str)


def result(prints):
    out = simhash.near_duplicates(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    return sorted(map(tuple, out.collect()), key=str)


def test_fingerprints_and_components_on_documents(spark, sf, odd, empty):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        rows = [(d.doc_id, brute_fp(d.text)) for d in docs.select("doc_id", "text").collect()]
        assert result(simhash.fingerprints(docs).cache()) == brute_components(rows)
    assert simhash.near_duplicates(simhash.fingerprints(empty)).count() == 0


@pytest.mark.parametrize("parts", [simhash.PARTS_FEW, simhash.PARTS_MANY])
def test_no_link_is_lost(spark, parts):
    g = random.Random(2)
    fps = []
    for _ in range(40):
        base = g.getrandbits(64)
        for flips in range(8):
            fps.append(base ^ sum(1 << b for b in g.sample(range(64), flips)))
    hub = g.getrandbits(64)
    fps += [hub ^ sum(1 << b for b in g.sample(range(64), 2)) for _ in range(150)]
    rows = [(i, f) for i, f in enumerate(fps)]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "doc_id long, fp long").cache()
    out = simhash.near_duplicates(df, parts=parts).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert sorted(map(tuple, out.collect()), key=str) == brute_components(rows)


def test_nearest_is_a_perfect_code():
    words = np.arange(1 << 15)
    code = simhash.nearest(words)
    assert len(np.unique(code)) == 1 << 11 and np.bitwise_count(words ^ code).max() == 1


# --- url filters -------------------------------------------------------------------
URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/en/1", "http://Example.com/en/7x?q", "http://example.com/en/8", "x://a.example.com#/en/7",
    "http://notexample.com/en/7", "http://net/de/", "http://a.net/de", "http://a.b.example.net/de/8/1#z", "http://ÄB.org/es/?x", "http://a.org//es/", "http://a://b.org/es/", "http://.com/en/",
    "http://" + "a." * 3000 + "com/en/" + "y" * 5000,
]


def brute_url(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


@pytest.mark.parametrize("limit", [0, 1000])
def test_url_rules(spark, limit):
    rules = [*url_filter.RULES, ("allow", "org", ""), ("block", "com", "/en/7")]
    pages = spark.createDataFrame([(None if i == 3 else i % 9, u, "h", "r", "v") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string, verdict string")
    got = url_filter.filter_urls(pages, spark.createDataFrame(rules, "action string, host string, path string"), broadcast_rules=limit)
    want = sorted(((None if i == 3 else i % 9, *brute_url(u, rules)) for i, u in enumerate(URLS * 2)), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_url_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "action string, host string, path string")
    some = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.filter_urls(pages, spark.createDataFrame(url_filter.RULES, none.schema)).count() == 0
    assert url_filter.filter_urls(some, none).collect()[0].verdict == "allow"

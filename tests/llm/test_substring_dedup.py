import hashlib
import random

import numpy as np
import pytest

from graphloom.llm import substring_dedup as S


def brute(rows):
    """rows: (order key, doc_id, text) of different documents -> (doc_id, bytes, removed, spans, digest)."""
    seen, out = set(), []
    for _, doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, S.dedup(df).collect()), key=str)


def texts(seed, n=60):
    g = random.Random(seed)
    vocab = ["".join(g.choice("abcdeé") for _ in range(g.randint(1, 7))) for _ in range(300)]
    prose = lambda k: " ".join(g.choice(vocab) for _ in range(k))
    passages = [prose(g.randint(15, 60)) for _ in range(8)]
    out = []
    for _ in range(n):
        kind = g.random()
        if kind < 0.3:
            t = prose(g.randint(1, 150))
        elif kind < 0.6:
            t = prose(g.randint(0, 30)) + g.choice(passages) + prose(g.randint(0, 30)) + g.choice(passages)
        elif kind < 0.8 and out:
            w = g.choice(out).split(" ")
            for _ in range(g.randint(0, 3)):
                w[g.randrange(len(w))] = "X"
            t = " ".join(w)
        elif kind < 0.9:
            t = g.choice(["ab", "x", "the end. "]) * g.randint(1, 400)
        else:
            t = g.choice(out) if out else ""
        out.append(t)
    return out


@pytest.mark.parametrize("seed,chunk,hot", [(1, 1 << 20, 4096), (2, 700, 4096), (3, 1500, 1)])
def test_dedup_equals_brute_force(spark, make_docs, monkeypatch, seed, chunk, hot):
    rows = [(i * 3, t, "en", "s") for i, t in enumerate(texts(seed))]
    random.Random(seed).shuffle(rows)
    want = brute([(i, i, t) for i, t, *_ in rows])
    if (chunk, hot) == (1 << 20, 4096):
        assert got(make_docs(rows)) == want
        return
    # Smaller chunks and hot anchors in this process, without Spark between the steps.
    monkeypatch.setattr(S, "CHUNK", chunk)
    monkeypatch.setattr(S, "HOT", hot)
    import pyarrow as pa

    by_id = {i: t for i, t, *_ in rows}
    first = pa.Table.from_batches(S._blocks([pa.RecordBatch.from_pydict({"did": list(by_id), "text": list(by_id.values())})]))
    met = pa.Table.from_batches(S._meet(first.sort_by([(c, "ascending") for c in ("anchor", "finger", "did", "place")]).to_batches(50)))
    met = met.to_pylist()
    found = {}
    for r in met:
        if r["kind"]:
            found.setdefault(r["did"], []).append(r)
    assert not hot == 1 or any(r["kind"] == 2 for r in met)
    shards = pa.Table.from_batches(S._with_bytes([pa.RecordBatch.from_pydict({"text": [by_id[d] for d in found], "found": list(found.values())})]))
    compared = pa.Table.from_batches(S._sorted(shards.sort_by([(c, "ascending") for c in ("shard", "did", "p")]).to_batches(17))).to_pylist()
    ranges = {}
    for r in compared + [{"did": r["did"], "start": r["anchor"], "end": r["place"]} for r in met if not r["kind"]]:
        ranges.setdefault(r["did"], []).append({"start": r["start"], "end": r["end"]})
    out = pa.Table.from_batches(S._finish([pa.RecordBatch.from_pydict({"doc_id": list(by_id), "text": list(by_id.values()), "ranges": [ranges.get(d) for d in by_id]})]))
    assert sorted((tuple(r.values()) for r in out.to_pylist()), key=str) == want


def test_dedup_of_odd_rows(spark, odd, empty):
    from pyspark.sql import functions as F

    from graphloom.llm.common import text_hash

    rows = [(r.doc_id is None, r.doc_id or 0, r.h, r.doc_id, r.text) for r in odd.select("doc_id", "text", text_hash().alias("h")).collect()]
    one = {r[:3]: r for r in rows}
    want = {r[0]: None for r in rows}
    seen, by_key = [], {}
    for k, r in sorted(one.items()):
        seen.append((k, k, r[4]))
    for k, *rest in brute(seen):
        by_key[k] = rest
    assert got(odd) == sorted(((r[3], *by_key[r[:3]]) for r in rows), key=str)
    assert got(empty) == [] and want is not None


def test_suffix_sort_is_stable_and_sorted():
    g = np.random.default_rng(4)
    data = np.concatenate([g.integers(97, 99, 3000).astype(np.uint8), np.zeros(8, np.uint8)])
    items = g.integers(0, 2800, 700)
    segment = np.sort(g.integers(0, 9, 700))
    order = S.Suffixes(data).sort(items, segment)
    text = data.tobytes()
    want = sorted(range(700), key=lambda i: (segment[i], text[items[i] : items[i] + 100], i))
    assert order.tolist() == want

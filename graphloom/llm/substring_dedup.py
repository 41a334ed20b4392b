"""Suffix-array dedup: removes bytes covered by a string of LENGTH bytes that also starts earlier.

Windows (strings of LENGTH bytes) are routed by an anchor: the K-gram inside the window
with the least hash, leftmost of equals.  Equal windows have equal anchors at equal
places, so they meet.  One anchor serves a run of neighbouring windows, its block.

1. Each document gives one row per block: hash of the anchor, fingerprint of the block.
   Equal blocks of one chunk of input are settled at once; only the earliest goes on.
2. Rows meet by anchor.  Blocks with equal anchor hash and fingerprint (128 bits, from
   two independent polynomials) are equal: all but the earliest are removed whole.
   Where blocks of one anchor differ, the first of each kind goes on with its bytes.
3. In each anchor's shard the suffixes that start a window are sorted by mergesort;
   a comparison finds the common extension of two suffixes by binary search over
   prefix polynomial hashes.  Equal neighbours are verified byte by byte; all but the
   earliest of a class of equal windows are removed.
4. Removed ranges go back to their documents and are united there.

Earlier means smaller doc_id, or earlier in one document.

Cases: a null text is empty; texts under LENGTH bytes keep all.  Matches never cross
documents.  Null doc_ids come last; rows with one doc_id and different texts follow one
another by a hash of the text; rows equal in both are one document and are cut alike.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table, text_hash, written

LENGTH, K = 100, 32
SPAN = LENGTH - K + 1
CHUNK = 1 << 20
#: An anchor with more kinds of blocks is split by what follows and what precedes it.
HOT = 4096
SIDE = (LENGTH - K) // 2
LOW32 = np.uint64(0xFFFFFFFF)


class Polynomial:
    """Prefix hashes modulo 2**64 over bytes replaced by random numbers."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.of_byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(2**58, 2**60)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def reserve(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * CHUNK)
            powers = lambda b: np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, np.uint64(b), np.uint64)))
            self.up, self.down = powers(self.base), powers(self.inverse)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        self.reserve(len(data) + 1)
        return np.append(np.uint64(0), np.cumsum(self.of_byte[data] * self.up[: len(data)], dtype=np.uint64))

    def of(self, prefix: np.ndarray, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Hashes of the n bytes from each place."""
        return (prefix[at + n] - prefix[at]) * self.down[at]


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_polys: list[Polynomial] = []


def polynomials() -> list[Polynomial]:
    if not _polys:
        _polys.extend([Polynomial(101), Polynomial(202)])
    return _polys


def blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document number, anchor place, first window, last window, anchor hash, fingerprint) of documents laid end to end."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if len(data) < LENGTH:
        return none
    one, two = polynomials()
    s1, s2 = one.prefixes(data), two.prefixes(data)
    places = np.arange(len(data) - K + 1)
    gram = mix64(one.of(s1, places, K))
    least = (gram & ~LOW32) | places.astype(np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    # Windows lie inside one document.
    edge = np.zeros(len(data) + 1, np.int64)
    long_ = ends - starts >= LENGTH
    np.add.at(edge, starts[long_], 1)
    np.add.at(edge, ends[long_] - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(edge[:-1])[: len(least)])
    if not len(window):
        return none
    anchor = (least[window] & LOW32).astype(np.int64)
    head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)))
    tail = np.append(head[1:], len(window)) - 1
    p, first, last = anchor[head], window[head], window[tail]
    finger = mix64(two.of(s2, first, last + LENGTH - first) + (p - first).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + (last - first).astype(np.uint64) * np.uint64(0x5851F42D4C957F2D))
    return np.searchsorted(starts, first, "right") - 1, p, first, last, gram[p], finger


def unite(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of each document, united where they overlap or touch."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    number = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(number * step + end)
    head = np.append(True, number[1:] * step + start[1:] > reach[:-1])
    head[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[last] - number[last] * step


#: Rows of step 1.  A range that is removed already has place -1 - start and its end as fingerprint.
ROWS = "anchor long, finger long, did long, place long"


def _settle(did: np.ndarray, p: np.ndarray, hi: np.ndarray, lo: np.ndarray, anchor: np.ndarray, finger: np.ndarray) -> pa.RecordBatch:
    """Rows of one chunk; of equal blocks the earliest stays, the others become removed ranges."""
    order = np.lexsort((p, did, finger, anchor))
    did, p, hi, lo, anchor, finger = (x[order] for x in (did, p, hi, lo, anchor, finger))
    head = np.append(True, (anchor[1:] != anchor[:-1]) | (finger[1:] != finger[:-1]))[: len(p)]
    first = np.maximum.accumulate(np.where(head, np.arange(len(p)), 0))
    gone = ~head & ((did != did[first]) | (p != p[first]))
    d, s, e = unite(did[gone], (p - hi)[gone], (p - lo + LENGTH)[gone])
    spread = mix64(d.astype(np.uint64) * np.uint64(31) + s.astype(np.uint64))
    cols = [np.append(anchor[head], spread).view(np.int64), np.append(finger[head].view(np.int64), e), np.append(did[head], d), np.append((p << 16 | hi << 8 | lo)[head], -1 - s)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "finger", "did", "place"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(held: list) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(t for _, t, _ in held), np.uint8)
        ends = np.cumsum([len(t) for _, t, _ in held])
        starts = ends - np.array([len(t) for _, t, _ in held])
        number, p, first, last, anchor, finger = blocks(data, starts, ends)
        ids, skipped = np.array([d for d, _, _ in held], np.int64), np.array([s for _, _, s in held], np.int64)
        return _settle(ids[number], p - starts[number] + skipped[number], p - first, p - last, anchor, finger)

    held: list[tuple[int, bytes, int]] = []
    size = 0
    for b in batches:
        for did, text in zip(b["did"].to_pylist(), b["text"], strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            # A long document goes in parts whose windows follow one another.
            for at in range(0, max(len(raw) - LENGTH + 1, 0), CHUNK):
                part = raw[at : at + CHUNK + LENGTH - 1]
                held.append((did, part, at))
                size += len(part)
                if size >= CHUNK:
                    yield flush(held)
                    held, size = [], 0
    if held:
        yield flush(held)


#: Step 2 gives removed ranges (kind 0: anchor is the start, place the end) and blocks to compare (kind 1, or 2 for a hot anchor).
MET = "kind int, anchor long, did long, place long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solve(anchor: np.ndarray, finger: np.ndarray, did: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        known = place < 0
        k_did, k_start, k_end = did[known], -1 - place[known], finger[known]
        anchor, finger, did, place = (x[~known] for x in (anchor, finger, did, place))
        n = len(anchor)
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (finger[1:] != finger[:-1]))[:n]
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, int)
        gone = ~new & ((did != did[first]) | (place != place[first]))
        group = np.cumsum(np.append(True, anchor[1:] != anchor[:-1])[:n]) - 1
        kinds = np.bincount(group[new], minlength=1) if n else np.zeros(1, int)
        go = new & (kinds[group] > 1)
        p, hi, lo = place >> 16, place >> 8 & 255, place & 255
        d, s, e = unite(np.append(k_did, did[gone]), np.append(k_start, (p - hi)[gone]), np.append(k_end, (p - lo + LENGTH)[gone]))
        kind = np.append(np.zeros(len(d), np.int32), np.where(kinds[group[go]] > HOT, 2, 1).astype(np.int32))
        cols = [kind, np.append(s, anchor[go]), np.append(d, did[go]), np.append(e, place[go])]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if i == 0 else np.int64)) for i, c in enumerate(cols)], names=["kind", "anchor", "did", "place"])

    yield from _by_group(batches, ["anchor", "finger", "did", "place"], lambda *x: [solve(*x)], 200_000)


def _by_group(batches: Iterator[pa.RecordBatch], names: list[str], solve, least: int) -> Iterator[pa.RecordBatch]:
    """Calls solve on columns sorted by the first, on some thousand rows at a time, with each group whole."""
    held: list[list] = []
    rows = 0

    def columns() -> list:
        return [np.concatenate(c) if isinstance(c[0], np.ndarray) else sum(c, []) for c in map(list, zip(*held, strict=True))]

    for b in batches:
        held.append([b[n].to_pylist() if pa.types.is_binary(b[n].type) or pa.types.is_large_binary(b[n].type) else b[n].to_numpy(zero_copy_only=False) for n in names])
        rows += b.num_rows
        if rows < least or not b.num_rows:
            continue
        cols = columns()
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            yield from solve(*(c[:cut] for c in cols))
        held, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
    if held:
        yield from solve(*columns())


#: Step 3: a block with its bytes; offsets of its windows before the anchor run from lo to hi.
BYTES = "shard long, did long, p long, hi int, lo int, bytes binary"


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one, _ = polynomials()

    def side_hash(raw: bytes, salt: int) -> int:
        data = np.frombuffer(raw, np.uint8)
        return int(mix64(one.of(one.prefixes(data), np.zeros(1, np.int64), len(data)) + np.uint64(salt))[0])

    for b in batches:
        rows: list[tuple] = []
        for text, found in zip(b["text"], b["found"].to_pylist(), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for f in found:
                p, hi, lo = f["place"] >> 16, f["place"] >> 8 & 255, f["place"] & 255
                if f["kind"] == 1:
                    shards = [(f["anchor"], hi, lo)]
                else:
                    # Windows of a hot anchor reach SIDE bytes past it on the right, or on the left.
                    shards = []
                    if lo <= SIDE:
                        shards.append((f["anchor"] ^ np.array([side_hash(raw[p + K : p + K + SIDE], 1)], np.uint64).view(np.int64)[0].item(), min(hi, SIDE), lo))
                    if hi > SIDE:
                        shards.append((f["anchor"] ^ np.array([side_hash(raw[p - SIDE : p], 2)], np.uint64).view(np.int64)[0].item(), hi, max(lo, SIDE + 1)))
                rows += [(shard, f["did"], p, h, o, raw[p - h : p - o + LENGTH]) for shard, h, o in shards]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "did", "p", "hi", "lo", "bytes"])


class Suffixes:
    """Suffixes of a buffer, compared over their first LENGTH bytes."""

    def __init__(self, data: np.ndarray) -> None:
        self.poly, self.data = polynomials()[0], data
        self.prefix = self.poly.prefixes(data)
        self.words = np.ndarray((max(len(data) - 7, 0),), "<u8", data.tobytes(), strides=(1,))

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, by binary search over prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), LENGTH)
        for _ in range(LENGTH.bit_length()):
            mid = (low + high + 1) // 2
            same = self.poly.of(self.prefix, x, mid) == self.poly.of(self.prefix, y, mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.minimum(mid - 1, high))
            high = np.maximum(high, low)
        return low

    def before(self, x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before y; equal ones by ties."""
        n = self.common(x, y)
        end = n >= LENGTH
        at = np.where(end, 0, n)
        return np.where(end, ties, self.data[x + at] < self.data[y + at])

    def equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Byte by byte: verifies what the hashes say."""
        same = np.ones(len(x), bool)
        for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
            same &= self.words[x + k] == self.words[y + k]
        return same

    def sort(self, items: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Stable mergesort of the items (places) inside each segment, all segments at once."""
        items = items.copy()
        head = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(items) else np.zeros(0, int)
        sizes = np.diff(np.append(head, len(items)))
        start, size = np.repeat(head, sizes), np.repeat(sizes, sizes)
        here = np.arange(len(items)) - start
        order = np.arange(len(items))
        width = 1
        while len(sizes) and width < sizes.max():
            live = np.flatnonzero(size > width)
            run = here[live] // width
            right = run % 2 == 1
            other = np.where(right, run - 1, run + 1) * width  # where the run to merge with begins
            o_size = np.clip(size[live] - other, 0, width)
            mine = items[order[live]]
            low, high = np.zeros(len(live), np.int64), o_size.copy()
            while True:  # binary search for the place among the other run
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                them = items[order[(start[live] + other)[open_] + mid]]
                # Elements of the left run go first among equals.
                earlier = self.before(them, mine[open_], right[open_])
                low[open_] = np.where(earlier, mid + 1, low[open_])
                high[open_] = np.where(earlier, high[open_], mid)
            base = start[live] + run // 2 * 2 * width
            target = base + (here[live] - run * width) + low
            moved = order.copy()
            moved[target] = order[live]
            order = moved
            width *= 2
        return order


def repeated(shard: np.ndarray, did: np.ndarray, p: np.ndarray, hi: np.ndarray, lo: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """(did, start, end) of windows that an earlier block of the shard has too; rows are sorted by shard, did, p."""
    data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
    begin = np.append(0, np.cumsum([len(r) for r in raw]))[:-1]
    n = (hi - lo + 1).astype(np.int64)
    row = np.repeat(np.arange(len(raw)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # from the first window on
    place, before = begin[row] + offset, hi[row] - offset
    number = np.cumsum(np.append(0, shard[1:] != shard[:-1]))[row]
    segment = number * 256 + before
    by_segment = np.argsort(segment, kind="stable")
    # A window alone in its segment has no equal.
    s = segment[by_segment]
    lone = np.append(True, s[1:] != s[:-1]) & np.append(s[:-1] != s[1:], True)
    by_segment = by_segment[~lone]
    s = s[~lone]
    suffixes = Suffixes(data)
    places = place[by_segment]
    order = suffixes.sort(places, s)
    x, seg = places[order], s[order]
    same = np.append(False, (seg[1:] == seg[:-1]))[: len(x)]
    where = np.flatnonzero(same)
    same[where] = suffixes.equal(x[where - 1], x[where])
    gone = np.sort(by_segment[order[same]])
    r, o = row[gone], before[gone]
    return unite(did[r], p[r] - o, p[r] - o + LENGTH)


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solve(*cols) -> list[pa.RecordBatch]:
        found = repeated(*cols)
        return [pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], names=["did", "start", "end"])]

    yield from _by_group(batches, ["shard", "did", "p", "hi", "lo", "bytes"], solve, 8000)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for doc, text, ranges in zip(b["doc_id"].to_pylist(), b["text"], b["ranges"].to_pylist(), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            a = np.array([(r["start"], r["end"]) for r in ranges or ()], np.int64).reshape(-1, 2)
            _, starts, ends = unite(np.zeros(len(a), np.int64), a[:, 0], a[:, 1])
            digest, at = hashlib.sha256(), 0
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                digest.update(raw[at:s])
                at = e
            digest.update(raw[at:])
            for c, v in zip(cols, (doc, len(raw), int((ends - starts).sum()), len(starts), digest.hexdigest()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(),) * 4 + (pa.string(),), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def ordered(docs: DataFrame) -> DataFrame:
    """did, doc_id, text, with did in the order of documents: doc_id itself where it is a key, else a rank."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        return rows.select(F.col("doc_id").alias("did"), "doc_id", "text")
    keyed = rows.withColumn("k0", F.col("doc_id").isNull()).withColumn("k1", F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn("k2", text_hash())
    key = ["k0", "k1", "k2"]
    # Ranks over all: sorted partitions, each with the number of rows in those before it.
    parts = checkpointed(spark, keyed.select(*key).distinct().orderBy(*key)).withColumn("part", F.spark_partition_id())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranks = parts.join(first, "part").withColumn("did", F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy(*key)) - 1)
    return keyed.join(ranks.select(*key, "did"), key).select("did", "doc_id", "text")


def removed_ranges(texts: DataFrame) -> DataFrame:
    """did and its removed ranges (array of start, end), for documents with any; texts has did and text."""
    spark = texts.sparkSession
    rows = texts.select("did", "text").mapInArrow(_blocks, ROWS)
    met = written(spark, rows.repartition("anchor").sortWithinPartitions("anchor", "finger", "did", "place").mapInArrow(_meet, MET))
    wanted = met.filter("kind > 0").groupBy("did").agg(F.collect_list(F.struct("kind", "anchor", "did", "place")).alias("found"))
    shards = texts.select("did", "text").join(wanted, "did").select("text", "found").mapInArrow(_with_bytes, BYTES)
    compared = shards.repartition("shard").sortWithinPartitions("shard", "did", "p").mapInArrow(_sorted, "did long, start long, end long")
    ranges = met.filter("kind = 0").select("did", F.col("anchor").alias("start"), F.col("place").alias("end")).unionByName(compared)
    return ranges.groupBy("did").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    texts = ordered(docs)
    cut = texts.join(removed_ranges(texts), "did", "left").select("doc_id", "text", "ranges")
    return cut.mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))

"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are cut into parts; two fingerprints within the threshold agree
in some part up to threshold // parts bits.  A part's anchors are the words of a
covering code: a Hamming code of 15 bits (radius 1) beside free bits.  A fingerprint is
at home at the anchor within the covering radius, and is replicated to every anchor at
which some fingerprint within the part's threshold of it can be at home; per anchor,
those at home are compared with all replicas.

Cases: null and empty texts have fingerprint zero and are linked like any other.
Documents with equal fingerprints form one class and are never expanded into pairs.
Null doc_ids are passed over in component_id, which is null if a component has no
other; repeated rows are returned each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table, text_hash, written

THRESHOLD, SHINGLE, SEED = 4, 4, 42
#: First bit and width of each part.  Beyond MANY distinct fingerprints two parts of 32 bits keep anchors small.
PARTS_FEW, PARTS_MANY, MANY = ((0, 21), (21, 21), (42, 22)), ((0, 32), (32, 32)), 100_000_000
#: An anchor's fingerprints are compared in tiles of so many rows.
TILE = 1024


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    last = max(1, len(words) - SHINGLE + 1)
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts[:last], ends[min(SHINGLE, len(words)) - 1 :], strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, last, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t.as_py()) for t in b["text"]], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(b[c] for c in b.schema.names if c != "text"), pa.array(fp)], names=[*(c for c in b.schema.names if c != "text"), "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


# --- the covering code ---------------------------------------------------------------

#: Syndrome of each 15-bit word: the xor of the positions (1 to 15) of its ones.  0 for words of the Hamming code.
_SYNDROME = np.zeros(1 << 15, dtype=np.uint8)
for _i in range(15):
    _SYNDROME[1 << _i : 2 << _i] = _SYNDROME[: 1 << _i] ^ (_i + 1)


def nearest(words: np.ndarray) -> np.ndarray:
    """The code word within distance 1 of each 15-bit word."""
    s = _SYNDROME[words].astype(np.int64)
    return words ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)


def replicas(fp: np.ndarray, first: int, width: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor where a fingerprint within t of fp's part can be at home; each row's home comes first."""
    mask = np.uint64((1 << width) - 1)
    part = ((fp.view(np.uint64) >> np.uint64(first)) & mask).astype(np.int64)
    code, free = part & 0x7FFF, part >> 15
    flips: list[tuple[int, int]] = [(0, 0)]
    for _ in range(t):
        flips = list(dict.fromkeys([*flips, *((c ^ (1 << i), f) for c, f in flips for i in range(15)), *((c, f ^ (1 << i)) for c, f in flips for i in range(width - 15))]))
    anchors = np.stack([((free ^ f) << 15) | nearest(code ^ c) for c, f in flips], axis=1)
    home = anchors[:, :1].copy()
    rest = np.sort(anchors[:, 1:], axis=1)
    new = np.ones(anchors.shape, dtype=bool)
    new[:, 1:] = (rest != home) & np.concatenate([np.ones((len(fp), 1), bool), rest[:, 1:] != rest[:, :-1]], axis=1)
    rows, cols = np.nonzero(new)
    return rows, np.concatenate([home, rest], axis=1)[rows, cols]


def _replicate(parts: tuple, threshold: int):
    t = threshold // len(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b["fp"].to_numpy(zero_copy_only=False)
            for lo in range(0, len(fp), 4096):
                some = fp[lo : lo + 4096]
                for k, (first, width) in enumerate(parts):
                    rows, anchor = replicas(some, first, width, t)
                    home = np.append(True, rows[1:] != rows[:-1]) if len(rows) else np.zeros(0, bool)
                    yield pa.RecordBatch.from_arrays([pa.array((anchor << 2) | k), pa.array(some[rows]), pa.array(home)], names=["anchor", "fp", "home"])

    return run


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _links(threshold: int):
    """Links per anchor, from rows sorted by anchor: a forest over each anchor's fingerprints, not all its pairs."""

    def forest(fp: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fp = np.unique(fp) if len(fp) > 2 else fp
        n, parent = len(fp), np.arange(len(fp))
        for i in range(0, n, TILE):
            for j in range(i, n, TILE):
                near = np.argwhere(popcount(fp[i : i + TILE, None] ^ fp[None, j : j + TILE]) <= threshold)
                near = near[near[:, 0] + i < near[:, 1] + j] if len(near) else near
                for a, c in zip((near[:, 0] + i).tolist(), (near[:, 1] + j).tolist(), strict=True):
                    while parent[a] != a:
                        parent[a] = a = parent[parent[a]]
                    while parent[c] != c:
                        parent[c] = c = parent[parent[c]]
                    if a != c:
                        parent[max(a, c)] = min(a, c)
        for i in range(n):
            r = i
            while parent[r] != r:
                r = parent[r]
            parent[i] = r
        got = parent != np.arange(n)
        if got.any():
            yield fp[parent[got]], fp[got]

    def small(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All groups of up to SMALL rows at once: row i against row i + d."""
        a, c = [], []
        for d in range(1, len(fp)):
            same = anchor[:-d] == anchor[d:]
            if not same.any():
                break
            hit = same & (home[:-d] | home[d:]) & (popcount(fp[:-d] ^ fp[d:]) <= threshold)
            a.append(fp[:-d][hit])
            c.append(fp[d:][hit])
        none = np.zeros(0, np.uint64)
        return np.concatenate([none, *a]), np.concatenate([none, *c])

    def solve(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        sizes = np.diff(np.append(first, len(anchor)))
        many = np.repeat(sizes > 64, sizes)
        found = [small(anchor[~many], fp[~many], home[~many])]
        for at, n in zip(first[sizes > 64], sizes[sizes > 64], strict=True):
            found += forest(fp[at : at + n], home[at : at + n])
        src, dst = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(src):
            yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            held.append((b["anchor"].to_numpy(), b["fp"].to_numpy().view(np.uint64), b["home"].to_numpy(zero_copy_only=False)))
            if not len(held[-1][0]) or held[0][0][0] == held[-1][0][-1]:
                held = held if len(held[-1][0]) else held[:-1]
                continue  # one anchor so far
            anchor, fp, home = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(anchor, anchor[-1]))
            yield from solve(anchor[:cut], fp[:cut], home[:cut])
            held = [(anchor[cut:], fp[cut:], home[cut:])]
        if held:
            yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links(classes: DataFrame, threshold: int = THRESHOLD, parts: tuple | None = None) -> DataFrame:
    """Links between distinct fingerprints (column fp) within the threshold: enough to connect all that are linked."""
    if parts is None:
        parts = PARTS_MANY if classes.limit(MANY + 1).count() > MANY else PARTS_FEW
    at = classes.select("fp").mapInArrow(_replicate(parts, threshold), "anchor long, fp long, home boolean")
    return at.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_links(threshold), "src long, dst long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (src, dst), by large-star and small-star steps until nothing moves.

    Each round is two shuffles of the edges that are left; a hub's neighbours are only
    aggregated (min) and joined, never gathered.
    """
    spark = edges.sparkSession
    now = checkpointed(spark, edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())
    last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        now = checkpointed(spark, small)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = mark


def near_duplicates(prints: DataFrame, threshold: int = THRESHOLD, parts: tuple | None = None) -> DataFrame:
    """Adds component_id, the smallest doc_id reachable over links, to rows with doc_id and fp (read twice: a table)."""
    spark = prints.sparkSession
    classes = checkpointed(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = components(links(classes, threshold, parts))
    roots = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    named = roots.join(least, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp")


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id (nulls last) stays."""
    key = ["k0", "k1", "k2"]
    id_ = F.col("doc_id").cast("long")
    keys = [id_.isNull().alias("k0"), F.coalesce(id_, F.lit(0).cast("long")).alias("k1"), text_hash(F.col("text").cast("string")).alias("k2")]
    rows = docs.select(*keys, id_.alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = written(docs.sparkSession, rows.mapInArrow(_fingerprints, "k0 boolean, k1 long, k2 long, doc_id long, fp long"))
    first = near_duplicates(prints, threshold).groupBy("root").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
    held = docs.select(*keys, F.struct(*docs.columns).alias("row"))
    return held.join(first, key).dropDuplicates(key).select("row.*")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(spark, fingerprints(table(spark, sf_dir, "documents")))
    return near_duplicates(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

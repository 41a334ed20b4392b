"""Near-duplicates by SimHash, anchor-point covering and exact Jaccard similarity of word shingles.

Texts with equal sets of five-word shingles form a class; a class's print is the SimHash of
its set in BITS bits.  At the least similarity allowed, LEAST of OF, a bit of two prints
differs with probability FAR at most (FAR_TINY for four shingles against five), which is the
radius of the covering.  That is too far to be covered without a miss, so parts are many:
each takes 15 bits that are covered by the anchors of the Hamming code of simhash, beside free
bits, and a class is at home at the nearest anchor of each part.  Classes at home at one
anchor are compared by the Hamming distance of their prints, first of SKETCH bits, then of
all, and what is within the radius by its whole sets.  A pair at the least similarity shares
no anchor with a probability of about MISS; free bits keep anchors small in large tables.

At the anchors of the first parts each class is compared with one other, in an order drawn
anew for each anchor, so that large groups grow together without all their pairs.  At all
anchors classes are then compared that are still apart.  Their pairs, which are many in large
groups of texts half alike, stay inside the anchor: what leaves it is which classes have a
partner there; their sets then come to the anchor, and links that join them leave it.

Cases: null and empty texts have no shingles and form one class; texts of fewer than
five words are one shingle.  Sets and classes are told apart by hashes of 64 bits.
Repeated rows are one document; null doc_ids come last; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_hash, written
from .simhash import components, nearest, popcount

SHINGLE, SEED = 5, 42
#: Similarity from which on texts are near-duplicates, as a fraction.
LEAST, OF = 4, 5
#: Bits of a print, and of its beginning that is compared at anchors.
BITS, SKETCH = 1024, 384
#: Most bits in which prints, and their beginnings, differ at the least similarity: 4 deviations beyond the mean of FAR_TINY.
RADIUS, SKETCH_RADIUS = 245, 104
#: Probabilities that a bit differs at the least similarity: the greatest over sets of more than TINY shingles, and over all.
FAR, FAR_TINY, TINY = 0.1612, 0.1875, 5
MISS = 1e-5
#: Parts at whose anchors groups are first grown together.
GROW = 16
#: Columns of a print's beginning.
WORDS = [f"w{i}" for i in range(SKETCH // 64)]
#: Columns of a class at an anchor, beside it.
ROW = ["cls", "label", "n", *WORDS]
#: An anchor's classes are compared in tiles of so many rows.
TILE = 256


class Family:
    """Independent MinHash bands: a number of bands, values a band, and the constants of their hash functions.  Tests measure the covering against them."""

    def __init__(self, bands: int, rows: int, seed: int) -> None:
        drawn = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.xor = drawn.integers(0, 1 << 64, bands * rows, dtype=np.uint64)
        self.times = drawn.integers(0, 1 << 64, bands * rows, dtype=np.uint64) | np.uint64(1)


FINE = Family(165, 12, 8)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; words as in simhash.fingerprint."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    h = xxhash.xxh64_intdigest
    pairs = zip(starts, ends[min(SHINGLE, len(words)) - 1 :], strict=False)
    return np.unique(np.array([h(joined[a : b - 1], SEED) for a, b in pairs], dtype=np.uint64))


def bands(grams: np.ndarray, of: Family = FINE) -> list[int]:
    """One signed long a band; none for an empty set."""
    if not len(grams):
        return []
    low = np.full(of.bands * of.rows, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 20) // len(low))
    for i in range(0, len(grams), step):
        low = np.minimum(low, ((grams[i : i + step, None] ^ of.xor) * of.times).min(0))
    raw = low.astype("<u8").tobytes()
    wide = 8 * of.rows
    keys = [xxhash.xxh64_intdigest(raw[wide * k : wide * (k + 1)], k) for k in range(of.bands)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def simhash_bits(grams: np.ndarray) -> np.ndarray:
    """The print of a set, as BITS / 64 words: a bit is 1 if set in over half the shingles' hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(grams), 255):  # a byte counts up to 255
        x = grams[i : i + 255, None] + _STEPS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")


_STEPS = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cls, n, prints = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, BITS // 64), np.int64)
        for i, t in enumerate(b["text"]):
            grams = shingles(t.as_py())
            cls[i], n[i], prints[i] = xxhash.xxh64_intdigest(grams.astype("<u8").tobytes(), SEED), len(grams), simhash_bits(grams).view(np.int64)
        starts = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (BITS // 64))
        made = [pa.array(cls.view(np.int64)), pa.array(n), pa.ListArray.from_arrays(starts, pa.array(prints.ravel()))]
        yield pa.RecordBatch.from_arrays([b["k0"], b["k1"], b["k2"], *made], names=["k0", "k1", "k2", "cls", "n", "print"])


# --- the covering --------------------------------------------------------------------


def shares(p: float, free: int) -> float:
    """Probability that two prints whose bits differ with probability p have one anchor in a part: 15 bits with one nearest code word, free bits equal."""
    differ = [comb(15, k) * p**k * (1 - p) ** (15 - k) for k in range(3)]
    return (differ[0] + (differ[1] + differ[2]) / 8) * (1 - p) ** free


class Covering:
    """Parts for so many classes: an anchor of 15 + free bits holds about 500 of them at most.

    ``parts`` are enough for sets of more than TINY shingles; smaller sets have all.
    """

    def __init__(self, classes: int) -> None:
        self.free = max(0, classes.bit_length() - 20)
        self.parts, self.all = (ceil(log(MISS) / log(1 - shares(p, self.free))) for p in (FAR, FAR_TINY))
        drawn = np.random.default_rng(7)
        self.bits = np.stack([drawn.choice(BITS, 15 + self.free, replace=False) for _ in range(self.all)])

    def homes(self, prints: np.ndarray, parts: int) -> np.ndarray:
        """The anchor of each print (a row of words) in each of the first parts."""
        ones = np.unpackbits(prints.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        word = np.zeros((len(prints), parts), np.int64)
        for i in range(15 + self.free):
            word |= ones[:, self.bits[:parts, i]].astype(np.int64) << i
        return (np.arange(parts) << 48) | (word >> 15 << 15) | nearest(word & 0x7FFF)


def _at_home(cover: Covering, parts: int | None) -> Callable:
    """A class's rows at its anchors: of the first parts, or of as many as its size needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, label, n = (b[c].to_numpy() for c in ("cls", "label", "n"))
            prints = b["print"].values.to_numpy()[b["print"].offsets[0].as_py() :][: len(cls) * BITS // 64].view(np.uint64).reshape(-1, BITS // 64)
            for lo in range(0, len(cls), 128):
                for tiny in (False, True):
                    at = lo + np.flatnonzero((n[lo : lo + 128] <= TINY) == tiny)
                    if len(at):
                        m = parts or (cover.all if tiny else cover.parts)
                        anchors = cover.homes(prints[at], m).ravel()
                        rows = np.repeat(at, m)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors, cls[rows], label[rows], n[rows], *(prints[rows, i].view(np.int64) for i in range(len(WORDS))))], names=["anchor", *ROW])

    return run


def _whole(batches: Iterator[pa.RecordBatch], read: Callable) -> Iterator[tuple]:
    """Columns of rows sorted by anchor, cut between anchors only; read makes a batch's columns, the anchor first."""
    held: list[tuple] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(read(b))
        if held[0][0][0] != held[-1][0][-1]:
            rows = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            yield tuple(c[:cut] for c in rows)
            held = [tuple(c[cut:] for c in rows)]
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _groups(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each anchor."""
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    return first, np.diff(np.append(first, len(anchor)))


def _meet(chain: bool, ask: bool) -> Callable:
    """Classes at one anchor, of different labels, with fitting sizes and beginnings within the radius, from rows sorted by anchor.

    chain: only neighbours in an order drawn for each anchor are compared.  ask: the rows (anchor,
    cls) that have such a partner, each once, in place of all the pairs (a, b).
    """

    def near(x: tuple, y: tuple) -> np.ndarray:
        fits = (x[2] != y[2]) & (OF * np.minimum(x[3], y[3]) >= LEAST * np.maximum(x[3], y[3]))  # other sizes rule a pair out
        return (sum(popcount(p ^ q).astype(np.int16) for p, q in zip(x[4:], y[4:], strict=True)) <= SKETCH_RADIUS) & fits

    def solve(rows: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of row numbers."""
        first, sizes = _groups(rows[0])
        at = np.flatnonzero(np.repeat(chain | (sizes <= 64), sizes))
        some = tuple(c[at] for c in rows)
        for d in range(1, 2 if chain else 64):
            same = np.flatnonzero(some[0][:-d] == some[0][d:])
            if not len(same):
                break
            hit = same[near(tuple(c[same] for c in some), tuple(c[same + d] for c in some))]
            yield at[hit], at[hit + d]
        for lo, n in zip(first[sizes > 64], sizes[sizes > 64], strict=True) if not chain else ():
            for i in range(lo, lo + n, TILE):
                x = tuple(c[i : min(i + TILE, lo + n), None] for c in rows)
                for j in range(i, lo + n, TILE):
                    a, c = np.nonzero(near(x, tuple(c[None, j : min(j + TILE, lo + n)] for c in rows)))
                    later = a + i < c + j
                    yield a[later] + i, c[later] + j

    def read(b: pa.RecordBatch) -> tuple:
        long = [b[c].to_numpy() for c in ("anchor", *ROW)]
        return *long[:4], *(c.view(np.uint64) for c in long[4:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, read):
            if chain:
                mixed = (rows[1].view(np.uint64) ^ (rows[0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
                rows = tuple(c[np.lexsort((mixed, rows[0]))] for c in rows)
            anchor, cls = rows[:2]
            asks = np.zeros(len(anchor), bool)
            for p, q in solve(rows):
                if ask:
                    asks[p] = asks[q] = True
                elif len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[p], cls[q])), pa.array(np.maximum(cls[p], cls[q]))], names=["a", "b"])
            if asks.any():
                yield pa.RecordBatch.from_arrays([pa.array(anchor[asks]), pa.array(cls[asks])], names=["anchor", "cls"])

    return run


def _met(classes: DataFrame, cover: Covering, chain: bool, ask: bool) -> DataFrame:
    at = classes.select("cls", "label", "n", "print").mapInArrow(_at_home(cover, GROW if chain else None), ", ".join(f"{c} long" for c in ["anchor", *ROW]))
    return at.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_meet(chain, ask), "anchor long, cls long" if ask else "a long, b long")


def candidates(classes: DataFrame, cover: Covering, chain: bool) -> DataFrame:
    """Distinct pairs (a, b) of classes (cls, label, n, print) of different labels that share an anchor and are within the radius.

    Without chain these are all pairs, whose number grows with the square of a group; the stage takes asking and linked.
    """
    met = _met(classes, cover, chain, False).distinct()
    a = classes.select(F.col("cls").alias("a"), F.col("print").alias("x"))
    b = classes.select(F.col("cls").alias("b"), F.col("print").alias("y"))
    apart = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return met.join(a, "a").join(b, "b").filter(apart <= RADIUS).select("a", "b")


def asking(classes: DataFrame, cover: Covering) -> DataFrame:
    """The anchors (anchor, cls) at which a class has a partner of another label to be looked at: one row a home at most, however many the partners."""
    return _met(classes, cover, False, True)


def _forest(radius: int) -> Callable:
    """Links (src, dst) that join the labels at each anchor as its similar pairs do, from rows sorted by anchor with prints and sets."""

    def read(b: pa.RecordBatch) -> tuple:
        grams = np.empty(b.num_rows, object)
        ends, flat = b["grams"].offsets.to_numpy(), b["grams"].values.to_numpy()
        for i in range(b.num_rows):
            grams[i] = flat[ends[i] : ends[i + 1]].view(np.uint64)
        ends = b["print"].offsets.to_numpy()
        prints = b["print"].values.to_numpy()[ends[0] : ends[-1]].view(np.uint64).reshape(-1, BITS // 64)
        return b["anchor"].to_numpy(), b["cls"].to_numpy(), b["label"].to_numpy(), prints, grams

    def solve(cls: np.ndarray, label: np.ndarray, prints: np.ndarray, grams: np.ndarray) -> Iterator[tuple[int, int]]:
        label = np.unique(label, return_inverse=True)[1]
        n = np.array([len(x) for x in grams])
        for i in range(len(cls) - 1):
            fits = (label[i + 1 :] != label[i]) & (OF * np.minimum(n[i], n[i + 1 :]) >= LEAST * np.maximum(n[i], n[i + 1 :]))
            left = i + 1 + np.flatnonzero(fits)
            left = left[popcount(prints[left] ^ prints[i]).sum(1, dtype=np.int64) <= radius]
            while len(left):  # some at a time, since links take others off the list
                some, left = left[:32], left[32:]
                sets = np.concatenate(grams[some])
                shared = grams[i][np.minimum(np.searchsorted(grams[i], sets), n[i] - 1)] == sets
                both = np.add.reduceat(shared, np.append(0, np.cumsum(n[some])[:-1]), dtype=np.int64)
                for c in some[OF * both >= LEAST * (n[i] + n[some] - both)]:
                    if label[c] != label[i]:
                        yield cls[i], cls[c]
                        label[label == label[c]] = label[i]
                left = left[label[left] != label[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor, *rows in _whole(batches, read):
            found = [link for lo, n in zip(*_groups(anchor), strict=True) for link in solve(*(c[lo : lo + n] for c in rows))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["src", "dst"])

    return run


def linked(asks: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (src, dst) between labels: of the similar pairs at each anchor (asks) a forest, so fewer than rows."""
    whole = sets.join(classes.select("cls", "label", "print"), "cls")  # once a class, then once an anchor
    rows = asks.join(whole, "cls").select("anchor", "cls", "label", "print", "grams")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_forest(RADIUS), "src long, dst long")


# --- sets and documents --------------------------------------------------------------


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c, t in zip(b["cls"], b["text"], strict=True):
            grams = pa.array([shingles(t.as_py()).view(np.int64)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([c.as_py()], pa.int64()), grams], names=["cls", "grams"])


KEY = ["k0", "k1", "k2"]


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, as edges."""
    a = sets.select(F.col("cls").alias("a"), F.col("grams").alias("x"))
    b = sets.select(F.col("cls").alias("b"), F.col("grams").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    either = F.size("x") + F.size("y") - both
    return pairs.join(a, "a").join(b, "b").filter(OF * both >= LEAST * either).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id (nulls last) stays."""
    spark = docs.sparkSession
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    keys = [id_.isNull().alias("k0"), F.coalesce(id_, F.lit(0).cast("long")).alias("k1"), text_hash(text).alias("k2")]
    prints = written(spark, docs.select(*keys, text.alias("text")).mapInArrow(_signatures, "k0 boolean, k1 long, k2 long, cls long, n long, print array<long>"))
    classes = written(spark, prints.filter("n > 0").groupBy("cls").agg(F.min(F.struct(*KEY)).alias("k"), F.first("n").alias("n"), F.first("print").alias("print")).select("cls", "n", "print", "k.*"))
    cover = Covering(classes.count())

    def sets(asked: DataFrame) -> DataFrame:
        """The sets of classes (cls, each once); one text a class is read."""
        texts = docs.select(*keys, text.alias("text")).join(asked.join(classes.select("cls", *KEY), "cls"), KEY).dropDuplicates(["cls"]).select("cls", "text")
        return written(spark, texts.mapInArrow(_sets, "cls long, grams array<long>"))

    pairs = written(spark, candidates(classes.withColumn("label", F.col("cls")), cover, chain=True))
    edges = written(spark, _similar(pairs, sets(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())))
    found = components(edges)
    labelled = written(spark, classes.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "n", "print", F.coalesce("root", "cls").alias("label")))
    asks = written(spark, asking(labelled, cover))
    more = written(spark, linked(asks, labelled, sets(asks.select("cls").distinct())))
    if not more.isEmpty():
        found = components(edges.unionByName(more))

    root = F.coalesce("root", "cls").alias("root")
    named = prints.join(found.withColumnRenamed("node", "cls"), "cls", "left").select(*KEY, root)
    first = named.groupBy("root").agg(F.min(F.struct(*KEY)).alias("k")).select("k.*")
    held = docs.select(*keys, F.struct(*docs.columns).alias("row"))
    return held.join(first, KEY).dropDuplicates(KEY).select("row.*")

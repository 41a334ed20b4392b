"""Strings within a few edits of each other, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i, where a string is cut into parts as even as can be."""
    base, rest = F.floor(length / parts).cast("int"), length % parts
    late = F.greatest(F.lit(0), i - (parts - rest))
    return i * base + late, base + (i >= parts - rest).cast("int")


def _hash(word: str, length: Column, i: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(length, i, F.substring(F.col(word), start + 1, size))


def _kept(word: str, distance: int) -> Column:
    """Hashes of a string's own segments."""

    def one(i: Column) -> Column:
        start, size = _segment(F.length(word), i, distance + 1)
        return _hash(word, F.length(word), i, start, size)

    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(distance)), one))


def _sought(word: str, distance: int, longer: int) -> Column:
    """Hashes of the segments that strings of up to distance shorter and longer more characters may have kept, wherever edits may have moved them."""

    def one(length: Column, i: Column) -> Column:
        start, size = _segment(length, i, distance + 1)
        first, last = F.greatest(F.lit(0), start - distance), F.least(start + distance, F.length(word) - size)
        places = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda p: _hash(word, length, i, p, size))

    lengths = F.sequence(F.greatest(F.lit(0), F.length(word) - distance), F.length(word) + longer)
    segments = F.sequence(F.lit(0), F.lit(distance))
    return F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(segments, lambda i: one(n, i))))))


def near_matches(left: DataFrame, right: DataFrame, by: list[str], distance: int = 2) -> DataFrame:
    """by..., a, b, distance: strings of left (by..., a) and right (by..., b) that are at most so many edits apart, within each group.

    A string cut into distance + 1 segments keeps one of them through so many edits, moved
    by no more than as many places.  So strings of right are found by their segments, and
    left looks for them at the places they may have moved to.  Null strings are passed over.
    """
    index = right.select(*by, "b").filter("b is not null").distinct().select(*by, "b", F.explode(_kept("b", distance)).alias("__segment"))
    look = left.select(*by, "a").filter("a is not null").distinct().select(*by, "a", F.explode(_sought("a", distance, distance)).alias("__segment"))
    pairs = index.join(look, [*by, "__segment"]).select(*by, "a", "b", F.levenshtein("a", "b", distance).alias("distance"))
    return pairs.filter("distance >= 0").distinct()


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of each word in a row, zeros behind."""
    out = np.zeros((len(words), width), np.uint32)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _signs(codes: np.ndarray) -> np.ndarray:
    """One bit for each kind of sign that a word holds."""
    return np.bitwise_or.reduce(np.where(codes > 0, np.left_shift(np.uint64(1), (codes & 63).astype(np.uint64)), np.uint64(0)), axis=1)


def _edits(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, distance: int) -> np.ndarray:
    """Edit distance of x[i] and y[i], whose lengths differ by no more than distance; more than distance if it is more."""
    far, band = distance + 1, range(-distance, distance + 1)
    row = [np.full(len(x), k if k >= 0 else far, np.int32) for k in band] + [np.full(len(x), far, np.int32)]
    at = ny - nx + distance
    out = np.where(nx == 0, np.stack(row)[at, np.arange(len(x))], far)
    for i in range(1, int(nx.max(initial=0)) + 1):
        new: list[np.ndarray] = []
        for s, k in enumerate(band):
            j = i + k
            if j < 0:
                cell = np.full(len(x), far, np.int32)
            elif j == 0:
                cell = np.full(len(x), i, np.int32)
            else:
                cell = np.minimum(row[s] + (x[:, i - 1] != y[:, j - 1]), row[s + 1] + 1)
            new.append(np.minimum(cell, new[-1] + 1) if new else cell)
        row = [*new, row[-1]]
        done = nx == i
        if done.any():
            out[done] = np.stack(new)[at[done], np.flatnonzero(done)]
    return out


#: Words up to so many letters are compared together, longer ones with those of about their length.
SHORT = 32


def close_words(left: list[str], right: list[str], distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in left and right of words at most so many edits apart, and how many.

    An edit takes away one kind of sign and brings one at most, so only words whose kinds
    differ by no more are compared.
    """
    na, nb = np.array([len(w) for w in left], np.int32), np.array([len(w) for w in right], np.int32)
    found = [(np.zeros(0, np.int64),) * 3]
    groups = [(na <= SHORT, nb <= SHORT + distance)] + [(na == n, abs(nb - n) <= distance) for n in np.unique(na[na > SHORT])]
    for a, b in ((np.flatnonzero(u), np.flatnonzero(v)) for u, v in groups):
        if not len(a) or not len(b):
            continue
        width = int(na[a].max())
        b = b[nb[b] <= width + distance]
        x, y = _codes([left[i] for i in a], width), _codes([right[i] for i in b], width + distance)
        sx, sy = _signs(x), _signs(y)
        step = max(1, (1 << 21) // max(1, len(b)))
        for lo in range(0, len(a), step):
            p, q = sx[lo : lo + step, None], sy[None, :]
            fits = (np.bitwise_count(p & ~q) <= distance) & (np.bitwise_count(q & ~p) <= distance) & (abs(na[a[lo : lo + step], None] - nb[None, b]) <= distance)
            i, j = np.nonzero(fits)
            for at in range(0, len(i), 1 << 18):
                u, v = i[at : at + (1 << 18)] + lo, j[at : at + (1 << 18)]
                d = _edits(x[u], na[a[u]], y[v], nb[b[v]], distance)
                near = d <= distance
                found.append((a[u[near]], b[v[near]], d[near]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def near_in_rows(rows: DataFrame, key: str, left: str, right: str, distance: int = 2) -> DataFrame:
    """key, a, b, distance, place: strings a of the array left and strings b of the array right of the same row that are at most so many edits apart.

    place counts the likes of a from 1, by (distance, b).  A row is one text's strings and
    stays where it is; arrays hold no nulls and no string twice.
    """
    kind = dict(rows.dtypes)[key]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                l, r = batch["l"][at].as_py(), sorted(batch["r"][at].as_py())
                a, b, d = close_words(l, r, distance)
                if not len(a):
                    continue
                order = np.lexsort((b, d, a))
                a, b, d = a[order], b[order], d[order]
                first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) + 1
                own = pa.array([batch["k"][at].as_py()], batch["k"].type).take(pa.array(np.zeros(len(a), np.int64)))
                words = [pa.array(l, pa.string()).take(pa.array(a)), pa.array(r, pa.string()).take(pa.array(b))]
                yield pa.RecordBatch.from_arrays([own, *words, pa.array(d.astype(np.int32)), pa.array(place.astype(np.int32))], names=["k", "a", "b", "distance", "place"])

    some = rows.select(F.col(key).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")).filter("size(l) > 0 and size(r) > 0")
    return some.mapInArrow(each, f"k {kind}, a string, b string, distance int, place int").withColumnRenamed("k", key)


def near_pairs(words: DataFrame, word: str, distance: int = 2) -> DataFrame:
    """a, b (a < b), distance: all pairs of distinct strings at most so many edits apart; found as near_matches are."""
    each = words.select(F.col(word).alias("w")).filter("w is not null").distinct()
    index = each.select(F.col("w").alias("x"), F.explode(_kept("w", distance)).alias("__segment"))
    look = each.select(F.col("w").alias("y"), F.explode(_sought("w", distance, 0)).alias("__segment"))
    pairs = index.join(look, "__segment").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.levenshtein("x", "y", distance).alias("distance"))
    return pairs.filter("distance >= 0").distinct()

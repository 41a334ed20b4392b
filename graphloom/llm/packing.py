"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Patterns of a few lengths that fill a sequence are fitted to the length histogram by
non-negative least squares; the fit is rounded; pieces left over are packed best-fit,
longest first.  The histogram has one entry per length, however many documents there
are, so planning is work for the driver; pieces find their places by rank and join.

Cases: a null or empty text has only the closing id 0.  Repeated rows are packed each;
null doc_ids stay null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distributed_rank, table, written

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PARTNERS, SWEEPS = 12, 40
CACHE_WORDS = 200_000

#: The published pattern that cuts text before the byte-pair merges; letters and numbers as regex classes.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"
_LATIN = r"A-Za-zÀ-ÖØ-öø-ƺƼ-ƿǄ-ɏ"
_CUT_LATIN = re.compile(_CUT.format(L=f"[{_LATIN}]", N="[0-9]", l=_LATIN, n="0-9"))
_NOT_LATIN = re.compile(rf"[^\x09-\x0d\x20-\x7e{_LATIN}]")


class WordIds(dict):
    """Word -> its ids as little-endian 32-bit numbers; filled as words are met, emptied when full."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        # Added tokens are taken out of the text first, wherever they stand.
        self._added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in whole.get("added_tokens", ())}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in whole.get("added_tokens", ())):
            raise ValueError("added tokens with conditions are not known here")
        longest = sorted(self._added, key=len, reverse=True)
        self._marks = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        byte_of = _byte_alphabet()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
        for token in self._added:
            ranks.pop(token.encode(), None)
        self._any = regex.compile(_CUT.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}"))
        self._encode = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self[word] = np.array(self._encode(word), dtype="<u4").tobytes()
        return ids

    def ids(self, text: str) -> bytes:
        if self._marks and self._marks.search(text):
            parts = self._marks.split(text)
            return b"".join(self._added[part] if i % 2 else self._plain_ids(part) for i, part in enumerate(parts))
        return self._plain_ids(text)

    def _plain_ids(self, text: str) -> bytes:
        words = (self._any if _NOT_LATIN.search(text) else _CUT_LATIN).findall(text)
        return b"".join(map(self.__getitem__, words))


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


_words: dict[str, WordIds] = {}


def tokenizer(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                ids = (words.ids(text) if text else b"") + b"\0\0\0\0"
                total = len(ids) // 4
                head = (total - 1) % capacity + 1
                for piece, end in enumerate(range(head, total + 1, capacity)):
                    start = max(0, end - capacity)
                    rows.append((doc, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece.  Only documents longer than the capacity are cut; their first piece is the short one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_cut(path, capacity), PIECES)


def patterns(lengths: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Pairs, and for each length some triples and quadruples, of given lengths that sum to the capacity."""
    have, found = set(lengths), {(capacity,)} if capacity in lengths else set()
    ordered = np.array(sorted(have))
    for a in lengths:
        if capacity - a in have:
            found.add(tuple(sorted((a, capacity - a))))
        inside = ordered[ordered < capacity - a]
        for b in inside[np.unique(np.linspace(0, len(inside) - 1, min(PARTNERS, len(inside))).astype(int))].tolist() if len(inside) else []:
            if capacity - a - b in have:
                found.add(tuple(sorted((a, b, capacity - a - b))))
            c = (capacity - a - b) // 2
            if c in have and capacity - a - b - c in have:
                found.add(tuple(sorted((a, b, c, capacity - a - b - c))))
    return sorted(found)


def fit(pats: list[tuple[int, ...]], counts: dict[int, int], sweeps: int = SWEEPS) -> list[float]:
    """Repeats >= 0 with least squared difference between the pieces used and the histogram, by coordinate descent."""
    use = [[(n, p.count(n)) for n in set(p)] for p in pats]
    norm = [sum(m * m for _, m in u) for u in use]
    left = {n: float(c) for n, c in counts.items()}
    x = [0.0] * len(pats)
    for _ in range(sweeps):
        moved = 0.0
        for j, u in enumerate(use):
            step = max(-x[j], sum(m * left[n] for n, m in u) / norm[j])
            if step:
                x[j] += step
                moved += abs(step)
                for n, m in u:
                    left[n] -= m * step
        if moved < 0.5:
            break
    return x


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each piece into the fullest open sequence that takes it; equal sequences are handled together."""
    open_, done = {}, []
    spaces: list[int] = []
    from bisect import bisect_left, insort

    def put(space: int, pattern: tuple[int, ...], n: int) -> None:
        if space == 0:
            done.append((pattern, n))
            return
        if space not in open_:
            insort(spaces, space)
            open_[space] = []
        open_[space].append((pattern, n))

    for size in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        todo = counts[size]
        while todo:
            at = bisect_left(spaces, size)
            if at == len(spaces):
                each = capacity // size
                full, part = divmod(todo, each)
                for k, n in ((each, full), (part, 1)):
                    if k and n:
                        put(capacity - k * size, (size,) * k, n)
                break
            space = spaces[at]
            pattern, n = open_[space].pop()
            if not open_[space]:
                del open_[space]
                spaces.pop(at)
            take = min(n, todo)
            if n > take:
                put(space, pattern, n - take)
            put(space - size, (*pattern, size), take)
            todo -= take
    return done + [x for xs in open_.values() for x in xs]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences); uses each length as often as it is counted."""
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    if left:
        pats = patterns(sorted(left), capacity)
        x = fit(pats, left)
        for j in sorted(range(len(pats)), key=lambda j: (-x[j], pats[j])):
            times = min([int(x[j] + 0.5), *(left[n] // pats[j].count(n) for n in set(pats[j]))])
            if times > 0:
                out.append((pats[j], times))
                for n in pats[j]:
                    left[n] -= times
    return out + best_fit(left, capacity)


def slots(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset): where pieces of a length go, by rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in planned:
        offset = 0
        for n in pattern:
            first = used.get(n, 0)
            rows.append((n, first, first + times, sequence, offset))
            used[n] = first + times
            offset += n
        sequence += times
    return rows


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    spark = docs.sparkSession
    pieces = written(spark, cut_documents(docs, path, capacity))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row per length
    places = spark.createDataFrame(slots(plan(counts, capacity)), "length long, lo long, hi long, seq long, offset long")
    ranked = distributed_rank(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"]).alias("p")
    at = (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    # The plan's rows are bounded by the lengths, not by the documents.
    placed = ranked.join(F.broadcast(places).alias("s"), at)
    return placed.select("doc_id", "piece", "start", "p.length", "ids_crc32", (F.col("seq") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_path())

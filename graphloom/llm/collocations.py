"""Phrase collocations by pivot partitioning.

Texts are cut into pieces and words; a phrase is a run of words inside a piece.  Words
that occur often enough are numbered by falling frequency.  Every occurrence of such a
word is a pivot: around it the text is rewritten to the fragment of up to LONGEST - 1
words on each side that are more frequent (on the right: or equal), up to the first
other word.  A phrase's rarest word, where it stands first, has the whole phrase in its
fragment, so a phrase is counted at one pivot and once an occurrence.  Fragments are
shuffled by pivot, several pivots sharing a bucket, and mined there, shorter phrases
first: a longer one is looked for only in fragments whose shorter one is frequent.  A word
with more than SHARD occurrences has buckets of its own, one for each shard of the blocks
of text; its phrases get partial counts, which are summed.

Texts are read in blocks.  A block asks once for each distinct word, and the numbers of
its frequent words meet its compressed texts in one task; no vocabulary is collected or
broadcast.

Cases: null, empty and blank texts hold nothing; a null lang counts as 'und', with that
lang's own rows; repeated rows and null doc_ids count like any other; long texts are one
row of a block; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .ngram_quality import blocks

LEAST, LONGEST, TOP = 100, 5, 2000
#: Occurrences of a pivot that are mined together, and those of the pivots of a bucket on average.
SHARD, HELD = 1 << 20, 1 << 19
#: Shards by which a lang's phrases are ranked before their best ones meet.
SALTS = 16
REACH = LONGEST - 1
#: Level of compression of blocks of text, and most shards of a word.
LEVEL, MANY = 7, 1 << 20

#: Lower-cases A-Z; ends of pieces become full stops, tabs become spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, with b'.' between pieces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).replace(b".", b" . ").split()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, rows in blocks(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
            out.write_table(rows)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "packed"])


def _unpacked(blob: pa.Scalar) -> Iterator[tuple[str, list[bytes]]]:
    rows = pa.ipc.open_stream(blob.as_buffer()).read_all()
    for lang, text in zip(rows["lang"], rows["text"], strict=True):
        yield lang.as_py(), tokens(text.as_py())


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every block's distinct words and their counts; a row without word for all of them."""
    for b in batches:
        for block, blob in zip(b["block"], b["packed"], strict=True):
            found: dict[str, Counter] = {}
            for lang, words in _unpacked(blob):
                found.setdefault(lang, Counter()).update(words)
            for lang, n in found.items():
                n.pop(b".", None)
                n[None] = sum(n.values())
                words = pa.array(list(n), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(block, len(words)), pa.repeat(pa.scalar(lang), len(words)), words, pa.array(list(n.values()), pa.int64())], names=["block", "lang", "word", "n"])


def numbered(rows: DataFrame) -> DataFrame:
    """A written table of rows (block, lang, word, f) with id: 0, 1, ... for the distinct words by falling f, then lang and word.

    Rows are cut into ranges; the numbers of words of the ranges before, one number for
    each task of the sort, give each its first id.
    """
    spark = rows.sparkSession
    order = [F.desc("f"), F.asc("lang"), F.asc("word")]
    ranged = written(spark, rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = {r.part: r.n for r in ranged.groupBy("part").agg(F.count_distinct("lang", "word").alias("n")).collect()}
    first, before = [], 0
    for part in range(max(sizes, default=-1) + 1):
        first.append(before)
        before += sizes.get(part, 0)
    inside = F.dense_rank().over(Window.partitionBy("part").orderBy(*order))
    return written(spark, ranged.withColumn("id", F.get(F.lit(first or [0]).cast("array<long>"), F.col("part")) + inside - 1).drop("part"))


def fragments(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pivot, by its place in ids (-1: no frequent word): the words left and right of it that belong to its fragment."""
    pad = np.full(REACH, -1, ids.dtype)
    wide = np.concatenate([pad, ids, pad])
    at = np.arange(REACH, REACH + len(ids))
    left, right = np.zeros(len(ids), np.int8), np.zeros(len(ids), np.int8)
    for side, count in ((-1, left), (1, right)):
        on = ids >= 0
        for d in range(1, LONGEST):
            near = wide[at + side * d]
            on = on & (near >= 0) & ((near < ids) if side < 0 else (near <= ids))
            count += on
    return left, right


def packed_fragments(ids: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> bytes:
    """The fragments around the places at, as their shapes and words; the words' bytes of equal weight side by side."""
    left, right = left[at], right[at]
    sizes = left.astype(np.int64) + right + 1
    flat = ids[np.repeat(at - left - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
    planes = flat.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress((left * LONGEST + right).astype(np.uint8).tobytes() + planes.tobytes(), 1)


def opened(blob: bytes, n: int) -> np.ndarray:
    """The words of n fragments, n x (2 * REACH + 1), -1 where there is none."""
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    shape = raw[:n]
    flat = np.ascontiguousarray(raw[n:].reshape(8, -1).T).view("<i8")[:, 0]
    left, right = shape // LONGEST, shape % LONGEST
    out = np.full((n, 2 * REACH + 1), -1, np.int64)
    col = np.arange(2 * REACH + 1)
    out[(col >= REACH - left[:, None]) & (col <= REACH + right[:, None])] = flat
    return out


def _fragments(buckets: int):
    def cut(packed: pa.Table, known: pa.Table) -> pa.Table:
        """Rows of one block: bucket, whole (whether it holds all of its pivots' fragments), n and the n fragments."""
        vocab: dict[str, dict[bytes, int]] = {}
        own, f = known["id"].to_numpy(), known["f"].to_numpy()
        for lang, word, i in zip(known["lang"].to_pylist(), known["word"].cast(pa.binary()).to_pylist(), own.tolist(), strict=True):
            vocab.setdefault(lang, {})[word] = i
        block = packed["block"][0].as_py() if packed.num_rows else 0
        rows: list[np.ndarray] = [np.full(1, -1, np.int64)]
        for blob in packed["packed"]:
            for lang, words in _unpacked(blob):
                rows += [np.fromiter(map(vocab.get(lang, {}).get, words, repeat(-1)), np.int64, len(words)), rows[0]]
        del vocab
        ids = np.concatenate(rows)
        left, right = fragments(ids)
        # Buckets from 0 hold several pivots, those below 0 a shard of one.
        order = np.argsort(own)
        own, shards = own[order], -(-f[order] // SHARD)
        target = np.where(shards > 1, -1 - (own * MANY + block % MANY % np.maximum(shards, 1)), own % buckets)
        pivots = np.flatnonzero(left + right)
        to = target[np.searchsorted(own, ids[pivots])]
        order = np.argsort(to, kind="stable")
        pivots, to = pivots[order], to[order]
        cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else [], len(to)).astype(int)
        made = [(int(to[lo]), bool(to[lo] >= 0), hi - lo, packed_fragments(ids, pivots[lo:hi], left, right)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.Table.from_pylist([dict(zip(("bucket", "whole", "n", "frags"), m, strict=True)) for m in made], pa.schema([("bucket", pa.int64()), ("whole", pa.bool_()), ("n", pa.int64()), ("frags", pa.binary())]))

    return cut


def mine(frags: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of 2 to LONGEST words around the middle column, and how often each occurs, if least times or more.

    A phrase with l words left and r right of its pivot grows from the one with a word
    less; only fragments in which that one is frequent are looked at.
    """
    _, start = np.unique(frags[:, REACH], return_inverse=True)
    level = {(0, 0): (np.arange(len(frags)), start.astype(np.int64))}
    for size in range(2, LONGEST + 1):
        grown = {}
        for l in range(size):
            r = size - 1 - l
            rows, code = level.get((l, r - 1) if r else (l - 1, 0), (None, None))
            if rows is None or not len(rows):
                continue
            word = frags[rows, REACH + r if r else REACH - l]
            has = word >= 0
            rows, code, word = rows[has], code[has], word[has]
            if not len(rows):
                continue
            found, word = np.unique(word, return_inverse=True)
            _, first, code, times = np.unique(code * len(found) + word, return_index=True, return_inverse=True, return_counts=True)
            often = times >= least
            if often.any():
                yield frags[rows[first[often]], REACH - l : REACH + r + 1], times[often]
            keep = often[code]
            grown[(l, r)] = (rows[keep], code[keep])
        level = grown


def _mine(least: int):
    def solve(held: list[np.ndarray], low: int) -> Iterator[pa.RecordBatch]:
        for grams, times in mine(np.concatenate(held), low):
            flat = pa.array(np.ascontiguousarray(grams).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, grams.shape[1], dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([lists, pa.array(times.astype(np.int64))], names=["gram", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last, low = None, least
        for b in batches:
            for bucket, whole, n, blob in zip(b["bucket"].to_pylist(), b["whole"].to_pylist(), b["n"].to_pylist(), b["frags"], strict=True):
                if held and bucket != last:
                    yield from solve(held, low)
                    held = []
                held.append(opened(blob.as_py(), n))
                last, low = bucket, least if whole else 1  # what a shard finds is a part of the count
        if held:
            yield from solve(held, low)

    return run


def phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: vocabulary (lang, word, f, id) of frequent words, totals (lang, n), phrases (gram of ids, a) of 2 to LONGEST words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text is not null")
    packed = written(spark, rows.mapInArrow(_pack, "block long, packed binary"))
    asked = packed.mapInArrow(_words, "block long, lang string, word string, n long")
    counted = written(spark, asked.withColumn("f", F.sum("n").over(Window.partitionBy("lang", "word"))).filter(F.col("word").isNull() | (F.col("f") >= least)))  # a word has a row for each block
    totals = written(spark, counted.filter("word is null").select("lang", F.col("f").alias("n")).distinct())
    known = numbered(counted.filter("word is not null").select("block", "lang", "word", "f"))
    vocab = written(spark, known.drop("block").distinct())
    shared = vocab.filter(F.col("f") <= SHARD).agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    cut = packed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_fragments(max(1, -(-shared // HELD))), "bucket long, whole boolean, n long, frags binary")
    found = cut.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_mine(least), "gram array<long>, a long")
    return vocab, totals, written(spark, found.groupBy("gram").agg(F.sum("a").alias("a")).filter(F.col("a") >= least))


#: floor(1000 * a * n / (l * r)); counts of up to 16 digits, whose products fit into 38.
SCORE = "cast(1000 as decimal(4, 0)) * cast(a as decimal(16, 0)) * cast(n as decimal(16, 0)) div (cast(l as decimal(16, 0)) * cast(r as decimal(16, 0)))"


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each lang."""
    spark = docs.sparkSession
    vocab, totals, found = phrases(docs, least)
    # A candidate inside a longer one as frequent is inside one that is a single word longer and as frequent.
    inner = found.filter(F.size("gram") > 2).select(F.explode(F.array(F.expr("slice(gram, 1, size(gram) - 1)"), F.expr("slice(gram, 2, size(gram) - 1)"))).alias("gram"), "a").distinct()
    kept = found.join(inner, ["gram", "a"], "left_anti")
    counts = found.select("gram", F.col("a").alias("f")).unionByName(vocab.select(F.array("id").alias("gram"), "f"))
    cuts = kept.select(F.col("gram").alias("whole"), "a", F.expr("explode(sequence(1, size(gram) - 1))").alias("k"))
    parts = cuts.select("whole", "a", "k", F.expr("explode(array(struct(0 as side, slice(whole, 1, k) as gram), struct(1 as side, slice(whole, k + 1, size(whole)) as gram)))").alias("p")).select("whole", "a", "k", "p.side", "p.gram")
    sides = parts.join(counts, "gram").groupBy("whole", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    words = kept.select("gram", F.posexplode("gram").alias("pos", "id")).join(vocab.select("id", "lang", "word"), "id")
    spelt = words.groupBy("gram").agg(F.first("lang").alias("lang"), F.expr("concat_ws(' ', transform(array_sort(collect_list(struct(pos, word))), x -> x.word))").alias("phrase"))
    scored = sides.join(spelt.withColumnRenamed("gram", "whole"), "whole").join(totals, "lang")
    scored = scored.withColumn("score", F.expr(SCORE))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "n", "c.score", "c.l", "c.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = lowest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("no", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("no") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return near.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS g
  FROM runs, (SELECT CAST(range AS BIGINT) AS m FROM range(1, 6)) WHERE len(w) >= m),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE m = 1 GROUP BY lang),
f AS (SELECT lang, g, m, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, g, m, f AS a, string_split(g, ' ') AS w FROM f WHERE m >= 2),
inner_ AS (
  SELECT DISTINCT c.lang, array_to_string(w[s : s + k - 1], ' ') AS g
  FROM cand c, range(2, 5) AS x(k), range(1, 5) AS y(s), f
  WHERE k < c.m AND s + k - 1 <= c.m AND f.lang = c.lang AND f.g = array_to_string(w[s : s + k - 1], ' ') AND 100 * c.a >= 100 * f.f),
cuts AS (
  SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cand c, range(1, 5) AS t(k), f x, f y, totals
  WHERE k < c.m AND x.lang = c.lang AND y.lang = c.lang AND totals.lang = c.lang
    AND x.g = array_to_string(w[1 : k], ' ') AND y.g = array_to_string(w[k + 1 : c.m], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank
  FROM lowest WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = lowest.lang AND i.g = lowest.g))
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

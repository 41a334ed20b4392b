"""Importance resampling of documents towards a target distribution.

Documents are bags of hashed features: runs of 1 to 2 words, by the crc32 of their bytes
modulo BUCKETS.  A bucket's gain is the smoothed log ratio of its share of the target's
features to its share of all documents' features; a document's weight is the mean gain
of its features, looked up in one array of BUCKETS numbers.  Weight plus Gumbel noise,
drawn from the document's id, gives integer scores: the highest ones are a sample
without replacement in proportion to exp(weight / 1000).

The draw needs no sort of all documents.  Scores are counted exactly; sums over the
counts from the highest score down give every score's first rank and the score at which
the draw ends, and documents are numbered by doc_id within each score that is drawn.

Cases: null, empty and blank texts have no features and weight 0, and are too short to be
drawn.  Long texts are read in slices.  Equal scores go to smaller doc_ids; rows with one
doc_id and score are drawn one by one; null doc_ids come last and all have the noise of
an empty id.  Without features or target every gain is 0 but for the smoothing.  Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Bytes of a text that are split into words at once.
SLICE = 1 << 20
#: Scores of one block of the histogram; blocks are summed first.
BLOCK = 256

#: Lower-cases A-Z; every other ASCII byte that is no letter or digit becomes a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def feature_buckets(text: str | None, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """Slice by slice, the number of words and the buckets of the features that end in it."""
    plain = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN)
    at, last = 0, None
    while at < len(plain):
        end = plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        words = plain[at:end].split()
        at = end
        if not words:
            continue
        before = [last, *words[:-1]] if last is not None else words[:-1]
        pairs = map(b"%b %b".__mod__, zip(before, words if last is not None else words[1:], strict=True))
        last = words[-1]
        yield len(words), np.fromiter(map(zlib.crc32, [*words, *pairs]), np.int64) % buckets


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("text").cast("string").alias("text"))


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features of all texts in each bucket.  A task sends no more than one number a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for t in b["text"]:
                for _, found in feature_buckets(t.as_py(), buckets):
                    n += np.bincount(found, minlength=buckets)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(n[has])], names=["bucket", "n"])

    out = [0] * buckets
    for r in _texts(rows).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over its share of the source."""
    m, s, t = len(source), sum(source), sum(target)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + m) / ((a + 1) * (t + m)))) for a, b in zip(source, target, strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b["text"]:
                w = n = total = 0
                for words, found in feature_buckets(t.as_py(), len(gain)):
                    w, n, total = w + words, n + len(found), total + int(gain[found].sum())
                rows.append((w, n, total // n if n else 0))
            made = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([b["doc_id"], *made], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g) for Gumbel noise g drawn from the id by sha256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def first_ranks(scores: DataFrame) -> DataFrame:
    """score, n, above: how many rows have each score, and how many a higher one.

    Scores are integers within some ten thousands; blocks of them are summed first, so
    that the one window without a key holds a row for each block.
    """
    by_score = scores.groupBy("score").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("score") / BLOCK))
    higher = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = by_score.groupBy("block").agg(F.sum("n").alias("size")).select("block", F.coalesce(F.sum("size").over(higher), F.lit(0)).alias("before"))
    inside = Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return by_score.join(blocks, "block").select("score", "n", (F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("above"))


def drawn(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds rank (1, 2, ... by score, then doc_id) to the rows that are drawn, null to the others.  scored is read several times: a table."""
    spark = scored.sparkSession
    eligible = scored.filter(F.col("n_words") >= min_words)
    ranks = written(spark, first_ranks(eligible))
    total = ranks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = percent * total // 100
    cutoff = ranks.filter(F.col("above") < size).agg(F.min("score")).first()[0] if size else None
    if cutoff is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    in_reach = (F.col("n_words") >= min_words) & (F.col("score") >= cutoff)
    number = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    top = scored.filter(in_reach).withColumn("no", number).join(ranks.select("score", "above"), "score")
    rank = F.col("above") + F.col("no")
    top = top.select(*scored.columns, F.when(rank <= size, rank).cast("long").alias("rank"))
    return top.unionByName(scored.filter(~in_reach).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of docs; rank is null where a row isn't drawn."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weights(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(written(docs.sparkSession, scored), percent, min_words)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 byte by byte over the hex form of a feature, with a table made from the polynomial 0xEDB88320.
ORACLE_SQL = r"""
WITH RECURSIVE
bits(b, k, v) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
words AS (
  SELECT 'd' AS part, rowid AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
  UNION ALL
  SELECT 't', item_id, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
feats AS (
  SELECT part, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
kinds AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM feats)),
coded AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, CAST(len(h) / 2 AS BIGINT) + 1), lambda i: CAST(('0x' || h[2 * i - 1 : 2 * i]) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM kinds, crc),
counted AS (SELECT bucket, count(*) FILTER (part = 'd') AS s, count(*) FILTER (part = 't') AS t FROM feats JOIN coded USING (f) GROUP BY bucket),
sums AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counted),
gain AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (all_s + 10000))::DOUBLE / ((s + 1) * (all_t + 10000))::DOUBLE)) AS BIGINT) AS g FROM counted, sums),
weighed AS (SELECT r, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS total FROM feats JOIN coded USING (f) JOIN gain USING (bucket) WHERE part = 'd' GROUP BY r),
scored AS (
  SELECT w.r, w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST(('0x' || sha256('7:' || coalesce(CAST(w.doc_id AS VARCHAR), ''))[1:8]) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM words w LEFT JOIN weighed USING (r) WHERE w.part = 'd'),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS k, (25 * count(*) OVER ()) // 100 AS size FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score,
  CAST(CASE WHEN k <= size THEN k END AS BIGINT) AS rank
FROM scored LEFT JOIN ranked USING (r)
"""

"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is of n-grams of ORDER characters, as they are (no classes), one model per
language and one of all languages together.  Counts of all trusted text, continuation
counts, discounts and interpolation weights come from grouped counts, and every n-gram
of the documents gets its probability by joins with them, sharded by hash of model and
n-gram.  Nothing of this is sent to the driver or broadcast by hand, and nothing bounds
it: counts grow with the text.

So that the joins do not move a row per character, documents are taken in blocks of
BLOCK bytes as they are read: a block asks once for each n-gram it has.  Its answers and
its texts (compressed) then meet in one task, which gives each document its score, its
mean negative log2 probability a character (log2 of its perplexity).

Thresholds come from quantiles of trusted documents held out from training, by language
and length class: QUANTILE of their scores and MARGIN times its distance from the
median.  Rejected are documents above it.

Cases: null and empty texts have no score and are kept.  A null language is one like any
other; languages without a model of their own, or with fewer than MIN_HELD held-out
documents in a length class, are judged by the model or thresholds of all.  Labels that
are null are passed over; of several labels of one document the lowest counts.  Without
trusted text everything is kept.  U+0000 is read as U+0001.  Repeated rows are judged
each; other columns pass through kept_documents unchanged; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_hash, written

ORDER = 4
#: MARGIN is chosen from the labels for a rejection of 2.5 % of trusted text (2.4 % on 10,000 documents; 4.5 % at 0, 0.6 % at 4).
QUANTILE, MARGIN, MIN_HELD, HELD_OUT = 0.95, 0.5, 30, 5
ALL = "*"
#: What stands before a text.
START = "\n" * (ORDER - 1)
#: Bytes of text whose n-grams are asked for together; a longer text is a block of its own.
BLOCK = 16 << 20
#: N-grams of a block are numbered and counted in slices of so many, so that a worker holds a few MB a step.
SLICE = 1 << 20
#: Compression of packed texts: a quarter less to shuffle than level 1, for some 30 CPU seconds a GB.
LEVEL = 7
#: Rows of a batch that goes back to Spark.
ROWS = 1 << 16
#: Alphabets up to this size let four characters be one number of 64 bits.
NUMBERED = 65535
#: N-grams are looked up in an array of first by second halves of up to so many places (8 bytes each); beyond, by binary search.
DENSE = 1 << 23


# --- n-grams ---------------------------------------------------------------------------


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, each after START; which n-grams end inside a text; and how many each text has."""
    c = np.frombuffer((START + START.join(texts)).encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    c[c == 0] = 1
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    inside = np.ones(len(c) - ORDER + 1, dtype=bool)
    for at in (np.cumsum(sizes + ORDER - 1) - (ORDER - 1))[:-1]:
        inside[at : at + ORDER - 1] = False
    return c, inside, sizes


def codes(windows: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Of windows (n, ORDER) of code points: one number each, or, for large alphabets, the strings themselves."""
    if len(alphabet) > NUMBERED:
        return np.ascontiguousarray(windows, dtype="<u4").view(f"<U{ORDER}")[:, 0]
    number = np.zeros(0x110000, dtype=np.uint64)  # 0: not in the alphabet
    number[alphabet] = np.arange(1, len(alphabet) + 1, dtype=np.uint64)
    out = number[windows[:, 0]]
    for k in range(1, ORDER):
        out *= np.uint64(len(alphabet) + 1)
        out += number[windows[:, k]]
    return out


def sliced(c: np.ndarray, inside: np.ndarray, alphabet: np.ndarray) -> Iterator[np.ndarray]:
    """The codes of the n-grams that end inside a text, a slice at a time."""
    for lo in range(0, len(inside), SLICE):
        part = c[lo : lo + SLICE + ORDER - 1]
        yield codes(np.lib.stride_tricks.sliding_window_view(part, ORDER), alphabet)[inside[lo : lo + SLICE]]


def used(c: np.ndarray) -> np.ndarray:
    """The distinct code points, in order."""
    seen = np.zeros(0x110000, dtype=bool)
    for lo in range(0, len(c), SLICE):
        seen[c[lo : lo + SLICE]] = True
    return np.flatnonzero(seen).astype("<u4")


def tally(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of non-empty texts, and how often each occurs."""
    c, inside, _ = characters(texts)
    alphabet = used(c)
    parts = [np.unique(part, return_counts=True) for part in sliced(c, inside, alphabet)]
    found, at = np.unique(np.concatenate([part for part, _ in parts]), return_inverse=True)
    n = np.zeros(len(found), dtype=np.int64)
    np.add.at(n, at, np.concatenate([times for _, times in parts]))
    if found.dtype.kind != "U":
        base = np.uint64(len(alphabet) + 1)
        digits = [found // base ** np.uint64(ORDER - 1 - k) % base for k in range(ORDER)]
        found = np.stack([alphabet[d.astype(np.int64) - 1] for d in digits], axis=1).view(f"<U{ORDER}")[:, 0]
    return found, n


def model_key(lang: Column | str = "lang") -> Column:
    return F.concat(F.lit("="), F.coalesce(F.col(lang) if isinstance(lang, str) else lang, F.lit("\0")))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of a task in blocks of BLOCK bytes of text, with the number of each."""
    first, seen = TaskContext.get().partitionId() << 32, 0
    at, held = 0, []
    for b in batches:
        size = pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        number = (seen + np.cumsum(size) - size) // BLOCK
        seen += int(size.sum())
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                if held and number[lo] != at:
                    yield first | at, pa.Table.from_batches(held)
                    held = []
                at = int(number[lo])
                held.append(b.slice(lo, hi - lo))
    if held:
        yield first | at, pa.Table.from_batches(held)


def by_model(rows: pa.Table) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    """model, row numbers and texts of the non-empty texts of a block."""
    full = pc.fill_null(pc.greater(pc.binary_length(rows["text"]), 0), False).to_pylist()
    at: dict[str, list[int]] = {}
    for i, (m, some) in enumerate(zip(rows["model"].to_pylist(), full, strict=True)):
        if some:
            at.setdefault(m, []).append(i)
    for m, own in at.items():
        yield m, np.array(own), rows["text"].take(pa.array(own)).to_pylist()


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, rows in blocks(batches):
        for m, _, texts in by_model(rows):
            grams, n = tally(texts)
            for lo in range(0, len(n), ROWS):
                some = pa.array(grams[lo : lo + ROWS].tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(block, pa.int64()), len(some)), pa.repeat(pa.scalar(m, pa.string()), len(some)), some, pa.array(n[lo : lo + ROWS])], names=["block", "model", "gram", "n"])


def tallied(rows: DataFrame) -> DataFrame:
    """block, model, gram, n: the distinct n-grams of every block of rows (model, text)."""
    return rows.mapInArrow(_tally, "block long, model string, gram string, n long")


# --- training --------------------------------------------------------------------------


def counts(trusted: DataFrame) -> DataFrame:
    """model, gram, n over all trusted text, with the model of all languages."""
    own = tallied(trusted).groupBy("model", "gram").agg(F.sum("n").alias("n"))
    return own.unionByName(own.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("model"), "gram", "n"))


def kneser_ney(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """p: (model, gram, p), the discounted share of each seen gram of 1 to ORDER characters; g: (model, context, g), the weight of the next lower order."""
    level = counted.select("model", F.lit(ORDER).alias("k"), "gram", "n")
    every = level
    for k in range(ORDER - 1, 0, -1):
        # Lower orders count the distinct characters before a gram.
        level = level.groupBy("model", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")).select("model", F.lit(k).alias("k"), "gram", "n")
        every = every.unionByName(level)
    every = every.withColumn("context", F.expr("substring(gram, 1, k - 1)"))
    times = [F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"t{i}") for i in (1, 2, 3, 4)]
    d = every.groupBy("model", "k").agg(*times)
    y = F.coalesce(F.col("t1") / F.nullif(F.col("t1") + 2 * F.col("t2"), F.lit(0.0)), F.lit(0.5))
    discount = lambda i: F.greatest(F.lit(0.05), F.least(F.lit(float(i) - 0.05), F.coalesce(i - (i + 1) * y * F.col(f"t{i + 1}") / F.nullif(F.col(f"t{i}"), F.lit(0.0)), F.lit(0.5 * i))))
    d = d.select("model", "k", *(discount(i).alias(f"d{i}") for i in (1, 2, 3)))
    contexts = every.groupBy("model", "k", "context").agg(F.sum("n").alias("all"), *(F.count(F.when(F.col("n") == i if i < 3 else F.col("n") >= 3, 1)).alias(f"n{i}") for i in (1, 2, 3)))
    contexts = contexts.join(d, ["model", "k"])
    gamma = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("all")
    own = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    p = every.join(contexts.select("model", "k", "context", "all", "d1", "d2", "d3"), ["model", "k", "context"])
    return p.select("model", "gram", ((F.col("n") - own) / F.col("all")).alias("p")), contexts.select("model", "context", gamma.alias("g"))


# --- scoring ---------------------------------------------------------------------------


def log_probabilities(asked: DataFrame, counted: DataFrame) -> DataFrame:
    """asked (model, gram) with log2p under the model, or that of all languages where there is none.

    Characters never seen in trusted text share one place in the uniform distribution
    that ends the interpolation.  Without trusted text everything has log2p 0.
    """
    spark = asked.sparkSession
    p, g = (written(spark, t) for t in kneser_ney(counted))
    seen = p.filter((F.col("model") == ALL) & (F.length("gram") == 1)).count()
    if not seen:
        return asked.withColumn("log2p", F.lit(0.0))
    models = g.filter("context = ''").select("model", (F.col("g") / (seen + 1)).alias("base"))
    of_all = models.filter(F.col("model") == ALL).first()["base"]
    rows = asked.join(models.withColumn("use", F.col("model")), "model", "left")
    rows = rows.select("model", "gram", F.coalesce("use", F.lit(ALL)).alias("use"), F.coalesce("base", F.lit(of_all)).alias("base"), F.explode(F.array(*map(F.lit, range(1, ORDER + 1)))).alias("k"))
    # One row per order; the empty context's weight is in base, so its rows look for what is no context.
    rows = rows.withColumn("part", F.expr("right(gram, k)")).withColumn("before", F.when(F.col("k") == 1, F.col("gram")).otherwise(F.expr("left(part, k - 1)")))
    rows = rows.join(p.withColumnsRenamed({"model": "use", "gram": "part"}), ["use", "part"], "left")
    rows = rows.join(g.withColumnsRenamed({"model": "use", "context": "before"}), ["use", "before"], "left")
    at = lambda c, k, other: F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(other))
    each = rows.groupBy("model", "gram").agg(F.max("base").alias("p0"), *(at("p", k, 0.0).alias(f"p{k}") for k in range(1, ORDER + 1)), *(at("g", k, 1.0).alias(f"g{k}") for k in range(2, ORDER + 1)))
    total = F.col("p0") + F.col("p1")
    for k in range(2, ORDER + 1):
        total = F.col(f"p{k}") + F.col(f"g{k}") * total
    return each.select("model", "gram", F.log2(total).alias("log2p"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, rows in blocks(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
            out.write_table(rows)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "packed"])


def ranks(found: np.ndarray, size: int) -> np.ndarray:
    """For each number below size its rank, from 1, among those found, or 0."""
    out = np.zeros(int(size), dtype=np.int64)
    some = np.unique(found).astype(np.int64)
    out[some] = np.arange(1, len(some) + 1)
    return out


def mean_bits(texts: list[str], grams: list[str], log2p: np.ndarray) -> np.ndarray:
    """The score of each of the non-empty texts, by the log2 probabilities of their n-grams."""
    known = np.array(grams, dtype=f"<U{ORDER}").view("<u4").reshape(-1, ORDER)
    alphabet = used(known.reshape(-1))
    c, inside, sizes = characters(texts)
    keys = codes(known, alphabet)
    each = np.empty(int(sizes.sum()))
    at = 0
    half = np.uint64((len(alphabet) + 1) ** (ORDER // 2))
    dense = keys.dtype.kind != "U" and half <= DENSE and (left := ranks(keys // half, half)).max() * (right := ranks(keys % half, half)).max() <= DENSE
    if dense:
        full = np.full((int(left.max()) + 1, int(right.max()) + 1), np.nan)  # row and column 0: pairs not seen
        full[left[keys // half], right[keys % half]] = log2p
    else:
        order = np.argsort(keys)
        keys, log2p = keys[order], log2p[order]
    for asked in sliced(c, inside, alphabet):
        if dense:
            found = full[left[asked // half], right[asked % half]]
        else:
            place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            found = np.where(keys[place] == asked, log2p[place], np.nan)
        each[at : at + len(found)] = found
        at += len(found)
    if np.isnan(each).any():
        raise RuntimeError("blocks differ between two reads of the documents: pass a table whose rows keep their order")
    return np.round(-np.add.reduceat(each, np.cumsum(sizes) - sizes) / sizes, 9)


SCORED = "doc_id long, lang string, text_hash long, n_chars long, model string, score double"


def _score(packed: pa.Table, known: pa.Table) -> pa.Table:
    out = []
    for blob in packed["packed"]:
        rows = pa.ipc.open_stream(blob.as_buffer()).read_all()
        score = np.full(rows.num_rows, np.nan)
        for m, at, texts in by_model(rows):
            mine = known.filter(pc.equal(known["model"], m))
            if not mine.num_rows:
                raise RuntimeError("blocks differ between two reads of the documents: pass a table whose rows keep their order")
            score[at] = mean_bits(texts, mine["gram"].to_pylist(), mine["log2p"].to_numpy())
        out.append(pa.table([rows["doc_id"], rows["lang"], rows["text_hash"], rows["n_chars"], rows["model"], pa.array(score, from_pandas=True)], names=["doc_id", "lang", "text_hash", "n_chars", "model", "score"]))
    return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64())], names=["doc_id", "lang", "text_hash", "n_chars", "model", "score"])


def scored(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """A written table of one row per document: doc_id, lang, text_hash, n_chars, model, score.

    docs is read twice, and its rows must come in the same order each time: a table.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_hash(text).alias("text_hash"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), model_key(F.col("lang").cast("string")).alias("model"), text.alias("text"))
    asked = written(spark, tallied(rows.select("model", "text")).drop("n"))
    logs = written(spark, log_probabilities(asked.select("model", "gram").distinct(), counted))
    known = asked.join(logs, ["model", "gram"])
    packed = rows.mapInArrow(_pack, "block long, packed binary")
    return written(spark, packed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_score, SCORED))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic."""
    ok = (F.col("quality").cast("int") == 1) & (F.coalesce(F.col("toxic").cast("int"), F.lit(0)) == 0)
    rows = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("__id"))
    return rows.agg(F.min(ok).alias("ok")).filter("ok").select("__id")


def held_out(id_: str) -> Column:
    return F.pmod(F.xxhash64(id_, F.lit(1)), F.lit(HELD_OUT)) == 0


def thresholds(held: DataFrame) -> DataFrame:
    """model, len -> held, threshold, from held-out trusted scores; model ALL and len -1 stand for all.

    Scores are rounded to thousandths, so exact quantiles need no more than some
    thousand distinct values a group.
    """
    rows = held.filter("score is not null").select("model", "len", F.round("score", 3).alias("x"))
    each = rows.select(F.explode(F.array(F.struct("model", "len"), F.struct(F.lit(ALL).alias("model"), "len"), F.struct("model", F.lit(-1).alias("len")), F.struct(F.lit(ALL).alias("model"), F.lit(-1).alias("len")))).alias("g"), "x")
    q = each.groupBy("g.model", "g.len").agg(F.count("*").alias("held"), F.percentile("x", F.array(F.lit(0.5), F.lit(QUANTILE))).alias("q"))
    return q.select("model", "len", "held", (F.col("q")[1] + MARGIN * F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(0.02))).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, text_hash, score, threshold, kept: one row per document."""
    spark = docs.sparkSession
    ids = written(spark, trusted_ids(labels))
    train = docs.select(F.col("doc_id").cast("long").alias("__id"), model_key(F.col("lang").cast("string")).alias("model"), F.col("text").cast("string").alias("text")).join(ids.filter(~held_out("__id")), "__id")
    counted = written(spark, counts(train.select("model", "text")))
    rows = scored(docs, counted)
    rows = rows.withColumn("len", F.least(F.floor(F.log2(F.greatest("n_chars", F.lit(1)).cast("double")) / 2), F.lit(5)).cast("int"))
    held = rows.join(ids.filter(held_out("__id")), F.col("doc_id") == F.col("__id"), "left_semi")
    limits = written(spark, thresholds(held).filter((F.col("held") >= MIN_HELD) | ((F.col("model") == ALL) & (F.col("len") == -1))))
    of_all = {r["len"]: r["threshold"] for r in limits.filter(F.col("model") == ALL).collect()}  # 7 at most
    own = limits.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("len", "threshold"))).alias("own"))  # 7 at most a model
    shared = F.lit(None).cast("double")
    for n in range(6):
        if n in of_all:
            shared = F.when(F.col("len") == n, F.lit(of_all[n])).otherwise(shared)
    out = rows.join(written(spark, own), "model", "left")
    threshold = F.coalesce(F.col("own")[F.col("len")], shared, F.col("own")[F.lit(-1)], F.lit(of_all.get(-1)).cast("double"))
    return out.select("doc_id", "lang", "text_hash", "score", threshold.alias("threshold")).withColumn("kept", F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps; docs is a table (see scored)."""
    rejected = written(docs.sparkSession, classify(docs, labels).filter("not kept").select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), F.col("text_hash").alias("__hash")).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("lang").cast("string").eqNullSafe(F.col("__lang")) & (text_hash(F.col("text").cast("string")) == F.col("__hash"))
    return docs.join(rejected, same, "left_anti")


def op1_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", F.col("score").alias("log2_perplexity"), "threshold", "kept")

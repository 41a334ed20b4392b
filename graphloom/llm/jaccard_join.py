"""Exact Jaccard join of word shingle sets, skipping by relations between sets.

Documents with equal sets are one class.  Shingles are put in one order for all sets,
common ones last; two similar sets share a shingle among the first ones of each (the
prefix), so prefixes are indexed by shingle.  An index list is cut into blocks of equal
set size and position of the shingle.  Size and position bound the overlap of any two
sets of two blocks, so whole blocks are skipped against each other.

Answers are derived from those of similar sets.  First each set is compared with the hub
of most of its lists, the set that shares most shingles there; then with one leader of
each of its blocks, and leaders with those of the next blocks.  Links found are closed to
components.  Then blocks with sets of different components are compared by
their sets' leaders alone, and components of similar leaders are joined.  What is still
apart follows from overlap(x, y) <= overlap(leader x, leader y) + |x - leader x| +
|y - leader y|: only sets for which that reaches the threshold are compared themselves.
Sets of one component are not compared again.

The order's common shingles are those that repeat within batches of documents, no more than
COMMON of them.  They steer how much is compared; any order gives the same links.

Cases: null, empty and blank texts have the empty set and are linked with nothing, not
even with each other; texts of fewer than five words are one shingle.  Null doc_ids are
passed over in component_id, which is null if a component has no other; repeated rows are
returned each; other columns are ignored; an empty table gives no rows.  Shingles and
sets are told apart by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_hash, written
from .simhash import components

#: Least similarity, as a fraction.
LEAST, OF = 80, 100
#: At most so many common shingles are put last in the order (8 bytes each in every task).
COMMON = 1 << 20
#: A shingle is common from so many repeats in one batch of documents on.
REPEATS = 8
#: Tasks over which a common shingle's entries are dealt.
DEALT = 64
#: Bits of the filter of documents whose sets are made anew; beyond that many it lets more through, which a join drops.
FILTER, PART = 1 << 24, 1 << 15
SHINGLE, SEED = 5, 42
#: Odd factors, by which the hashes of a shingle's words are weighed.
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Hashes(dict):
    """Hashes of words, kept for some hundred thousand of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word, SEED)
        return h


def shingles(text: str | None, known: Hashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words, or of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    h = np.full(len(words) - size + 1, np.uint64(size))
    for i in range(size):
        h ^= h >> np.uint64(29)
        h = (h + each[i : i + len(h)]) * _FACTORS[i]
    h ^= h >> np.uint64(32)
    return np.unique(h * _FACTORS[0])


def class_of(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.astype("<u8").tobytes(), SEED)).astype(np.int64))


def needed(n: str, m: str) -> str:
    """SQL: the least overlap of similar sets of sizes n and m."""
    return f"({LEAST} * ({n} + {m}) + {OF + LEAST - 1}) div {OF + LEAST}"


def prefix_length(n: int) -> int:
    """How many first shingles of a set of n must hold one of any similar set: n less the least overlap, plus one."""
    return n - -(-LEAST * n // OF) + 1


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (token null), and one for each shingle that repeats in a batch (doc_id null)."""
    known = Hashes()
    for b in batches:
        sizes, classes, once = [], [], {}
        for t in b["text"]:
            grams = shingles(t.as_py(), known)
            sizes.append(len(grams))
            classes.append(class_of(grams))
            once[classes[-1]] = grams
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["hash"], pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.nulls(len(sizes), pa.int64())], names=["doc_id", "hash", "n", "cls", "token"])
        found, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *once.values()]), return_counts=True)
        often = times >= REPEATS
        m = int(often.sum())
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(times[often].astype(np.int64)), pa.nulls(m, pa.int64()), pa.array(found[often].view(np.int64))], names=["doc_id", "hash", "n", "cls", "token"])


def common_shingles(rows: DataFrame) -> np.ndarray:
    """The commonest shingles, at most COMMON, in the order that puts the rarest first; rows as of _read."""
    counted = rows.filter("token is not null").groupBy("token").agg(F.sum("n").alias("n"))
    ranked = written(rows.sparkSession, counted)
    steps = ranked.groupBy(F.floor(F.log2("n")).alias("step")).count().orderBy(F.desc("step")).collect()  # 64 at most
    least, total = 0, 0
    for r in steps:
        if total + r["count"] > COMMON:
            least = 2.0 ** (r["step"] + 1)
            break
        total += r["count"]
    kept = ranked.filter(F.col("n") >= least).toArrow()
    token, n = kept["token"].to_numpy().view(np.uint64), kept["n"].to_numpy()
    return token[np.lexsort((token, n))]


def ordered_prefix(grams: np.ndarray, common: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of a sorted set, and where common shingles begin in it.  common: sorted, with their places in the order."""
    k = prefix_length(len(grams))
    if not len(common):
        return grams[:k], k
    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
    last = common[at] == grams
    rest = grams[~last][:k]
    late = at[last]
    late = late[np.argsort(place[late])][: k - len(rest)]
    return np.concatenate([rest, common[late]]), len(rest)


def _index(common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.sort(common)
        rank = np.empty(len(common), np.int64)
        rank[np.searchsorted(table_, common)] = np.arange(len(common))
        seen: set[int] = set()
        known = Hashes()
        for b in batches:
            tokens, classes, sizes, places, dealt = [], [], [], [], []
            for t in b["text"]:
                grams = shingles(t.as_py(), known)
                c = class_of(grams)
                if not len(grams) or c in seen:
                    continue
                seen.add(c)
                head, late = ordered_prefix(grams, table_, rank)
                tokens.append(head)
                dealt.append(np.where(np.arange(len(head)) < late, -1, c % DEALT))
                classes.append(np.full(len(head), c))
                sizes.append(np.full(len(head), len(grams)))
                places.append(np.arange(len(head)))
            if tokens:
                made = [np.concatenate(tokens).view(np.int64), *(np.concatenate(x).astype(np.int64) for x in (classes, sizes, places)), np.concatenate(dealt).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["token", "cls", "n", "pos", "dealt"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Hashes()
    for b in batches:
        for t in b["text"]:
            grams = shingles(t.as_py(), known)
            yield pa.RecordBatch.from_arrays([pa.array([class_of(grams)]), pa.array([grams.view(np.int64)], pa.list_(pa.int64()))], names=["cls", "grams"])


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the number of shingles that both have."""
    x = sets.select(F.col("cls").alias("a"), F.col("grams").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("grams").alias("y"))
    return pairs.join(x, "a").join(y, "b").withColumn("both", F.size(F.array_intersect("x", "y")).cast("long")).drop("x", "y")


def compatible(n: str, pos: str, m: str, qos: str) -> str:
    """SQL: whether sets of sizes n and m that share a shingle at these places, and none before, can be similar."""
    return f"({OF} * least({n}, {m}) >= {LEAST} * greatest({n}, {m}) and 1 + least({n} - {pos}, {m} - {qos}) - 1 >= {needed(n, m)})"


def within_reach(pairs: DataFrame, heads: DataFrame, least: str) -> DataFrame:
    """The pairs (a, b, ...) that can have so much in common (SQL) by what their prefixes share.

    Of two sets, the one whose prefix ends first has no other shingle in common there:
    the overlap is at most the shared part and what lies behind that prefix.
    """
    x = heads.select(F.col("cls").alias("a"), F.col("tokens").alias("x"), F.col("n").alias("na"))
    y = heads.select(F.col("cls").alias("b"), F.col("tokens").alias("y"), F.col("n").alias("nb"))
    behind = f"({LEAST} * greatest(na, nb) + {OF - 1}) div {OF} - 1"
    both = pairs.join(x, "a").join(y, "b").withColumn("c", F.size(F.array_intersect("x", "y")))
    return both.filter(f"c + {behind} >= {least}").select(*pairs.columns, "na", "nb")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b, n, m), those that are similar, with the size of their overlap."""
    return overlaps(pairs.select("a", "b", "n", "m").distinct(), sets).filter(f"both >= {needed('n', 'm')}")


def _index_lists(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """A written table of index entries token, cls, n, pos of shingles that several sets have in their prefixes.

    A common shingle's entries are dealt out by set, so that its list is never in one task.
    """
    index = rows.select("text").mapInArrow(_index(common), "token long, cls long, n long, pos long, dealt int")
    whole = Window.partitionBy("token", "dealt")
    several = index.withColumn("low", F.min("cls").over(whole)).withColumn("high", F.max("cls").over(whole)).filter("low <> high or dealt >= 0")
    return written(rows.sparkSession, several.select("token", "cls", "n", "pos").distinct())


def _bit(doc_id: str, text_hash_: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, text_hash_), F.lit(FILTER))


def _sets_of(rows: DataFrame, read: DataFrame, pairs: DataFrame) -> DataFrame:
    """A written table cls, grams of the sets in pairs (a, b), made anew from one text each.

    Texts are not shuffled: a filter of FILTER bits tells each task which of its texts are asked for.
    """
    spark = rows.sparkSession
    asked = written(spark, pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct())
    bits = read.join(asked, "cls").groupBy("cls").agg(F.min(_bit("doc_id", F.col("hash"))).alias("bit"))
    parts = bits.groupBy(F.floor(F.col("bit") / PART).alias("part")).agg(F.expr(f"bitmap_construct_agg(bit % {PART})").alias("bits"))
    texts = rows.select(_bit("doc_id", text_hash("text")).alias("bit"), "text").withColumn("part", F.floor(F.col("bit") / PART)).join(F.broadcast(parts), "part")  # 2 MB at most
    byte = f"cast(conv(hex(substring(bits, (bit % {PART}) div 8 + 1, 1)), 16, 10) as int)"
    made = texts.filter(f"shiftright({byte}, cast(bit % 8 as int)) % 2 = 1").select("text").mapInArrow(_sets, "cls long, grams array<long>")
    return written(spark, made.join(asked, "cls", "left_semi").dropDuplicates(["cls"]))


def _by_hubs(index: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs (a, b, n, m): each set b with a, the hub of most of its lists.  A list's hub is the set that shares most of its prefix."""
    weight = heads.select("cls", F.size("tokens").alias("weight"))
    hubs = index.join(weight, "cls").groupBy("token").agg(F.max(F.struct("weight", "cls", "n")).alias("h")).select("token", F.col("h.cls").alias("a"), F.col("h.n").alias("hn"))
    votes = index.join(hubs, "token").filter(f"cls <> a and {OF} * least(n, hn) >= {LEAST} * greatest(n, hn)").groupBy("cls", "n", "a", "hn").count()
    best = votes.groupBy("cls", "n").agg(F.max(F.struct("count", "a", "hn")).alias("v"))
    return best.select(F.col("v.a").alias("a"), F.col("cls").alias("b"), F.col("v.hn").alias("n"), F.col("n").alias("m"))


def _rooted(index: DataFrame, roots: DataFrame) -> DataFrame:
    """Index entries of the lists that hold several components, with their roots."""
    named = index.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = named.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("token")
    return named.join(mixed, "token")


def _by_leaders(index: DataFrame) -> DataFrame:
    """Pairs (a, b, n, m) of different roots: each set with the leader of each of its blocks, each leader with the one of the block before."""
    blocks = index.groupBy("token", "n", "pos").agg(F.min(F.struct("cls", "root")).alias("l"), F.count("*").alias("size")).select("token", "n", "pos", "size", F.col("l.cls").alias("leader"), F.col("l.root").alias("lr"))
    inside = index.join(blocks.filter("size > 1").drop("size"), ["token", "n", "pos"]).filter(f"root <> lr and {compatible('n', 'pos', 'n', 'pos')}")
    order = Window.partitionBy("token").orderBy("n", "pos")
    lists = blocks.select("*", *(F.lag(c).over(order).alias(f"last_{c}") for c in ("leader", "lr", "n", "pos")))
    beside = lists.filter(f"lr <> last_lr and {compatible('n', 'pos', 'last_n', 'last_pos')}")
    pairs = inside.select(F.col("leader").alias("a"), F.col("cls").alias("b"), "n", F.col("n").alias("m"))
    return pairs.unionByName(beside.select(F.col("last_leader").alias("a"), F.col("leader").alias("b"), F.col("last_n").alias("n"), F.col("n").alias("m"))).distinct()


def _blocks_apart(index: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: entries of lists with several components, each with its set's leader and d, the shingles that the leader lacks; and pairs of their blocks that can't be skipped.

    A set's leader is, of itself and the sets that it was found to be similar to, the one with most links.
    """
    spark = index.sparkSession
    ends = edges.select(F.col("a").alias("cls"), F.col("b").alias("leader"), (F.col("n") - F.col("both")).alias("d")).unionByName(edges.select(F.col("b").alias("cls"), F.col("a").alias("leader"), (F.col("m") - F.col("both")).alias("d")))
    ends = ends.unionByName(ends.select("cls", F.col("cls").alias("leader"), F.lit(0).cast("long").alias("d")).distinct())
    degree = ends.groupBy("leader").agg(F.count("*").alias("degree"))
    led = ends.join(degree, "leader").groupBy("cls").agg(F.max(F.struct("degree", (-F.col("d")).alias("near"), "leader")).alias("l")).select("cls", "l.leader", (-F.col("l.near")).alias("d"))
    named = _rooted(index, roots).join(led, "cls", "left")
    entries = written(spark, named.select("token", "cls", "n", "pos", "root", F.coalesce("leader", "cls").alias("leader"), F.coalesce("d", F.lit(0)).alias("d")))
    blocks = entries.groupBy("token", "n", "pos", "root", "leader").agg(F.max("d").alias("d"))
    x = blocks.withColumnsRenamed({"root": "xr", "leader": "a", "d": "xd"})
    y = blocks.withColumnsRenamed({"n": "m", "pos": "qos", "root": "yr", "leader": "b", "d": "yd"})
    pairs = x.join(y, "token").filter(f"xr < yr and {compatible('n', 'pos', 'm', 'qos')}")
    return entries, written(spark, pairs.select("token", "n", "pos", "a", "xd", "m", "qos", "b", "yd"))


def _members(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs (a, b, n, m) of sets of the pairs of blocks, whose leaders have both shingles in common, unless that rules them out."""
    x = entries.select("token", F.col("cls").alias("p"), "n", "pos", F.col("leader").alias("a"), F.col("d").alias("pd"))
    y = entries.select("token", F.col("cls").alias("q"), F.col("n").alias("m"), F.col("pos").alias("qos"), F.col("leader").alias("b"), F.col("d").alias("qd"))
    near = blocks.select("token", "n", "pos", "a", "m", "qos", "b", "both")
    pairs = near.join(x, ["token", "n", "pos", "a"]).join(y, ["token", "m", "qos", "b"]).filter(f"both + pd + qd >= {needed('n', 'm')}")
    return pairs.select(F.col("p").alias("a"), F.col("q").alias("b"), "n", "m").distinct()


def links(rows: DataFrame, read: DataFrame) -> DataFrame:
    """A written table node, root: the component of every class that has a link.  rows: doc_id, text; read: their written sizes and classes."""
    spark = rows.sparkSession
    index = _index_lists(rows, common_shingles(read))
    heads = written(spark, index.groupBy("cls").agg(F.collect_set("token").alias("tokens"), F.max("n").alias("n")))
    read = read.filter("token is null")

    pairs = written(spark, within_reach(_by_hubs(index, heads), heads, needed("n", "m")))
    hubs = written(spark, similar(pairs, _sets_of(rows, read, pairs)))
    roots = _components(hubs)
    pairs = written(spark, within_reach(_by_leaders(_rooted(index, roots)), heads, needed("n", "m")))
    edges = written(spark, similar(pairs, _sets_of(rows, read, pairs)).unionByName(hubs))
    roots = _components(edges)

    entries, apart = _blocks_apart(index, edges, roots)
    # For each pair of leaders, how much they must have in common for any of their sets to be similar.
    asked = apart.groupBy("a", "b").agg(F.min(F.expr(f"{needed('n', 'm')} - xd - yd")).alias("least"))
    asked = written(spark, within_reach(asked, heads, "least"))
    known = written(spark, overlaps(asked, _sets_of(rows, read, asked)).filter("both >= least"))
    # Leaders that are similar themselves join their components; the others' sets are looked at.
    led = edges.select("a", "b").unionByName(known.filter(f"both >= {needed('na', 'nb')}").select("a", "b"))
    roots = _components(led)
    root = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}r"))
    still = known.join(root("a"), "a", "left").join(root("b"), "b", "left").filter("coalesce(ar, a) <> coalesce(br, b)").select("a", "b", "both")
    near = written(spark, apart.join(still, ["a", "b"]).filter(f"both + xd + yd >= {needed('n', 'm')}"))
    pairs = written(spark, within_reach(_members(entries, near), heads, needed("n", "m")))
    more = written(spark, similar(pairs, _sets_of(rows, read, pairs)))
    return roots if more.isEmpty() else _components(led.unionByName(more.select("a", "b")))


def _components(pairs: DataFrame) -> DataFrame:
    return components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cls (the class of equal sets), component_id for each row of docs, a table."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = written(spark, rows.withColumn("hash", text_hash("text")).mapInArrow(_read, "doc_id long, hash long, n long, cls long, token long"))
    each = read.filter("token is null").select("doc_id", F.col("n").alias("n_shingles"), "cls")
    roots = links(rows, read)
    low = each.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("low"))
    named = low.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(least, "root").select("cls", "component_id")
    with_words = each.filter("n_shingles > 0").join(named, "cls")
    return with_words.select("doc_id", "n_shingles", "cls", "component_id").unionByName(each.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")

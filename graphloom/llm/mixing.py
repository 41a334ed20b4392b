"""Mixing sources to target weights by entropy balancing.

Of all mixes that meet each source's token target and take no document more than CAP
times, the one closest to the corpus in relative entropy takes document i at the rate
min(CAP, exp(lambda_s * size_i / mean size of s)).  The convex dual has one lambda per
source; guarded Newton steps on it run for all sources at once over a histogram of
document sizes that one distributed pass makes (sizes beyond EXACT in classes of 1/64
octave, so a source has a few thousand classes at most, however many documents).

Rates become whole copies class by class, longest first, each class taking up what the
classes before it left over; inside a class, copies go to documents in the order of
their ids.  Classes are cut into hash shards, so that many documents of one size are
not ranked in one task.  Sums are of whole numbers, so reruns agree.

Cases: a null text has size 0; documents of size 0 are taken once.  A null source is a
source like any other, last in order.  Repeated rows are documents of their own; null
doc_ids come first among equals; an empty table gives an empty result; other columns
are ignored, or kept by mixed_documents.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table, text_hash, word_count, written

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
EXACT, PER_OCTAVE, SHARDS, STEPS = 1024, 64, 256, 60


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _class_of(size: Column) -> Column:
    octave = F.floor((F.log2(size.cast("double")) - F.log2(F.lit(float(EXACT)))) * PER_OCTAVE)
    return F.when(size <= EXACT, size).otherwise(EXACT + 1 + octave).cast("int")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Adds target to sources (key s, source_size): water-filling of share * all tokens by weight, up to cap * source_size.

    One row per source is ordered here; documents are not.
    """
    everything = Window.partitionBy()
    by_name, by_ratio = Window.orderBy("s"), Window.orderBy("ratio", "s")
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1)).withColumn("most", cap * F.col("source_size"))
    weighed = weighed.withColumn("ratio", F.col("most") / F.col("weight"))
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    # The level rises while sources are full and falls after; its peak is where the water stands.
    level = weighed.withColumn("level", (share * F.sum("source_size").over(everything) - before) / rest)
    return level.withColumn("target", F.least(F.col("most").cast("double"), F.max("level").over(everything) * F.col("weight"))).drop("weight", "most", "ratio", "level")


def _rate(lam: Column, z: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * z, F.lit(50.0))))


def solve(lam_column: str, cap: int) -> Column:
    """lambda of each row: classes (array of struct(cls, n, tokens)), docs, source_size, target -> double."""
    classes, target = F.col("classes"), F.col("target")
    z_of = lambda c: (c["tokens"] / c["n"]) * F.col("docs") / F.col("source_size")
    with_tokens = F.filter(classes, lambda c: c["tokens"] > 0)
    z_min = F.array_min(F.transform(with_tokens, z_of))
    ratio = target / F.col("source_size")
    low = F.when(ratio < 1, F.log(ratio) / z_min).otherwise(F.lit(0.0))
    high = F.when(ratio < 1, F.lit(0.0)).otherwise(F.log(F.lit(float(cap))) / z_min)

    def value_and_slope(lam: Column) -> Column:
        def add(acc: Column, c: Column) -> Column:
            return _let(z_of(c), lambda z: _let(_rate(lam, z, cap), lambda w: F.struct((acc["f"] + c["tokens"] * w).alias("f"), (acc["g"] + F.when(w < cap, c["tokens"] * z * w).otherwise(0.0)).alias("g"))))

        return F.aggregate(with_tokens, F.struct((-target).alias("f"), F.lit(0.0).alias("g")), add)

    def step(state: Column, _: Column) -> Column:
        def move(v: Column) -> Column:
            lo, hi = F.when(v["f"] <= 0, state["x"]).otherwise(state["lo"]), F.when(v["f"] > 0, state["x"]).otherwise(state["hi"])
            newton = state["x"] - v["f"] / F.nullif(v["g"], F.lit(0.0))
            inside = (newton >= state["lo"]) & (newton <= state["hi"])
            return F.struct(lo.alias("lo"), hi.alias("hi"), F.when(inside, newton).otherwise((lo + hi) / 2).alias("x"))

        done = state["hi"] - state["lo"] < 1e-15
        return F.when(done, state).otherwise(_let(value_and_slope(state["x"]), move))

    start = F.struct(low.alias("lo"), high.alias("hi"), ((low + high) / 2).alias("x"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["x"]).alias(lam_column)


def copies(classes: DataFrame, cap: int = CAP) -> DataFrame:
    """s, cls, rate and whole copies of each class, from sources with classes, docs, source_size and target."""
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    lam = classes.withColumn("lam", F.when((F.col("source_size") > 0) & (F.col("target") > 0) & ~full, solve("lam", cap)))
    z = lambda c: (c["tokens"] / c["n"]) * F.col("docs") / F.col("source_size")
    rate = lambda c: F.when(c["tokens"] == 0, F.lit(1.0)).when(F.col("target") <= 0, F.lit(0.0)).when(full, F.lit(float(cap))).otherwise(_rate(F.col("lam"), z(c), cap))

    def take(acc: Column, c: Column) -> Column:
        mean = c["tokens"] / c["n"]
        want = rate(c) * c["tokens"] + acc["carry"]
        whole = F.when(c["tokens"] == 0, c["n"]).otherwise(F.greatest(F.lit(0).cast("long"), F.least(cap * c["n"], F.round(want / F.nullif(mean, F.lit(0.0))).cast("long"))))
        out = lambda k: F.struct(F.when(c["tokens"] == 0, acc["carry"]).otherwise(want - k * mean).alias("carry"), F.concat(acc["got"], F.array(k)).alias("got"))
        return _let(whole, out)

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<bigint>").alias("got"))
    taken = lam.withColumn("got", F.aggregate("classes", start, take, lambda a: a["got"])).withColumn("rates", F.transform("classes", rate))
    each = taken.select("s", "source_size", "target", F.explode(F.arrays_zip("classes", "got", "rates")).alias("c"))
    return each.select("s", "source_size", "target", F.col("c.classes.cls").alias("cls"), F.col("c.classes.n").alias("n"), F.col("c.got").alias("copies"), F.col("c.rates").alias("rate"))


def mix(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Adds source_size, target, rate and copies (0 to cap) to rows with doc_id, source, size and th; all columns stay.

    sized is read twice: a table.
    """
    keyed = (
        sized.withColumn("s", F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))))
        .withColumn("cls", _class_of(F.col("size")))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SHARDS)).cast("int"))
    )
    hist = checkpointed(sized.sparkSession, keyed.groupBy("s", "cls", "shard").agg(F.count("*").alias("n"), F.sum("size").alias("tokens")))
    by_class = hist.groupBy("s", "cls").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    per_source = by_class.groupBy("s").agg(
        F.sum("tokens").alias("source_size"), F.sum("n").alias("docs"), F.sort_array(F.collect_list(F.struct("cls", "n", "tokens")), asc=False).alias("classes")
    )
    got = copies(targets(per_source, weights, share, cap), cap)
    # Shards of a class share its copies in proportion to their documents, in whole numbers.
    upto = Window.partitionBy("s", "cls").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    shared = hist.drop("tokens").withColumnRenamed("n", "here").withColumn("cum", F.sum("here").over(upto)).join(got, ["s", "cls"])
    shared = shared.withColumn("every", F.expr("copies div n")).withColumn("extra", F.expr("copies % n"))
    part = lambda c: F.floor(big("extra") * c / big("n"))
    shared = shared.withColumn("more", part(big("cum")) - part((F.col("cum") - F.col("here")).cast("decimal(20,0)")))
    plan = shared.select("s", "cls", "shard", "source_size", "target", "rate", "every", "more")
    order = Window.partitionBy("s", "cls", "shard").orderBy("doc_id", "th")
    ranked = keyed.join(plan, ["s", "cls", "shard"]).withColumn("rn", F.row_number().over(order))
    return ranked.withColumn("copies", (F.col("every") + F.when(F.col("rn") <= F.col("more"), 1).otherwise(0)).cast("int")).drop("s", "cls", "shard", "every", "more", "rn")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and th of documents."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), text_hash().alias("th"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them."""
    names = docs.columns
    held = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text").cast("string")).alias("size"), text_hash().alias("th"), F.struct(*names).alias("row"))
    repeated = mix(held).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("row.*")


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(written(spark, sized(table(spark, sf_dir, "documents"))))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate")

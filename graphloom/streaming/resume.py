"""Resumable, incremental work: pending keys, tripwires, latest states, idempotent micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pending(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work whose key is not done yet."""
    return work.join(done.select(*key).distinct(), key, "left_anti")


def tripwire(rows: DataFrame, by: str, order: list[str], value: str, reference: float, first: int = 20, times: float = 3) -> DataFrame:
    """Mean of each group's first rows, and whether it exceeds a multiple of the reference."""
    w = Window.partitionBy(by).orderBy(*order)
    head = rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= first)
    return head.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias(f"mean_{value}"), (F.avg(value) > times * reference).alias("tripped"))


def latest(rows: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Fields of each key's last row."""
    best = F.max(F.struct(*order, *(F.col(f).alias(f"__{f}") for f in fields)))
    return rows.groupBy(*key).agg(best.alias("b")).select(*key, *(F.col(f"b.__{f}").alias(f) for f in fields))


def replay_check(logged: DataFrame, replayed: DataFrame, run: str, order: list[str], fields: list[str]) -> DataFrame:
    """run, n_logged, n_replayed, first_difference: a resumed run has to write its log again up to where it stopped.

    Rows of both are numbered by order; the first number (from 1) at which the fields are
    not the same, or at which the replayed log has ended, is a difference.  Logs without
    one are prefixes of their replay.  Nulls are equal to each other.
    """

    def numbered(rows: DataFrame, side: str) -> DataFrame:
        w = Window.partitionBy(run).orderBy(*order)
        return rows.select(F.col(run).alias("run"), F.row_number().over(w).alias("no"), F.struct(*fields).alias(side))

    both = numbered(logged, "l").join(numbered(replayed, "r"), ["run", "no"], "full")
    wrong = F.col("l").isNotNull() & ~F.col("l").eqNullSafe(F.col("r"))
    return both.groupBy("run").agg(F.count("l").alias("n_logged"), F.count("r").alias("n_replayed"), F.min(F.when(wrong, F.col("no"))).alias("first_difference"))


def append_once(stream: DataFrame, path: str, key: list[str], checkpoint: str):
    """Starts a query that appends rows with new keys to a parquet table; replayed batches add nothing.

    Each micro-batch is anti-joined with the table, so a batch that ran before a failure is skipped.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(key)
        try:
            done = spark.read.schema(batch.schema).parquet(path)
        except Exception as e:  # the table is not there before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            fresh = pending(fresh, done, key)
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Helpers shared by the training-data operators.

Identity of a document row is its content key: ``doc_id`` and the XXH64 of its text.
Rows that agree in both are one document and always get equal results, so no operator
needs unique or non-null ids.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (fixed by the query contracts).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package to Python workers that could not import it by themselves."""
    root = str(Path(__file__).resolve().parents[2])
    seen = [*os.environ.get("PYTHONPATH", "").split(":"), os.getcwd()]
    if any(p and os.path.realpath(p) == root for p in seen) or getattr(ship, "done", None) == spark.sparkContext.applicationId:
        return
    target = os.path.join(tempfile.mkdtemp(), "graphloom_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in Path(root, "graphloom").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(target)
    ship.done = spark.sparkContext.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset, and only in local mode, a temporary folder is used.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir()


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows of df, written once as a table in the shared folder; cuts lineage."""
    path = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder; for small intermediate results."""
    shared_dir(spark)
    return df.checkpoint(eager=True)


def text_hash(text: str | Column = "text") -> Column:
    """Second half of the content key."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    parts = F.size(F.split(text, SPACE))
    edge = F.when(text.rlike(r"\A[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    blank = text.isNull() | ~text.rlike(r"[^\x20\x09-\x0D]")
    return F.when(blank, F.lit(0)).otherwise(parts - edge).cast("long")


def distributed_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], shards: int = 256, name: str = "rank") -> DataFrame:
    """Adds 0-based ranks within each key, without bringing a key's rows into one task.

    Each key is cut into hash shards; shard sizes give each shard its first rank.
    df is read twice and so must be a table or cheap.  Keys must not be null.
    """
    s, off = "__shard", "__off"
    cut = df.withColumn(s, F.pmod(F.xxhash64(*order), F.lit(shards)))
    by_key = Window.partitionBy(*keys).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    first = cut.groupBy(*keys, s).agg(F.count("*").alias("__n")).select(*keys, s, F.coalesce(F.sum("__n").over(by_key), F.lit(0)).alias(off))
    inside = Window.partitionBy(*keys, s).orderBy(*order)
    return cut.join(first, [*keys, s]).withColumn(name, F.col(off) + F.row_number().over(inside) - 1).drop(s, off)

"""Intermediate results in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """The folder; only in local mode, where the setting is absent, a temporary one is set."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        path = sc.getCheckpointDir()
    return path


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    shared_path(spark)
    return df.checkpoint(eager=True)


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder, written once: short plans, and sizes that Spark knows."""
    path = f"{shared_path(spark)}/graphloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

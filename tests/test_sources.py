import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from graphloom.sources import jsonl

SCHEMA = StructType([StructField("id", LongType()), StructField("name", StringType())])


def test_jsonl_round_trip(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": 1, "name": "ä"}\n\n{"id": 2, "name": null}\n')
    assert [tuple(r) for r in jsonl.read_jsonl(spark, str(path), SCHEMA).orderBy("id").collect()] == [(1, "ä"), (2, None)]


def test_torn_and_malformed_lines(spark, tmp_path):
    path = tmp_path / "b.jsonl"
    path.write_text('{"id": 1, "name": "a"}\n{"id": 2, "na')
    assert jsonl.read_growing(spark, str(path), SCHEMA).count() == 1
    assert [r.line for r in jsonl.malformed(spark, str(path), SCHEMA).collect()] == ['{"id": 2, "na']
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        jsonl.read_jsonl(spark, str(path), SCHEMA).collect()


def test_write_once(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    assert jsonl.write_once(df, out) and not jsonl.write_once(df.orderBy(F.desc("id")), out)
    with pytest.raises(ValueError):
        jsonl.write_once(df.limit(1), out)


def test_digest_ignores_row_order(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], SCHEMA)
    one, two = (x.agg(jsonl.ordered_digest(F.col("id"), F.col("name")).alias("d")).first().d for x in (df, df.orderBy(F.desc("id")).repartition(3)))
    assert one == two

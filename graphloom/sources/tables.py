"""Files with rules: keyed files, documents, CSV, matrices, ordered and exclusive writes, content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from ..operators.checked import _named, _stop, unique


def read_unique(spark: SparkSession, path: str, schema: StructType, key: list[str]) -> DataFrame:
    """Line-wise JSON of all files that a path or pattern names; a key in two rows, of whichever files, is an error."""
    return unique(spark.read.schema(schema).option("mode", "FAILFAST").json(path), key, path)


def read_keyed(spark: SparkSession, path: str, schema: StructType, pattern: str, field: str) -> DataFrame:
    """Line-wise JSON of files named after a value of their rows; a row in a file of another name is an error.

    pattern: a regular expression over the file's name, whose first group is the value.
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path).select("*", F.col("_metadata.file_name").alias("__file"))
    wrong = ~F.regexp_extract("__file", pattern, 1).eqNullSafe(F.col(field).cast("string"))
    return _stop(rows, wrong, _named("row is in the file of another key", ["__file", field])).drop("__file")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, document (VARIANT) of files that hold one JSON document each; null where a file holds none."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("document"))


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header whose names must be those of the schema; blank fields are null, values of other types an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("nullValue", "").option("multiLine", True).csv(path)


def matrix_rows(rows: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """Rows of a matrix stored as arrays; a row of another width, or with a null or a number that is not finite, is an error."""
    bad = F.col(vector).isNull() | (F.size(vector) != width) | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return _stop(rows, bad, _named("row does not have the matrix's shape", [key]))


def write_ordered(df: DataFrame, path: str, order: list[str]) -> None:
    """Line-wise JSON in order: files in order of their names, rows in order within each.  An existing path is an error."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; structs, arrays, maps and variants as JSON text.  An existing path is an error."""
    nested = (ArrayType, MapType, StructType, VariantType)
    flat = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*flat).write.mode("errorifexists").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of the bytes of each file.  For files that fit a row (2 GB)."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))

"""Line-wise JSON: declared schemas, torn last lines, create-or-identical writes, ordered digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of one or more files; a malformed line stops the read.  Blank lines are passed over."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 1), line, unfinished of every line of text files, blank ones included.

    Files are read in splits.  A split's lines have consecutive row ids; counts of the
    splits before it give the number of its first line.  Lines end with a newline; the
    last one is unfinished if its file has one byte less than lines that all end would take.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    splits = lines.groupBy("file", "start").agg(F.min("row").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.max("size").alias("size"))
    of_file = Window.partitionBy("file")
    before = of_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(of_file).alias("total"), (F.sum("bytes").over(of_file) > F.col("size")).alias("open"))
    number = F.col("before") + F.col("row") - F.col("first") + 1
    return lines.join(splits, ["file", "start"]).select("file", number.alias("number"), F.regexp_replace("line", r"\r\z", "").alias("line"), (F.col("open") & (number == F.col("total"))).alias("unfinished"))


def numbered_names(spark: SparkSession, path: str) -> DataFrame:
    """id (line number from 0), name of a vocabulary file."""
    return numbered_lines(spark, path).select((F.col("number") - 1).alias("id"), F.col("line").alias("name"))


def _parsed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """file, number, line, unfinished, row (struct of the schema) and bad (whether the line is no object of the schema) for lines that are not blank."""
    wide = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    row = F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    is_object = F.col("line").rlike(r"\A\s*\{")
    return lines.withColumn("row", row).withColumn("bad", F.col("row._corrupt_record").isNotNull() | ~is_object)


def malformed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """file, number and line of what is not an object of the schema, instead of an error."""
    return _parsed(spark, path, schema).filter("bad").select("file", "number", "line")


def read_growing(spark: SparkSession, path: str, schema: StructType, growing: bool = True) -> DataFrame:
    """Rows of files that may still be written to.

    A last line without newline is left for later, or stops the read if the file is said
    to be complete.  Any other line that is no object of the schema stops the read; the
    error names file and line.
    """
    rows = _parsed(spark, path, schema)
    rows = rows.filter("not unfinished") if growing else rows
    at = F.concat_ws(":", "file", F.col("number").cast("string"))
    fault = F.when(F.col("unfinished"), F.concat(F.lit("unfinished last line: "), at)).when(F.col("bad"), F.concat(F.lit("no object of the schema: "), at))
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast(rows.schema["row"].dataType)).otherwise(F.col("row"))
    return rows.select(checked.alias("row")).select(*(F.col(f"row.{f.name}") for f in schema.fields))


def write_once(df: DataFrame, path: str) -> bool:
    """Writes df as line-wise JSON; an existing table with the same rows is left alone (False), another one is an error."""
    spark = df.sparkSession
    try:
        old = spark.read.schema(df.schema).json(path)
        same = old.exceptAll(df).isEmpty() and df.exceptAll(old).isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.json(path)
        return True
    if not same:
        raise ValueError(f"{path} holds other rows")
    return False


def ordered_digest(key: Column, line: Column) -> Column:
    """SHA-256 over lines in key order, as an aggregate.  For groups of a manifest's size."""
    rows = F.array_sort(F.collect_list(F.struct(key.alias("k"), line.alias("l"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["l"]), "\n"), 256)

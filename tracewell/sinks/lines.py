"""Documents as ordered lines: section int, key string, value string."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "section int, key string, value string"


def fixed(spark: SparkSession, section: int, *values: str) -> DataFrame:
    """Lines that are the same whatever the result."""
    rows = [(section, f"{n:06d}", v) for n, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def of_rows(df: DataFrame, section: int, key: Column, value: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.coalesce(key.cast("string"), F.lit("")).alias("key"), value.alias("value"))


def items(df: DataFrame, section: int, key: Column, value: Column, comma: str = ",") -> DataFrame:
    """Lines of a list: each but the first begins with the comma. The first is the least (key, value), found by one
    aggregate; rows that are equal to it get a number within their partition to tell them apart."""
    placed = df.select(F.coalesce(key.cast("string"), F.lit("")).alias("key"), value.alias("value"))
    numbered = placed.withColumn("id", F.xxhash64("key", "value"))
    grouped = numbered.groupBy("key", "value", "id").agg(F.count(F.lit(1)).alias("n"))
    first = grouped.agg(F.min(F.struct("key", "value")).alias("first"))
    joined = grouped.crossJoin(F.broadcast(first))  # one row
    lead = F.when(F.struct("key", "value") == F.col("first"), F.lit("")).otherwise(F.lit(comma))
    again = F.when(F.col("n") > 1, F.repeat(F.concat(F.lit("\n" + comma), F.col("value")), (F.col("n") - 1).cast("int"))).otherwise("")
    return joined.select(F.lit(section).alias("section"), "key", F.concat(lead, "value", again).alias("value"))


def document(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ordered(lines: DataFrame) -> DataFrame:
    return lines.orderBy("section", "key", "value").select("value")


def text_of(lines: DataFrame) -> str:
    """The whole document on the driver: for results that are known to be small, such as tests."""
    return "".join(f"{r[0]}\n" for r in ordered(lines).collect())


def write_lines(lines: DataFrame, path: str, single: bool = False) -> None:
    """Text files in the order of the document; one file if ``single``."""
    out = ordered(lines)
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """One small file of that very name, through the store's own interface."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def escape_xml(value: Column) -> Column:
    out = value
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out

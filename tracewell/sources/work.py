"""Tables between the steps of a scan, written once and read by every later step.

A table that several steps read would else be computed by each of them; written to the shared folder it also survives
lost executors, and plans stay small.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it names none, one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


class Keeper:
    """Writes tables below a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, f"{folder or work_folder(spark)}/scan-{uuid4().hex}"

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

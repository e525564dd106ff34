"""The table of queries: each is a function of (spark, folder of tables), with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as there are threads. A table of one small file is one partition, which
    one thread would work through; a table of more is left as it is, so that large inputs aren't shuffled."""
    threads = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= threads else df.repartition(threads)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table, or some of its columns, spread over the threads."""
    raw = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(raw.select(*columns) if columns else raw)

"""Incremental scans with Structured Streaming: an addition.

Detectors look at one file at a time, so they need no state and run on a stream as they run on a table; each file is
read once, and the checkpoint remembers which. Tallies over time keep state by window, bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def incoming_files(spark: SparkSession, folder: str, per_trigger: int = 10_000) -> DataFrame:
    """path, size, modified, content of files as they appear below a folder."""
    raw = spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return raw.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def incoming_texts(spark: SparkSession, folder: str, schema: str, path: str, text: str, per_trigger: int = 1000) -> DataFrame:
    """path, text of Parquet tables as they appear."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return raw.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text"))


def windowed_tallies(findings: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, value, count by window of time. Rows later than ``late`` are dropped, and with them the state of windows
    that can't change any more."""
    grouped = findings.withWatermark(time, late).groupBy(F.window(time, width), F.col(value).alias("value"))
    return grouped.agg(F.count(F.lit(1)).alias("count")).select(F.col("window.start").alias("start"), "value", "count")


def start(stream: DataFrame, detect: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes what ``detect`` finds as Parquet, exactly once. ``once``: stops when all that is there is done."""
    writer = detect(stream).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()

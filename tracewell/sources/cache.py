"""Results of earlier scans, kept as Parquet by content and options.

A row counts only if format, engine version, rules and options are those of the question; files that can't be read are as
good as missing. Probing is an anti-join on the content's hash, so unchanged files cost a hash and no detector.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import __version__

FORMAT = 1
#: Names a folder for results; a parameter comes before it.
ENVIRONMENT = "TRACEWELL_CACHE"
FOLDER = ".tracewell-cache"


def cache_folder(root: str, given: str | None = None) -> str:
    return given or os.environ.get(ENVIRONMENT) or f"{root.rstrip('/')}/{FOLDER}"


def fingerprint(options: dict, rules: str = "") -> str:
    """What results depend on besides the content, as one hash."""
    shown = json.dumps({"format": FORMAT, "version": __version__, "rules": rules, "options": options}, sort_keys=True, default=str)
    return hashlib.sha256(shown.encode()).hexdigest()


def rules_fingerprint(rules: DataFrame) -> str:
    """Follows from every rule's name, expression and text; one aggregate."""
    r = rules.agg(F.bit_xor(F.xxhash64("identifier", "license_expression", "text")).alias("x"), F.count(F.lit(1)).alias("n")).first()
    return f"{r['x']}-{r['n']}"


def store(results: DataFrame, folder: str, mark: str) -> None:
    """Appends rows (sha256 and any others) under a fingerprint. Rows of a failed write aren't seen, as Spark lists only
    what a job has committed."""
    results.withColumn("fingerprint", F.lit(mark)).write.mode("append").partitionBy("fingerprint").parquet(folder)


def cached(spark, folder: str, mark: str) -> DataFrame | None:
    """Rows under a fingerprint, one for each content; None if there are none to read."""
    try:
        held = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(folder)
    except AnalysisException:
        return None
    if "fingerprint" not in held.columns or "sha256" not in held.columns:
        return None
    return held.where(F.col("fingerprint") == mark).drop("fingerprint").dropDuplicates(["sha256"])


def probe(files: DataFrame, held: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(files still to be scanned, rows of the others with their path): files have path and sha256."""
    if held is None:
        return files, None
    return files.join(held.select("sha256"), "sha256", "left_anti"), files.select("path", "sha256").join(held, "sha256")


def clear(spark, folder: str) -> None:
    """Deletes the folder through the store's own interface."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

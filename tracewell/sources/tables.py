"""Tables of texts as files: path, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_files(df: DataFrame, path: Column | str, text: Column | str, size: bool = False) -> DataFrame:
    """A row for each text; the path is any column or expression. With ``size``: the bytes of the text as well."""
    p = F.col(path) if isinstance(path, str) else path
    t = F.col(text) if isinstance(text, str) else text
    out = df.select(p.cast("string").alias("path"), t.cast("string").alias("text"))
    return out.withColumn("size", F.octet_length("text").cast("long")) if size else out

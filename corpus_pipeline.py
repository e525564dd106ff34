"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
of documents. ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, language, line_dedup, packing, simhash
from tracewell.llm.common import checkpoint_folder, remainder

#: SQL can't express the byte network, the fingerprints' components or the packing.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (null, or without a letter) go. Labels are learned as in op9."""
    columns = docs.columns
    found = language.identify(docs, learn=remainder(F.col("doc_id"), 4) != 2, keep=columns)
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(*columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go, and with them documents of which nothing is left."""
    columns = docs.columns
    found = line_dedup.dedup_lines(docs, keep=columns)
    return found.where((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\t\r\n", "   ")) != "")).select(
        *[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns]
    )


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id. Near duplicates are texts whose
    sets of five-word shingles have a similarity of 0.8 or more, also over third texts."""
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    kept = simhash.similar_documents(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    hashed = docs.withColumn("_text", text_hash)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    return hashed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_text"]).select(*docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a run of hit words as long as a window go, however long they are. Items of fewer words may be
    in a text by chance: for those a twentieth of the document's words has to be hit."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(docs, benchmark, keep=docs.columns)
    whole = F.exists("spans", lambda s: s["to"] - s["from"] >= decontaminate.WINDOW)
    some = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.where(~(whole | some)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).drop("partition_bins", "partition_bound")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", remove_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet under the checkpoint folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_folder(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

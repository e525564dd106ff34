"""Queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hmm, language, licenses, line_dedup, media, packing, pii, quality, simhash
from .common import remainder


#: The key of the registered query, which anyone can read: for tests and checks alone.
PII_TEST_KEY = "a key for tests, no secret"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymise(_table(spark, sf_dir, "documents"), key=PII_TEST_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct("found.kind")), ",")
    return made.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), kinds.alias("kinds"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(_table(spark, sf_dir, "documents"), keep_media=False).drop("media")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=remainder(F.col("id"), 3) != 1
    )
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = remainder(F.col("doc_id"), 7) != 2
    scored = hmm.score_texts(_table(spark, sf_dir, "documents"), learn=learn)
    return scored.select("doc_id", (~learn).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    starts, base = F.col("phrases.start"), F.col("phrases.label")
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"),
        named(F.concat(base, F.col("blocks.label"), F.col("windows.label"))).alias("labels"),
        F.greatest(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)), F.coalesce(F.array_max("windows.containment"), F.lit(0.0)), F.when(F.size("phrases") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(_table(spark, sf_dir, "documents"), learn=remainder(F.col("doc_id"), 4) != 2)
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).drop("partition_bins", "partition_bound")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_pii": op2_pii,
        "op3_simhash": op3_simhash,
        "op4_media": op4_media,
        "op5_quality": op5_quality,
        "op6_hmm": op6_hmm,
        "op7_licenses": op7_licenses,
        "op8_decontaminate": op8_decontaminate,
        "op9_language": op9_language,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE_SQL,
        "op7_licenses": licenses.oracle_sql(),
        "op8_decontaminate": decontaminate.oracle_sql(),
    }

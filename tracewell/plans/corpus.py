"""Scores of detectors over a folder of texts with expectations beside them.

A pair is a file and ``<file>.yml`` with lists of expected values. Texts without an expectation, and expectations without
a text, are left out and counted, so that a score says what it was taken over.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import copyright as cr
from ..sources.files import read_tree, texts_of

EXPECTED = "copyrights array<string>, holders array<string>, authors array<string>, license_expressions array<string>, what array<string>"


def load_pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, counts): suite, path, text and the expected lists (null where a list isn't given); one row with pairs,
    texts_alone, expectations_alone."""
    files = texts_of(read_tree(spark, folder)[0])
    stated = files.where(F.col("path").endswith(".yml")).select(F.regexp_replace("path", r"\.yml$", "").alias("path"), F.col("text").alias("yml"))

    @F.udf(f"struct<{', '.join(c.replace(' ', ':', 1) for c in EXPECTED.split(', '))}>", useArrow=True)
    def expectations(text: str | None):
        import yaml

        try:
            d = yaml.safe_load(text or "") or {}
        except yaml.YAMLError:
            d = {}
        lists = [d.get(c.split(" ")[0]) if isinstance(d, dict) else None for c in EXPECTED.split(", ")]
        return tuple([str(x) for x in v if x is not None] if isinstance(v, list) else None for v in lists)

    expected = stated.select("path", expectations(F.col("yml")).alias("e")).select("path", "e.*")
    texts = files.where(~F.col("path").endswith(".yml"))
    joined = texts.join(expected, "path", "full")
    has = lambda c: F.col(c).isNotNull()
    marked = texts.join(expected.withColumn("known", F.lit(True)), "path", "full")
    counts = marked.agg(F.count_if(has("text") & has("known")).alias("pairs"), F.count_if(~has("known")).alias("texts_alone"), F.count_if(~has("text")).alias("expectations_alone"))
    suite = F.split("path", "/")[0]
    return marked.where(has("text") & has("known")).select(suite.alias("suite"), *joined.columns), counts


def score(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """suite, kind, expected, found, right, precision, recall of value multisets: rows (suite, path, kind, value)."""
    count = lambda df, name: df.groupBy("suite", "path", "kind", "value").agg(F.count(F.lit(1)).alias(name))
    both = count(expected, "e").join(count(found, "f"), ["suite", "path", "kind", "value"], "full").fillna(0, ["e", "f"])
    summed = both.groupBy(*keys).agg(F.sum("e").alias("expected"), F.sum("f").alias("found"), F.sum(F.least("e", "f")).alias("right"))
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 4)
    return summed.select(*keys, "expected", "found", "right", share("right", "found").alias("precision"), share("right", "expected").alias("recall"))


def score_copyrights(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Copyrights, holders and authors of texts for which that kind is asked (``what``)."""
    detected = cr.detect_copyrights(pairs.select("path", "text")).select("path", "kind", "value")
    credits = cr.credits_authors(pairs.where(cr.is_credits_file(F.col("path"))).select("path", "text")).select("path", F.lit("author").alias("kind"), F.col("author").alias("value"))
    asked = pairs.select("suite", "path", F.explode("what").alias("w")).select("suite", "path", F.regexp_replace("w", "s$", "").alias("kind"))
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(f"{k}s", F.array().cast("array<string>")).alias("v")) for k in ("copyright", "holder", "author")])
    expected = pairs.select("suite", "path", F.inline(listed)).select("suite", "path", "kind", F.explode("v").alias("value")).join(asked, ["suite", "path", "kind"], "left_semi")
    found = detected.unionByName(credits).join(asked, ["path", "kind"]).select("suite", "path", "kind", "value")
    shown = lambda df: df.withColumn("value", cr.canonical(F.col("value")))
    return score(shown(expected), shown(found), keys or ["kind"])

"""Rows that every operator has to take: nulls, empty and very long texts, ties, repeats, odd characters."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def nasty_rows(seed: int = 5) -> list[tuple]:
    """(doc_id, text)"""
    rng = random.Random(seed)
    base = [sentence(rng, 60) for _ in range(4)]
    near = base[0].replace("alpha", "alfa", 1)
    lines = "\n".join(sentence(rng, 8) for _ in range(7))
    return [
        (1, base[0]), (2, base[0]), (2, base[0]), (3, near), (4, base[1] + "\n" + lines), (5, lines + "\n\n" + base[2]),
        (6, None), (7, ""), (None, base[3]), (None, None), (8, " \t\n "), (9, "x"), (10, "Ünï cödé ☃ 漢字 \x00 end"),
        (11, lines), (12, sentence(rng, 30_000)), (13, "1234 5678 !!! ---"), (9, "y"), (14, "one two"), (2, base[1]),
        (15, "a" * 50_000), (16, "A b\x0bC\x0cd\re f"),
    ]


def frame(spark, rows: list[tuple], clash: bool = False):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if clash:
        from pyspark.sql import functions as F

        names = "key hash word n c score _key _text _hash fp text_hash piece start length _part spans items lines found _keep0 id label value node root a b quality n_words".split()
        df = df.select("doc_id", "text", *[F.lit(k).cast("string").alias(k) for k in names])
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def as_set(df) -> list[str]:
    return sorted(repr(tuple(r)) for r in df.collect())

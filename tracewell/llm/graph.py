"""Connected components of a table of links, by alternating star contractions.

Each round is an aggregation and a join by node, so a node with many links is pre-aggregated and, in the join, split by
adaptive execution. Every round's links are written to the checkpoint folder; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Rows of links a partition holds at least, so that a small table isn't shuffled from many nearly empty ones.
PARTITION_ROWS = 20_000


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """Columns node, root: each node that isn't the smallest of its component, and that smallest one.

    links: columns a, b of the same type with a < b; direction doesn't matter, repeats don't either.
    """
    now = cut(links.select("a", "b"))
    state = _state(now)
    while state[0]:
        most = -(-2 * state[0] // PARTITION_ROWS)
        now = now.coalesce(most)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).coalesce(most)
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(low, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        now = cut(low.select(F.col("m").alias("a"), "b").unionAll(moved).coalesce(most).distinct())
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))

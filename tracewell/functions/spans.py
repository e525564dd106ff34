"""Spans: sorted arrays of half-open ranges struct(start, end). Ranges that only touch stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int>>"


def merge(spans: Column) -> Column:
    """Sorted, with overlapping ranges joined and empty ones dropped."""
    full = F.array_sort(F.filter(spans, lambda r: r["start"] < r["end"]))

    def add(out: Column, r: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        overlaps = (F.size(out) > 0) & (r["start"] < last["end"])
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when(overlaps, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(r)))

    return F.aggregate(full, F.array().cast(SPAN), add)


def union(a: Column, b: Column) -> Column:
    return merge(F.concat(a, b))


def length(spans: Column) -> Column:
    return F.aggregate(merge(spans), F.lit(0), lambda n, r: n + r["end"] - r["start"])


def intersects(a: Column, b: Column) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))


def positions(spans: Column) -> Column:
    """All positions; matches are compared by these, as spans may have holes."""
    full = F.filter(spans, lambda r: r["start"] < r["end"])
    return F.array_distinct(F.flatten(F.transform(full, lambda r: F.sequence(r["start"], r["end"] - 1))))


def overlap(a: Column, b: Column) -> Column:
    """Number of positions in both."""
    return F.size(F.array_intersect(positions(a), positions(b)))


def covers(a: Column, b: Column) -> Column:
    """Whether a has every position of b."""
    return F.size(F.array_except(positions(b), positions(a))) == 0

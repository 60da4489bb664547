"""Rows in ascending doc_id order, dealt into ranges without one task that sees them all."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a range, about, and the most ranges; ranges follow the ids' quantiles, so that none is much larger.
RANGE_ROWS, MOST_RANGES = 1000, 8192


def bounds(docs: DataFrame) -> list[int]:
    """Ids that cut the table into ranges of about RANGE_ROWS rows; from MOST_RANGES ranges on, the ranges grow instead."""
    k = min(MOST_RANGES, docs.count() // RANGE_ROWS)
    if k < 2:
        return []
    cuts = docs.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 4 * k).alias("q")).first()["q"]
    return sorted(set(cuts or []))


def range_of(cuts: list[int]) -> Column:
    """How many cuts are at or under doc_id, found in two levels; null ids come first, in range 0."""
    if not cuts:
        return F.lit(0)
    size = isqrt(len(cuts)) + 1
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    tops = F.from_json(F.lit(str([g[-1] for g in groups])), "array<bigint>")
    inner = F.from_json(F.lit(str([*groups, []])), "array<array<bigint>>")
    under = lambda x: x <= F.col("doc_id")
    whole = F.size(F.filter(tops, under))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(whole * size + F.size(F.filter(F.get(inner, whole), under))).cast("int")

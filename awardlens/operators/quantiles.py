"""Exact quantiles without a global sort: passes over bucket counts, until few values are left."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, FEW = 1024, 10_000


def nth_value(values: DataFrame, rank: int, low: float, high: float, few: int = FEW) -> float:
    """The value at ``rank`` (from 0) of the column x, whose ends are given.

    Each pass counts the values in equal parts of the range and goes on in the part that holds the rank. At most ``few`` values
    meet at the driver, or one that repeats.
    """
    while low < high:
        part = F.least(F.floor((F.col("x") - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1)).alias("part")
        inside = values.filter(F.col("x").between(low, high))
        parts = inside.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("part").collect()
        for p in parts:
            if rank < p["n"]:
                break
            rank -= p["n"]
        low, high = p["low"], p["high"]
        if p["n"] <= few:
            return sorted(r["x"] for r in values.filter(F.col("x").between(low, high)).collect())[rank]
    return low


def exact_quantile(df: DataFrame, column: str, share: float, few: int = FEW) -> float | None:
    """The value that a share of the rows lies below, between two values in proportion; None without values.

    Nulls and NaN are passed over; repeated values count each. The column is read a few times, so it should be written before.
    """
    values = df.select(F.col(f"`{column}`").cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    ends = values.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    if not ends["n"]:
        return None
    at = share * (ends["n"] - 1)
    below = nth_value(values, math.floor(at), ends["low"], ends["high"], few)
    if at == math.floor(at):
        return below
    above = nth_value(values, math.ceil(at), ends["low"], ends["high"], few)
    return below + (at - math.floor(at)) * (above - below)

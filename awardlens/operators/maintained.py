"""Digit counts and amounts per recipient, kept up to date from a store's changes: what a load replaced is taken back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import leading_digit
from .results import positive_awards

DIGITS = [f"d{d}" for d in range(1, 10)]


def state_changes(changes: DataFrame) -> DataFrame:
    """(uei, n, d1 .. d9) by which a load (``Store.changes`` of awards) raises or lowers the counts of positive awards.

    Rows as they were count -1, rows as they are +1, so that an award that goes to another recipient leaves the first. A
    row without predecessor counts once; a load that changes nothing gives no rows. One aggregation with partial sums.
    """
    signed = changes.select(F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("after").alias("row")), F.struct(F.lit(-1).alias("sign"), F.col("before").alias("row")))).alias("s"))
    rows = positive_awards(signed.select("s.sign", "s.row.recipient_uei", "s.row.total_obligation")).withColumn("digit", leading_digit("total_obligation")).filter(F.col("digit").between(1, 9))
    sums = rows.groupBy(F.col("recipient_uei").alias("uei")).agg(F.sum("sign").alias("n"), *[F.sum(F.when(F.col("digit") == d, F.col("sign")).otherwise(0)).alias(f"d{d}") for d in range(1, 10)])
    return sums.filter(" or ".join(f"{c} <> 0" for c in DIGITS))


def combined(*parts: DataFrame) -> DataFrame:
    """The counts after several loads, from the changes of each in any order; recipients without positive awards left are gone."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("uei").agg(*[F.sum(c).alias(c) for c in ("n", *DIGITS)]).filter("n > 0")

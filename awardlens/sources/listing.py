"""Choosing archives and their members from listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SNAPSHOT = r"_Contracts_Full_(\d{8})\.zip"


def latest_snapshot(listing: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, latest): the greatest date of any full contracts archive that a listing names, null if none does."""
    dates = listing.select(*by, F.array_max(F.regexp_extract_all(F.col(text), F.lit(SNAPSHOT), F.lit(1))).alias("day"))
    return dates.groupBy(*by).agg(F.max("day").alias("latest"))


def prime_files(members: DataFrame, archive: str = "snapshot", name: str = "file_name") -> DataFrame:
    """An archive's CSV members that hold prime awards; only if none says so, its contract files that aren't subawards."""
    low = F.lower(name)
    rows = members.filter(low.endswith(".csv")).withColumn("prime", low.contains("primeaward"))
    rows = rows.withColumn("any_prime", F.max("prime").over(Window.partitionBy(archive)))
    fallback = low.contains("contract") & ~low.contains("subaward")
    return rows.filter(F.col("prime") | (~F.col("any_prime") & fallback)).drop("prime", "any_prime")

"""The shared result shape of the detectors, and what is made from all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schemas import RESULT


def positive_awards(awards: DataFrame) -> DataFrame:
    """Awards with a recipient and an amount above 0 (NaN is none); both conditions reach the scan."""
    amount = F.col("total_obligation")
    return awards.filter(F.col("recipient_uei").isNotNull() & amount.isNotNull() & (amount > 0) & ~F.isnan(amount))


def result(df: DataFrame, detector: str, details) -> DataFrame:
    return df.select(F.col("uei").cast("string").alias("uei"), F.lit(detector).alias("detector"), F.col("score").cast("double").alias("score"), details.alias("details"))


def all_detectors(*frames: DataFrame) -> DataFrame:
    """The detectors' results under one another."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def contract_violations(results: DataFrame) -> DataFrame:
    """Rows that break the contract, with a reason: score outside [0, 1], details that are no JSON object, a repeated (uei, detector)."""
    if [(f.name, f.dataType) for f in results.schema] != [(f.name, f.dataType) for f in RESULT]:
        raise ValueError(f"columns are {results.schema.simpleString()}")
    counted = results.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("uei", "detector")))
    score = F.col("score")
    reason = F.when(score.isNull() | F.isnan(score) | (score < 0) | (score > 1), "score").when(F.col("details").isNull() | F.get_json_object("details", "$").isNull() | ~F.col("details").startswith("{"), "details").when(F.col("n") > 1, "repeated")
    return counted.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("n")


def top(results: DataFrame, k: int = 10) -> DataFrame:
    """The k highest scores; ties go by uei. Spark keeps k rows per task, not a full sort."""
    return results.orderBy(F.desc("score"), "uei").limit(k)

"""Contract growth: recipients one of whose contracts grew far beyond its industry's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import json_details, sigmoid, z_score
from .results import positive_awards, result

THRESHOLD = 2.0


def growth_ratios(awards: DataFrame) -> DataFrame:
    """(parent_award_id, uei, naics_code, initial_value, final_value, growth_ratio), one row per contract.

    The initial row is that of modification 0, then of the least modification number (none last), then of the least award
    id. One aggregation gives it and the sum, where a window and a self-join would shuffle more.
    """
    number = F.col("modification_number")
    order = F.struct(F.when(number == "0", 0).when(number.isNull(), 2).otherwise(1).alias("a"), F.coalesce(number, F.lit("")).alias("b"), F.coalesce("award_id", F.lit("")).alias("c"))
    rows = positive_awards(awards).filter(F.col("parent_award_id").isNotNull())
    first = F.min_by(F.struct("recipient_uei", "naics_code", "total_obligation"), order)
    out = rows.groupBy("parent_award_id").agg(first.alias("first"), F.sum("total_obligation").alias("final_value"))
    return out.select("parent_award_id", F.col("first.recipient_uei").alias("uei"), F.col("first.naics_code").alias("naics_code"), F.col("first.total_obligation").alias("initial_value"), "final_value", (F.col("final_value") / F.col("first.total_obligation")).alias("growth_ratio"))


def growth_z_scores(awards: DataFrame) -> DataFrame:
    """Contracts with naics_mean and z_score. Industries are aggregated and joined back, so that a large one is no single task's work."""
    ratios = growth_ratios(awards)
    peers = ratios.groupBy(F.col("naics_code").alias("peer_code")).agg(F.avg("growth_ratio").alias("naics_mean"), F.stddev_samp("growth_ratio").alias("naics_std"))
    joined = ratios.join(peers, F.col("naics_code").eqNullSafe(F.col("peer_code")))
    return joined.withColumn("z_score", z_score(F.col("growth_ratio"), F.col("naics_mean"), F.col("naics_std"))).drop("peer_code")


def worst_contracts(awards: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The contract of greatest z score above ``threshold`` of each recipient; ties go to the least contract id."""
    rows = growth_z_scores(awards).filter(F.col("z_score") > threshold)
    parts = F.struct("parent_award_id", "growth_ratio", "naics_code", "naics_mean", "z_score")
    worst = rows.groupBy("uei").agg(F.min_by(parts, F.struct((-F.col("z_score")).alias("z"), "parent_award_id")).alias("w"))
    return worst.select("uei", F.col("w.parent_award_id").alias("worst_award_id"), "w.growth_ratio", "w.naics_code", F.col("w.naics_mean").alias("naics_avg_ratio"), "w.z_score").withColumn("score", sigmoid("z_score", threshold))


def detect_mod_growth(awards: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Recipients with a contract that grew far beyond its industry's; no awards give an empty result.

    Awards without a contract, a recipient or a positive amount are passed over; awards without an industry have one of
    their own. Repeated awards add to their contract's value; other columns have no effect.
    """
    details = json_details(**{c: F.col(c) for c in ("worst_award_id", "growth_ratio", "naics_code", "naics_avg_ratio", "z_score")})
    return result(worst_contracts(awards, threshold), "mod_growth", details)

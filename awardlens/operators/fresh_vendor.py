"""Early sole-source awards: large awards without competition soon after the recipient registered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clamp, json_details, sole_source
from .results import positive_awards, result

DAYS = 180


def early_awards(awards: DataFrame, entities: DataFrame, days: int = DAYS) -> DataFrame:
    """Sole-source awards 0 to ``days`` days after registration, scored. Both filters stand before the join on the recipient."""
    if days < 1:
        raise ValueError("days is 1 or more")
    left = positive_awards(awards).filter(F.col("award_date").isNotNull() & sole_source("competition_type")).select("award_id", F.col("recipient_uei").alias("uei"), "award_date", "total_obligation", "competition_type")
    right = entities.filter(F.col("registration_date").isNotNull()).select("uei", "registration_date")
    rows = left.join(right, "uei").withColumn("days_gap", F.datediff("award_date", "registration_date")).filter(F.col("days_gap").between(0, days))
    return rows.withColumn("score", clamp((1.0 - F.col("days_gap") / days) * (F.log10("total_obligation") / 7.0)))


def earliest_worst(awards: DataFrame, entities: DataFrame, days: int = DAYS) -> DataFrame:
    """The award of greatest score of each recipient; ties go to the least award id."""
    rows = early_awards(awards, entities, days)
    parts = F.struct("score", "days_gap", "registration_date", "award_date", "total_obligation", "competition_type")
    order = F.struct((-F.col("score")).alias("s"), F.coalesce("award_id", F.lit("")).alias("i"))
    return rows.groupBy("uei").agg(F.min_by(parts, order).alias("w")).select("uei", "w.*")


def detect_new_entity_sole_source(awards: DataFrame, entities: DataFrame, days: int = DAYS) -> DataFrame:
    """Recipients with a large award without competition soon after their registration; empty tables give an empty result.

    Awards without a recipient, a positive amount or a date, and entities without a registration date, are passed over.
    Repeated awards change nothing, as the worst one counts; other columns have no effect.
    """
    details = json_details(
        days_gap=F.col("days_gap"),
        registration_date=F.date_format("registration_date", "yyyy-MM-dd"),
        award_date=F.date_format("award_date", "yyyy-MM-dd"),
        total_obligation=F.col("total_obligation"),
        competition_type=F.col("competition_type"),
    )
    return result(earliest_worst(awards, entities, days), "new_entity", details)

"""Query op13: the whole conversations table damaged in a fixed way and repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .conversation_repair import ordered_turns, prepared, repair_report, repair_segments


def damaged(rows: DataFrame) -> DataFrame:
    """Prepared rows by crc32 of ``conv_id:turn`` modulo 20: 0 dropped, 1 emptied, 2 without .!?, 3 repeated, 4 given to the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = prepared(rows).withColumns({"text": text, "role": F.when(kind == 4, "user").otherwise(F.col("role")), "gone": kind == 0, "places": F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))})
    return changed.withColumn("place", F.explode("places")).drop("places")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ordered_turns(damaged(read(spark, sf_dir, "conversations")))
    return repair_report(turns, repair_segments(turns))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLES: dict[str, str] = {}

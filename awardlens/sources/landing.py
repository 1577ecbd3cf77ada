"""Parquet landing zone: tolerant scans, typed sinks."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.schemas import AWARDS, AWARDS_LANDING, aligned
from .scratch import exists, frugal, remove


def read_or_empty(spark: SparkSession, path: str | list[str], schema: StructType, skip_corrupt: bool = False) -> DataFrame:
    """Parquet files united by column name under ``schema`` (a missing column is null); nothing there gives no rows."""
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", skip_corrupt)
    try:
        return reader.parquet(*([path] if isinstance(path, str) else path))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_awards(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Landed awards in table types; numbers of offers beyond 32 bits become null."""
    return aligned(read_or_empty(spark, path, AWARDS_LANDING), AWARDS)


def award_recipients(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Distinct recipients of landed awards, unreadable files left out; only that column is read."""
    rows = read_or_empty(spark, path, AWARDS_LANDING, skip_corrupt=True)
    return rows.select(F.col("recipient_uei").alias("uei")).filter(F.col("uei") != "").distinct()


def write_typed(df: DataFrame, path: str, schema: StructType, partition_by: tuple[str, ...] = ()) -> None:
    """Write in the schema's order and types, with any partition columns after; an empty frame leaves a readable schema."""
    typed = aligned(df, schema)
    if partition_by:
        extra = [c for c in partition_by if c not in schema.names]
        typed = df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema], *extra)
    with frugal(df.sparkSession):
        typed.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet dataset; no column is read, so the footers answer."""
    return spark.read.parquet(path).count()


def awards_name(short: str, label: str, kind: str = "") -> str:
    """The name of a landed window of an agency: kind is empty, archive or bulk."""
    return f"awards_{short}_{label}{f'_{kind}' if kind else ''}.parquet"


def snapshots_name(day: str) -> str:
    return f"entity_snapshots_{day}.parquet"


def land(df: DataFrame, base: str, name: str, schema: StructType) -> int:
    """Write under ``base``/``name`` in table types; the rows written."""
    path = f"{base.rstrip('/')}/{name}"
    write_typed(df, path, schema)
    return row_count(df.sparkSession, path)


def land_labelled(awards: DataFrame, base: str) -> dict[str, int]:
    """Write awards (with agency_short and load_label) of any number of agencies and windows in one job, a folder for each.

    The rows written come back by agency. Only the folders that ``awards`` has rows for are replaced, so that a window can be
    loaded again; no rows leave a typed empty table. The rows are written once; which folders they went to is observed
    meanwhile, and these are counted by their footers.
    """
    spark, path = awards.sparkSession, f"{base.rstrip('/')}/awards_labelled.parquet"
    columns = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in AWARDS]
    before, seen = exists(spark, path), Observation()
    rows = awards.select(*columns, F.col("agency_short").cast("string").alias("agency_short"), F.col("load_label").cast("string").alias("load_label"))
    rows = rows.observe(seen, F.collect_set(F.to_json(F.struct("agency_short", "load_label"))).alias("folders"))
    with frugal(spark):
        rows.write.mode("overwrite").options(partitionOverwriteMode="dynamic", compression="zstd").partitionBy("agency_short", "load_label").parquet(path)
    folders = [json.loads(f) for f in seen.get["folders"]]
    if not folders:
        if not before:
            remove(spark, path)
        write_typed(spark.createDataFrame([], AWARDS), f"{base.rstrip('/')}/{awards_name('none', 'empty')}", AWARDS)
        return {}
    now = spark.createDataFrame([(f.get("agency_short") or None, f.get("load_label") or None) for f in folders], "a string, l string").distinct()
    held = spark.read.schema("agency_short string, load_label string").parquet(path).groupBy("agency_short", "load_label").count()
    match = F.col("agency_short").eqNullSafe(F.col("a")) & F.col("load_label").eqNullSafe(F.col("l"))
    return {r["agency_short"]: r["n"] for r in held.join(now, match, "left_semi").groupBy("agency_short").agg(F.sum("count").alias("n")).collect()}

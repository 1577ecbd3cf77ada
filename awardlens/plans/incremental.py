"""Incremental processing: policies, load windows, refresh lists, daily snapshots, date chunks under a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import fiscal_year_end, fiscal_year_start, midpoint
from ..functions.schemas import SNAPSHOTS
from ..sources.scratch import written

POLICY = "code string, name string, short string, award_types array<string>, award_amount_min double, seed_strategy string"
LOOKBACK_DAYS, STALE_DAYS = 7, 30
CAP, MOST_SPLITS = 10_000, 12
DEFAULT_TYPES, DEFAULT_STRATEGY = ("A", "B", "C", "D"), "paginate"


def agency_policy(spark: SparkSession, agencies: list[dict], defaults: dict) -> DataFrame:
    """One row per agency: its own settings, else the defaults', else fixed ones.

    Types and strategy also fall back where they are empty, the least amount only where it isn't given.
    """
    rows = spark.createDataFrame([tuple(a.get(k) for k in ("code", "name", "short", "award_types", "award_amount_min", "seed_strategy")) for a in ({**a, "award_amount_min": None if a.get("award_amount_min") is None else float(a["award_amount_min"])} for a in agencies)], POLICY)
    types = defaults.get("award_types") or list(DEFAULT_TYPES)
    return rows.withColumns(
        {
            "award_types": F.coalesce(F.when(F.size("award_types") > 0, F.col("award_types")), F.array(*[F.lit(t) for t in types])),
            "award_amount_min": F.coalesce("award_amount_min", F.lit(float(defaults.get("award_amount_min") or 0))),
            "seed_strategy": F.coalesce(F.nullif("seed_strategy", F.lit("")), F.lit(defaults.get("seed_strategy") or DEFAULT_STRATEGY)),
        }
    )


def fiscal_windows(spark: SparkSession, years: list[int]) -> DataFrame:
    """(label, start, end), a row per fiscal year."""
    rows = spark.createDataFrame([(y,) for y in years], "year int")
    return rows.select(F.col("year").cast("string").alias("label"), fiscal_year_start("year").alias("start"), fiscal_year_end("year").alias("end"))


def seed_plan(policy: DataFrame, windows: DataFrame) -> DataFrame:
    """(short, label, start, end, mode) of every agency and fiscal year; both sides are configuration, a row each."""
    return policy.crossJoin(windows).select("short", "label", "start", "end", F.col("seed_strategy").alias("mode"))


def load_windows(policy: DataFrame, awards: DataFrame, windows: DataFrame, today: Column) -> DataFrame:
    """From a week before an agency's newest award until today; agencies without awards are seeded."""
    newest = awards.filter(F.col("award_date").isNotNull()).groupBy(F.col("awarding_agency").alias("name")).agg(F.max("award_date").alias("newest"))
    joined = policy.join(newest, "name", "left")
    day = today.cast("date")
    known = joined.filter("newest is not null").select("short", F.concat(F.lit("incr_"), F.date_format(day, "yyyy-MM-dd")).alias("label"), F.date_sub("newest", LOOKBACK_DAYS).alias("start"), day.alias("end"), F.lit("paginate").alias("mode"))
    return known.unionByName(seed_plan(joined.filter("newest is null"), windows))


def rows_in_windows(rows: DataFrame, windows: DataFrame, policy: DataFrame, agency: str = "awarding_agency") -> DataFrame:
    """Rows of an agency of ``policy`` whose award date lies in one of its windows, as :func:`load_windows` or :func:`seed_plan` gives them.

    Both are configuration, a row per agency and window. A row in several windows comes once; rows without a date, or of an
    agency without windows, are left out.
    """
    w = windows.join(policy.select("short", F.col("name").alias("w_name")), "short").select("w_name", F.col("start").alias("w_start"), F.col("end").alias("w_end"))
    return rows.join(w, (F.col(agency) == F.col("w_name")) & F.col("award_date").between(F.col("w_start"), F.col("w_end")), "left_semi")


def write_worklist(recipients: DataFrame, path: str) -> DataFrame:
    """The distinct recipients of ``recipients`` (uei) in order, written to ``path`` and read back; null and empty ones are left out.

    Sorted files have ranges of their own, one after another, so that the sort is nobody's single task.
    """
    recipients.select("uei").filter(F.col("uei") != "").distinct().orderBy("uei").write.mode("overwrite").parquet(path)
    return recipients.sparkSession.read.schema("uei string").parquet(path)


def recipient_sample(awards: DataFrame, n: int) -> DataFrame:
    """(uei): at most ``n`` distinct recipients, those of the smallest digests, so that reruns agree. A limit is what it is for."""
    uei = F.col("recipient_uei").alias("uei")
    return awards.select(uei).filter(F.col("uei") != "").distinct().orderBy(F.md5("uei"), "uei").limit(n)


def refresh_list(recipients: DataFrame, entities: DataFrame, awards: DataFrame, as_of: Column, stale_days: int = STALE_DAYS) -> DataFrame:
    """(uei): recipients that have no entity yet, and entities with running awards that weren't pulled for ``stale_days`` days."""
    new = recipients.filter(F.col("uei") != "").select("uei").join(entities.select("uei"), "uei", "left_anti")
    running = awards.groupBy(F.col("recipient_uei").alias("uei")).agg(F.max("period_of_performance_end").alias("last_end")).filter(F.col("last_end") > as_of.cast("date"))
    old = entities.filter(F.col("last_pulled_at") < as_of.cast("timestamp_ntz") - F.expr(f"interval {int(stale_days)} days"))
    return new.union(old.select("uei").join(running, "uei", "left_semi")).distinct()


def snapshot_of(entities: DataFrame, day: Column) -> DataFrame:
    """Entities projected to the snapshot table, stamped with a day."""
    return entities.select(*[day.cast("date").alias(c) if c == "snapshot_date" else F.col(c) for c in SNAPSHOTS.names])


def build_snapshot(fresh: DataFrame, cached: DataFrame, day: Column) -> DataFrame:
    """One row per entity and day: those pulled afresh, and of the others what the table holds.

    Rows that repeat an entity stay as they are, the store takes one of a key; entities without an id are never pulled
    afresh, so that cached ones stay. Empty tables on either side leave the other.
    """
    rest = cached.join(fresh.select("uei"), "uei", "left_anti")
    return snapshot_of(fresh, day).unionByName(snapshot_of(rest, day))


def capped_date_chunks(rows: DataFrame, day: str, group: str, start: str, end: str, label: str, cap: int = CAP, most_splits: int = MOST_SPLITS) -> DataFrame:
    """(group, label, start, end, depth, rows, capped): each group's window, halved while a part has ``cap`` rows and more.

    The left half's label gains an a, the right one's a b. A day by itself, or a part at the last depth, stays and is marked.
    Rows are counted by day once; every day then knows its part at every depth, so that the parts of all depths are counted
    together. A group whose rows have no day within the window has one empty part; a null group is one of its own.
    """
    dated = F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    daily = rows.groupBy(F.col(group).alias("group"), F.when(dated, F.col(day)).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    root = F.struct(F.lit(label).alias("label"), F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"), F.lit(0).alias("depth"))

    def half(part: Column, left: Column | bool) -> Column:
        middle = midpoint(part["start"], part["end"])
        return F.struct(
            F.concat(part["label"], F.when(left, "a").otherwise("b")).alias("label"),
            F.when(left, part["start"]).otherwise(F.date_add(middle, 1)).alias("start"),
            F.when(left, middle).otherwise(part["end"]).alias("end"),
            (part["depth"] + 1).alias("depth"),
        )

    def deeper(parts: Column, _: Column) -> Column:
        last = F.element_at(parts, -1)
        return F.when(last["start"] < last["end"], F.concat(parts, F.array(half(last, F.col("day") <= midpoint(last["start"], last["end"]))))).otherwise(parts)

    below = F.sequence(F.lit(1), F.lit(most_splits)) if most_splits else F.array().cast("array<int>")
    parts = daily.withColumn("part", F.explode(F.when(F.col("day").isNotNull(), F.aggregate(below, F.array(root), deeper)).otherwise(F.array(root))))
    counted = parts.groupBy("group", "part").agg(F.sum(F.when(F.col("day").isNotNull(), F.col("n")).otherwise(0)).alias("rows"))
    splits = (F.col("rows") >= cap) & (F.col("part.depth") < most_splits) & (F.col("part.start") < F.col("part.end"))
    counted = written(counted.withColumn("splits", splits), "date-parts")
    halves = counted.filter("splits").select("group", F.explode(F.array(half(F.col("part"), F.lit(True)), half(F.col("part"), F.lit(False)))).alias("part"))
    offered = halves.unionByName(counted.filter("part.depth = 0").select("group", "part"))
    known = counted.select(F.col("group").alias("k_group"), F.col("part").alias("k_part"), "rows", "splits")
    leaves = offered.join(known, F.col("group").eqNullSafe(F.col("k_group")) & (F.col("part") == F.col("k_part")), "left").filter(~F.coalesce("splits", F.lit(False)))
    count = F.coalesce("rows", F.lit(0)).cast("long")
    return leaves.select("group", "part.label", "part.start", "part.end", "part.depth", count.alias("rows"), (count >= cap).alias("capped"))

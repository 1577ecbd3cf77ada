"""Award summaries in CSV archives, mapped to the awards table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import AWARD_TYPES, award_date, column, whole_number
from ..functions.schemas import AWARDS
from .csv_blocks import csv_records
from .landing import land_labelled
from .listing import prime_files

#: The source columns of each target column, the first that a file has is taken.
CANDIDATES = {
    "award_id": ["contract_award_unique_key", "award_id_piid", "generated_internal_id"],
    "parent_award_id": ["parent_award_id_piid", "parent_award_unique_key"],
    "recipient_name": ["recipient_name"],
    "recipient_uei": ["recipient_uei"],
    "awarding_agency": ["awarding_agency_name"],
    "awarding_sub_agency": ["awarding_sub_agency_name"],
    "award_type": ["award_type", "type_of_contract_pricing"],
    "award_description": ["prime_award_base_transaction_description", "transaction_description", "award_description"],
    "naics_code": ["naics_code"],
    "naics_description": ["naics_description"],
    "total_obligation": ["total_dollars_obligated", "current_total_value_of_award"],
    "base_and_all_options_value": ["base_and_all_options_value", "potential_total_value_of_award"],
    "period_of_performance_start": ["period_of_performance_start_date"],
    "period_of_performance_end": ["period_of_performance_current_end_date", "period_of_performance_potential_end_date"],
    "award_date": ["action_date", "last_modified_date"],
    "competition_type": ["extent_competed"],
    "number_of_offers": ["number_of_offers_received"],
    "modification_number": ["modification_number"],
}

HEADERS_AT_ONCE = 8


def scan_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text: inference would make numbers of ids. Columns that aren't used later aren't parsed.

    Quoted values may hold line breaks, commas and doubled quotes; a file is nevertheless read by as many tasks as it has
    blocks (:mod:`.csv_blocks`). Rows that are too short have nulls at their end, further values are passed over.
    """
    header = csv_header(spark, path)
    if not header:
        return spark.read.option("header", True).csv(path)
    columns = ", ".join(f"`{c.replace('`', '``')}` string" for c in header)
    return csv_records(spark, path).select(F.from_csv("record", columns, {"escape": '"', "mode": "PERMISSIVE"}).alias("r")).select("r.*")


def csv_header(spark: SparkSession, path: str | list[str]) -> tuple[str, ...]:
    """The columns that a file's first line names, of several files the first one's; none for an empty file."""
    return tuple(spark.read.option("header", True).option("escape", '"').csv(path).columns)


def map_awards(raw: DataFrame, agency: str | Column, pulled_at: Column, metric: str = "mapping") -> DataFrame:
    """Rows of one header in table order, with bad values as nulls; rows without an id are observed under ``metric`` as dropped.

    ``agency`` fills missing agency names. Files of other headers are mapped on their own and united.
    """
    have = set(raw.columns)

    def target(name: str, kind) -> Column:
        source = next((c for c in CANDIDATES.get(name, []) if c in have), None)
        if source is None:
            return F.lit(None).cast(kind)
        text = F.nullif(F.col(f"`{source}`"), F.lit(""))
        made = {"date": award_date, "integer": whole_number}.get(kind.typeName())
        return made(text) if made else text.try_cast(kind)

    named = {f.name: target(f.name, f.dataType) for f in AWARDS if f.name != "pulled_at"}
    named["awarding_agency"] = F.coalesce(named["awarding_agency"], F.lit(agency) if isinstance(agency, str) else agency)
    named["pulled_at"] = pulled_at.cast("timestamp_ntz")
    mapped = raw.select(*[named[f.name].alias(f.name) for f in AWARDS])
    return mapped.observe(metric, F.count_if(F.col("award_id").isNull()).alias("dropped")).filter(F.col("award_id").isNotNull())


def policy_keeps(award_types: Column | str, least_amount: Column | str) -> Column:
    """Whether an award passes its agency's policy: arrays of type codes, and a least amount.

    All four codes, no codes or none that is known mean no filter; with one, awards without a type go. An amount counts
    from above 0; a missing one is 0 then.
    """
    codes, least = column(award_types), F.coalesce(column(least_amount).cast("double"), F.lit(0.0))
    table = F.create_map(*[F.lit(x) for pair in AWARD_TYPES.items() for x in pair])
    known = F.filter(F.transform(codes, lambda c: F.element_at(table, c)), lambda d: d.isNotNull())
    every = F.size(F.array_except(codes, F.array(*[F.lit(c) for c in AWARD_TYPES]))) == 0
    no_filter = codes.isNull() | (F.size(codes) == 0) | (every & (F.size(F.array_distinct(codes)) == len(AWARD_TYPES))) | (F.size(known) == 0)
    right_type = F.coalesce(F.array_contains(known, F.upper("award_type")), F.lit(False))
    return (F.coalesce(no_filter, F.lit(True)) | right_type) & ((least <= 0) | (F.coalesce("total_obligation", F.lit(0.0)) >= least))


def apply_policy(awards: DataFrame, policy: DataFrame) -> DataFrame:
    """Awards that pass their agency's row of ``policy`` (name, award_types, award_amount_min); others' agencies pass whole.

    The policy has a row per agency, so it is small against the awards; Spark broadcasts it below its size threshold. Awards
    without an agency pass; repeated ones stay; a missing amount is 0. Other columns of the policy have no effect.
    """
    chosen = policy.select(F.col("name").alias("p_name"), F.col("award_types").alias("p_types"), F.col("award_amount_min").alias("p_least"))
    joined = awards.join(chosen, F.col("awarding_agency") == F.col("p_name"), "left")
    return joined.filter(policy_keeps("p_types", "p_least")).select(*awards.columns)


def archive_awards(spark: SparkSession, files: list[tuple[str, str]], policy: DataFrame, pulled_at: Column) -> DataFrame:
    """The awards of CSV archives, given as (path, agency name): one job over all files and agencies.

    Files of one agency and header are read together, so that the plan grows with these and not with the files. Empty files
    are passed over; without any file with columns the result is empty. Rows without an id are counted under a metric per
    group, mapping-0 and so on, and left out; repeated rows stay.
    """
    groups: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        headers = list(pool.map(lambda f: csv_header(spark, f[0]), files))
    for (path, agency), header in zip(files, headers, strict=True):
        if header:
            groups.setdefault((agency, header), []).append(path)
    frames = [map_awards(scan_csv(spark, paths), agency, pulled_at, f"mapping-{k}") for k, ((agency, _), paths) in enumerate(sorted(groups.items()))]
    if not frames:
        return spark.createDataFrame([], AWARDS)
    return apply_policy(reduce(DataFrame.unionByName, frames), policy)


def archive_job(spark: SparkSession, members: DataFrame, policy: DataFrame, pulled_at: Column, landing: str, label: str) -> dict[str, int]:
    """Archives' CSV members to landed awards: members are chosen, mapped, filtered and written by agency under ``label``.

    ``members`` has a row per file: snapshot (its archive), file_name, path, agency and length in bytes. It is a listing, so its
    rows fit on the driver. Rows of an agency without a policy pass whole and land under the agency's name. The rows
    landed are returned by agency; an archive without a usable member lands a typed empty table.
    """
    chosen = prime_files(members).filter("length > 0").select("path", "agency").distinct().orderBy("path").collect()
    awards = archive_awards(spark, [(r["path"], r["agency"]) for r in chosen], policy, pulled_at)
    shorts = policy.select(F.col("name").alias("s_name"), "short")
    named = awards.join(shorts, F.col("awarding_agency") == F.col("s_name"), "left").withColumn("agency_short", F.coalesce("short", "awarding_agency"))
    return land_labelled(named.withColumn("load_label", F.lit(label)), landing)

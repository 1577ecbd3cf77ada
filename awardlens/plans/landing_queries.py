"""Queries over landed files: archives, labelled partitions, loads, streams, samples, and the detectors' details."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import fiscal_year_of, snapshot_key
from ..functions.schemas import AWARDS, AWARDS_LANDING, ENTITIES, SNAPSHOTS
from ..operators.benford import detect_benford
from ..operators.fresh_vendor import detect_new_entity_sole_source
from ..operators.growth import detect_mod_growth
from ..operators.quantiles import exact_quantile
from ..operators.results import all_detectors, contract_violations
from ..sources.csv_awards import archive_job
from ..sources.landing import award_recipients, awards_name, land, land_labelled, read_awards, row_count, snapshots_name
from ..sources.scratch import collected, frugal, remove, scratch_path, written
from ..streaming.ingest import ingest
from .bindings import AS_OF, AWARDS_SQL, ENTITIES_SQL, awards, entities
from .incremental import agency_policy, build_snapshot, fiscal_windows, load_windows, recipient_sample, rows_in_windows, write_worklist
from .policies import AGENCIES, DEFAULTS, POLICY_ROWS, YEARS
from .store import Store

SHARES = (0.0, 0.05, 0.5, 0.95, 1.0)
SAMPLE = 25
ARCHIVE_TASK_ROWS = 1_000_000  # that a task deals to files by agency at least; never more tasks than cores, as every file's header is read on its own
#: Archive headers: the columns of prime files, by which half of the agencies' names they are for.
HEADERS = {
    "first": {"contract_award_unique_key": "award_id", "award_type": "award_type", "total_dollars_obligated": "total_obligation", "action_date": "award_date"},
    "second": {"award_id_piid": "award_id", "type_of_contract_pricing": "award_type", "current_total_value_of_award": "total_obligation", "last_modified_date": "award_date"},
}


def _stamp():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """A landing folder with all awards, entities and snapshots under their labels."""
    base = scratch_path(spark, "landing")
    a, e = awards(spark, sf_dir), entities(spark, sf_dir)
    land(a, base, awards_name("all", AS_OF, "bulk"), AWARDS_LANDING)
    land(e, base, "entities.parquet", ENTITIES)
    land(build_snapshot(e, e.limit(0), F.lit(AS_OF)), base, snapshots_name(AS_OF), SNAPSHOTS)
    return base


def archive_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All awards as archive members (prime files of two headers, subaward files, a readme), through the archive job, as landed.

    The awards are written once, and not shuffled by agency: a task keeps a file open for each. They go once they are archived,
    and the archives once they have landed.
    """
    base = scratch_path(spark, "archives")
    needed = ["award_id", "awarding_agency", "award_type", "total_obligation", "award_date", "modification_number"]
    with collected() as made:
        rows = written(awards(spark, sf_dir).select(*needed), "archived", compression="zstd")
    rows = rows.coalesce(max(1, min(spark.sparkContext.defaultParallelism, rows.count() // ARCHIVE_TASK_ROWS)))
    text = F.concat(F.lit('first line\n"second", '), F.col("award_id")).alias("transaction_description")
    for name, columns in HEADERS.items():
        own = rows.filter(F.col("awarding_agency") < "NATION_2" if name == "first" else F.col("awarding_agency") >= "NATION_2")
        out = own.select(*[F.col(c).cast("string").alias(k) for k, c in columns.items()], text, F.col("awarding_agency").alias("agency"))
        with frugal(spark):
            out.write.option("header", True).option("escape", '"').partitionBy("agency").csv(f"{base}/{name}_PrimeAwardSummaries")
    subs = rows.filter("modification_number = '0'").select(F.concat(F.lit("sub"), "award_id").alias("award_id_piid"), F.col("awarding_agency").alias("agency"))
    with frugal(spark):
        subs.write.option("header", True).partitionBy("agency").csv(f"{base}/Contracts_Subawards")
    remove(spark, *made)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "length")
    part = F.split("path", "/")
    agency = F.url_decode(F.regexp_extract("path", "agency=([^/]*)/", 1))
    members = listing.filter(F.element_at(part, -1).startswith("part-")).select(agency.alias("snapshot"), agency.alias("agency"), F.concat_ws("_", F.element_at(part, -3), F.element_at(part, -1)).alias("file_name"), "path", "length")
    landing = scratch_path(spark, "landing")
    archive_job(spark, members, agency_policy(spark, AGENCIES, DEFAULTS), _stamp(), landing, AS_OF)
    remove(spark, base)
    landed = spark.read.parquet(f"{landing}/awards_labelled.parquet")
    return landed.select("award_id", F.col("awarding_agency"), "award_type", "award_description", "total_obligation", "award_date", "agency_short", F.col("load_label").cast("string").alias("load_label"), "pulled_at")


def labelled_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awards landed by agency and fiscal year, and the rows of each partition."""
    base = scratch_path(spark, "landing")
    year = fiscal_year_of("award_date").cast("string")
    land_labelled(awards(spark, sf_dir).withColumns({"agency_short": F.col("awarding_agency"), "load_label": F.concat(F.lit("FY"), year)}), base)
    landed = spark.read.parquet(f"{base}/awards_labelled.parquet")  # partition columns are found by their folders
    return landed.groupBy("agency_short", "load_label").agg(F.count(F.lit(1)).alias("rows"), F.max("award_date").alias("newest"))


def snapshot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives' names for each agency code and fiscal year of the awards."""
    days = awards(spark, sf_dir).groupBy(F.col("awarding_agency").alias("name"), fiscal_year_of("award_date").alias("year")).agg(F.date_format(F.max("award_date"), "yyyyMMdd").alias("day"))
    return days.join(agency_policy(spark, AGENCIES, DEFAULTS), "name").select("short", "year", snapshot_key("code", "year", "day").alias("key"))


def rows_of_load_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The awards that an incremental load brings: those in their agencies' windows."""
    policy, a = agency_policy(spark, AGENCIES, DEFAULTS), awards(spark, sf_dir)
    windows = load_windows(policy, a, fiscal_windows(spark, YEARS), F.lit(AS_OF))
    return rows_in_windows(a, windows, policy).select("award_id", "awarding_agency", "award_date")


def store_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each table of the store gains from the landing folder, loaded twice: the second time nothing."""
    base, store = _landed(spark, sf_dir), Store(spark, scratch_path(spark, "store"))
    first, again = store.load_all(base), store.load_all(base)
    return spark.createDataFrame([(t, first[t], again[t]) for t in sorted(first)], "name string, gained long, gained_again long")


def streamed_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The awards table of a store that a stream of landed files has filled."""
    base, store = _landed(spark, sf_dir), Store(spark, scratch_path(spark, "store"))
    store.init()
    ingest(spark, "awards", f"{base}/{awards_name('all', AS_OF, 'bulk')}", store, scratch_path(spark, "stream")).awaitTermination()
    return store.read("awards").select("award_id", "recipient_uei", "total_obligation", "award_date")


def landed_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted list of recipients of all landed awards, as its sink has it."""
    base = _landed(spark, sf_dir)
    return write_worklist(award_recipients(spark, f"{base}/awards_*.parquet"), scratch_path(spark, "worklist"))


def landed_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each landed table, and the awards' columns in order."""
    base = _landed(spark, sf_dir)
    rows = [(name, row_count(spark, f"{base}/{file}")) for name, file in (("awards", awards_name("all", AS_OF, "bulk")), ("entities", "entities.parquet"), ("entity_snapshots", snapshots_name(AS_OF)))]
    columns = ",".join(read_awards(spark, f"{base}/awards_*.parquet").columns)
    return spark.createDataFrame([(*r, columns) for r in rows], "name string, rows long, award_columns string")


def sampled_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipient_sample(awards(spark, sf_dir), SAMPLE)


def obligation_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of all amounts, as the isolation detector cuts its scores."""
    values = written(awards(spark, sf_dir).select("total_obligation"), "amounts")
    return spark.createDataFrame([(q, round(exact_quantile(values, "total_obligation", q), 6)) for q in SHARES], "share double, value double")


def detector_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The details of three detectors' results, a row per field: numbers rounded, all else as text."""
    a, e = written(awards(spark, sf_dir), "awards"), entities(spark, sf_dir)
    rows = all_detectors(detect_benford(a), detect_mod_growth(a), detect_new_entity_sole_source(a, e))
    flat = rows.select("uei", "detector", F.explode(F.from_json("details", "map<string,string>")).alias("field", "text"))
    nested = F.col("text").startswith("{")
    inner = flat.filter(nested).select("uei", "detector", "field", F.explode(F.from_json("text", "map<string,string>")).alias("k", "text")).withColumn("field", F.concat_ws(".", "field", "k")).drop("k")
    out = flat.filter(~F.coalesce(nested, F.lit(False))).unionByName(inner)
    number = F.col("text").try_cast("double")
    return out.select("uei", "detector", "field", F.round(number, 5).alias("number"), F.when(number.isNull(), F.col("text")).alias("text"))


def detector_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and contract violations of the three detectors that SQL can count."""
    a, e = written(awards(spark, sf_dir), "awards"), entities(spark, sf_dir)
    rows = written(all_detectors(detect_benford(a), detect_mod_growth(a), detect_new_entity_sole_source(a, e)), "results")
    broken = contract_violations(rows).groupBy("detector").agg(F.count(F.lit(1)).alias("violations"))
    return rows.groupBy("detector").agg(F.count(F.lit(1)).alias("rows")).join(broken, "detector", "left").select("detector", "rows", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))


QUERIES = {
    "archive_landing": archive_landing,
    "labelled_partitions": labelled_partitions,
    "snapshot_keys": snapshot_keys,
    "rows_of_load_windows": rows_of_load_windows,
    "store_load": store_load,
    "streamed_awards": streamed_awards,
    "landed_recipients": landed_recipients,
    "landed_row_counts": landed_row_counts,
    "sampled_recipients": sampled_recipients,
    "obligation_quantiles": obligation_quantiles,
    "detector_details": detector_details,
    "detector_contract": detector_contract,
}


def _with(*parts: str, select: str) -> str:
    return "WITH " + ", ".join(parts) + " " + select


_FISCAL = "year(award_date + INTERVAL 3 MONTH)"
_CODES = "codes(short, code) AS (VALUES ('FR', '075'), ('CN', '097'), ('BR', '012'), ('NW', '1234'), ('N0', '070'), ('N7', '089'), ('N15', '9700'))"
_WINDOWS = f"""newest AS (SELECT awarding_agency AS name, MAX(award_date) AS m FROM awards GROUP BY 1),
windows AS (SELECT name, m - 7 AS a, DATE '{AS_OF}' AS b FROM policy JOIN newest USING (name)
  UNION ALL SELECT name, make_date(y - 1, 10, 1), make_date(y, 9, 30) FROM policy ANTI JOIN newest USING (name), (SELECT unnest({YEARS}) AS y))"""

ORACLES = {
    "archive_landing": _with(
        AWARDS_SQL, POLICY_ROWS,
        select=f"""SELECT award_id, awarding_agency, award_type, 'first line' || chr(10) || '"second", ' || award_id AS award_description, total_obligation, award_date,
  COALESCE(short, awarding_agency) AS agency_short, '{AS_OF}' AS load_label, TIMESTAMP '{AS_OF}' AS pulled_at FROM awards LEFT JOIN policy ON awarding_agency = name
  WHERE (types IS NULL OR list_contains(types, upper(award_type))) AND (COALESCE(least, 0) <= 0 OR COALESCE(total_obligation, 0) >= least)""",
    ),
    "labelled_partitions": _with(AWARDS_SQL, select=f"SELECT awarding_agency AS agency_short, 'FY' || {_FISCAL} AS load_label, "
        f"COUNT(*)::BIGINT AS rows, MAX(award_date) AS newest FROM awards GROUP BY 1, 2"),
    "snapshot_keys": _with(
        AWARDS_SQL, POLICY_ROWS, _CODES,
        select=f"""SELECT short, y::INT AS year, 'FY' || y || '_' || code || '_Contracts_Full_' || strftime(d, '%Y%m%d') || '.zip' AS key
  FROM (SELECT awarding_agency AS name, {_FISCAL} AS y, MAX(award_date) AS d FROM awards GROUP BY 1, 2) JOIN policy USING (name) JOIN codes USING (short)""",
    ),
    "rows_of_load_windows": _with(AWARDS_SQL, POLICY_ROWS, _WINDOWS, select="SELECT award_id, awarding_agency, award_date FROM awards a "
        "WHERE EXISTS (SELECT 1 FROM windows w WHERE w.name = a.awarding_agency AND a.award_date BETWEEN w.a AND w.b)"),
    "store_load": _with(
        AWARDS_SQL, ENTITIES_SQL,
        select="""SELECT 'awards' AS name, COUNT(DISTINCT award_id)::BIGINT AS gained, 0::BIGINT AS gained_again FROM awards
  UNION ALL SELECT 'entities', COUNT(*)::BIGINT, 0 FROM entities UNION ALL SELECT 'entity_snapshots', COUNT(*)::BIGINT, 0 FROM entities""",
    ),
    "streamed_awards": _with(AWARDS_SQL, select="SELECT award_id, recipient_uei, total_obligation, award_date FROM awards"),
    "landed_recipients": _with(AWARDS_SQL, select="SELECT DISTINCT recipient_uei AS uei FROM awards WHERE recipient_uei <> ''"),
    "landed_row_counts": _with(
        AWARDS_SQL, ENTITIES_SQL, f"c AS (SELECT '{','.join(AWARDS.names)}' AS award_columns)",
        select="""SELECT 'awards' AS name, COUNT(*)::BIGINT AS rows, MIN(award_columns) AS award_columns FROM awards, c
  UNION ALL SELECT unnest(['entities', 'entity_snapshots']), COUNT(*)::BIGINT, MIN(award_columns) FROM entities, c""",
    ),
    "sampled_recipients": _with(AWARDS_SQL, select=f"SELECT uei FROM (SELECT DISTINCT recipient_uei AS uei FROM awards WHERE "
        f"recipient_uei <> '') ORDER BY md5(uei), uei LIMIT {SAMPLE}"),
    "obligation_quantiles": _with(AWARDS_SQL, select=" UNION ALL ".join(f"SELECT {q}::DOUBLE AS share, "
        f"ROUND(quantile_cont(total_obligation, {q}), 6) AS value FROM awards" for q in SHARES)),
}

"""The engine's queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import EXPECTED_DIGITS
from ..functions.schemas import AWARDS, SNAPSHOTS
from ..operators.benford import benford_statistics, detect_benford, digit_histogram
from ..operators.fresh_vendor import detect_new_entity_sole_source, earliest_worst
from ..operators.growth import detect_mod_growth, growth_ratios, worst_contracts
from ..operators.isolation import CONTAMINATION, FEATURES, detect_isolation_outlier, imputed, recipient_features, scaled
from ..operators.maintained import combined, state_changes
from ..operators.results import all_detectors, top
from ..sources.csv_awards import apply_policy, map_awards, scan_csv
from ..sources.json_records import award_records, entity_records
from ..sources.listing import latest_snapshot, prime_files
from ..sources.scratch import scratch_path, written
from .bindings import AS_OF, AWARDS_SQL, ENTITIES_SQL, NEW_AWARDS_FROM, as_awards, awards, entities, line_items, with_parts
from . import landing_queries
from .forest_sql import FOREST_SQL
from .incremental import agency_policy, build_snapshot, capped_date_chunks, fiscal_windows, load_windows, refresh_list, seed_plan
from .policies import AGENCIES, DEFAULTS, POLICY_ROWS, YEARS
from .store import Store, ranked_per_key


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _stamp(day: str = AS_OF) -> Column:
    return F.lit(day).cast("timestamp_ntz")


def leading_digit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digit_histogram(awards(spark, sf_dir))


def benford_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(benford_statistics(awards(spark, sf_dir)).select("uei", "n", "ks_statistic", "p_value", "score"))


def mod_growth_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(growth_ratios(awards(spark, sf_dir)))


def mod_growth_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(worst_contracts(awards(spark, sf_dir)))


def new_entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(earliest_worst(awards(spark, sf_dir), entities(spark, sf_dir)))


def isolation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recipient_features(awards(spark, sf_dir), entities(spark, sf_dir), AS_OF))


def isolation_features_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features are written once, as the median and the ends are taken over all of them."""
    features = written(recipient_features(awards(spark, sf_dir), entities(spark, sf_dir), AS_OF), "isolation-ages")
    return _rounded(scaled(written(imputed(features), "isolation-features")))


def isolation_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest's outliers with the numbers of their details."""
    found = detect_isolation_outlier(awards(spark, sf_dir), entities(spark, sf_dir), AS_OF)
    told = found.select("uei", "score", F.from_json("details", f"feature_vector struct<{', '.join(f'{c}: double' for c in FEATURES)}>, raw_anomaly_score double, contamination_param double").alias("d"))
    return _rounded(told.select("uei", "score", "d.raw_anomaly_score", "d.contamination_param", "d.feature_vector.*"))


def detector_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, e = written(awards(spark, sf_dir), "awards"), entities(spark, sf_dir)
    rows = all_detectors(detect_benford(a), detect_mod_growth(a), detect_new_entity_sole_source(a, e), detect_isolation_outlier(a, e, AS_OF))
    return _rounded(rows.select("uei", "detector", "score"))


def top_entities_by_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, e = written(awards(spark, sf_dir), "awards"), entities(spark, sf_dir)
    frames = (detect_benford(a), detect_mod_growth(a), detect_new_entity_sole_source(a, e))
    return all_detectors(*[top(f.withColumn("score", F.round("score", 6))) for f in frames]).select("uei", "detector", "score")


def _pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per id and batch (years up to 2000, then later ones): the latest pull, then the greatest part and supplier.

    Line items are dealt by order and ranked as they are; the first ones meet their orders there, as all rows of an id have one order,
    and awards, several times as wide, are made of these. Suppliers and nations are few enough to be broadcast after the shuffle.
    """
    rows = with_parts(spark, sf_dir, with_parts(spark, sf_dir, line_items(spark, sf_dir), "part").repartition("l_orderkey"), "supplier", "nation")
    rows = rows.withColumn("late", F.to_date("l_shipdate") >= NEW_AWARDS_FROM)
    first = ranked_per_key(rows, ["l_orderkey", "l_linenumber", "late"], F.desc(F.col("l_shipdate").cast("timestamp_ntz")), F.desc("l_partkey"), F.desc("l_suppkey"))
    return as_awards(with_parts(spark, sf_dir, first, "orders"), pulls=True)


def upsert_replace_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The awards table of a store after two loads: the pulls up to 2000, and later ones of partly the same awards."""
    rows, store = written(_pulls(spark, sf_dir).select("late", *AWARDS.names), "pulls", compression="zstd"), Store(spark, scratch_path(spark, "store"))
    store.init()
    for late in (False, True):
        store.load("awards", rows.filter(F.col("late") == late))
    return store.read("awards").select("award_id", "recipient_uei", "total_obligation", "award_date", "pulled_at")


def maintained_digit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit counts per recipient after two loads, summed from what either load changed."""
    rows, store = written(_pulls(spark, sf_dir).select("late", *AWARDS.names), "pulls", compression="zstd"), Store(spark, scratch_path(spark, "store"))
    store.init()
    parts = []
    for late in (False, True):
        store.load("awards", rows.filter(F.col("late") == late))
        parts.append(state_changes(store.changes("awards", store.version("awards")[0], ["recipient_uei", "total_obligation"])))
    return combined(*parts)


def append_ignore_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = build_snapshot(entities(spark, sf_dir).filter("registration_date < date '1998-01-01'"), entities(spark, sf_dir).limit(0), F.lit(AS_OF))
    new = build_snapshot(entities(spark, sf_dir).withColumn("legal_business_name", F.lit("renamed")), entities(spark, sf_dir).limit(0), F.lit(AS_OF))
    store = Store(spark, scratch_path(spark, "store"))
    store.init()
    for rows in (old, new):
        store.load("entity_snapshots", rows)
    return store.read("entity_snapshots").select("uei", "snapshot_date", "legal_business_name")


def entity_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = awards(spark, sf_dir)
    return refresh_list(a.select(F.col("recipient_uei").alias("uei")), entities(spark, sf_dir), a, F.lit("2000-06-01"))


def new_ueis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return awards(spark, sf_dir).select(F.col("recipient_uei").alias("uei")).distinct().join(entities(spark, sf_dir), "uei", "left_anti")


def snapshot_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir)
    fresh = e.filter("registration_date >= date '1998-01-01'").withColumn("legal_business_name", F.upper("legal_business_name"))
    return build_snapshot(fresh, e, F.lit(AS_OF)).select(*SNAPSHOTS.names[:3])


def high_watermark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_windows(agency_policy(spark, AGENCIES, DEFAULTS), awards(spark, sf_dir), fiscal_windows(spark, YEARS), F.lit(AS_OF))


def seed_plan_of_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal years are those of the awards, so the plan follows the table."""
    years = awards(spark, sf_dir).select(F.year(F.add_months("award_date", 3)).alias("year")).distinct()
    windows = years.select(F.col("year").cast("string").alias("label"), F.make_date(F.col("year") - 1, F.lit(10), F.lit(1)).alias("start"), F.make_date("year", F.lit(9), F.lit(30)).alias("end"))
    return seed_plan(agency_policy(spark, AGENCIES, DEFAULTS), windows)


def capped_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window is that of the awards, so that every one is in a chunk."""
    rows = written(awards(spark, sf_dir).select(F.upper("award_type").alias("kind"), "award_date"), "award-dates")
    ends = rows.agg(F.min("award_date").alias("a"), F.max("award_date").alias("b")).first()
    return capped_date_chunks(rows, "award_date", "kind", str(ends["a"]), str(ends["b"]), "x")


def policy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = apply_policy(awards(spark, sf_dir), agency_policy(spark, AGENCIES, DEFAULTS))
    return kept.select("award_id", "awarding_agency", "award_type", "total_obligation")


def award_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return awards(spark, sf_dir).groupBy("award_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "award_type")


def joined_sample_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir).select("uei", "legal_business_name")
    rows = awards(spark, sf_dir).join(e, F.col("recipient_uei") == F.col("uei"), "left").filter("uei is not null")
    return rows.groupBy("awarding_agency").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uei").alias("n_entities"))


def json_award_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = awards(spark, sf_dir)
    zero = F.when(F.col("modification_number") == "0", 0.0).otherwise(F.col("total_obligation"))
    record = F.struct(
        F.col("award_id").alias("Award ID"), F.col("parent_award_id").alias("Parent Award ID"), F.col("recipient_uei").alias("recipient_uei"), F.lit("").alias("Recipient UEI"),
        F.when(F.col("awarding_agency") != "FRANCE", F.col("awarding_agency")).alias("Awarding Agency"), F.col("award_type").alias("Award Type"),
        F.struct(F.col("naics_code").alias("code"), F.lower("naics_code").alias("description")).alias("NAICS"), zero.alias("Total Obligations"), (F.col("total_obligation") * 2).alias("Award Amount"),
        F.concat(F.date_format("award_date", "yyyy-MM-dd"), F.lit("T10:00:00")).alias("Action Date"), F.lit("null").alias("Start Date"), F.lit("3.0").alias("Number of Offers Received"), F.col("modification_number").alias("Mod Number"),
    )
    lines = a.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))
    out = award_records(lines, "FILLED", _stamp())
    return out.select("award_id", "parent_award_id", "recipient_uei", "awarding_agency", "award_type", "naics_code", "naics_description", F.round("total_obligation", 2).alias("total_obligation"), "period_of_performance_start", "award_date", "number_of_offers", "modification_number")


def json_entity_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, odd = entities(spark, sf_dir), F.col("uei").endswith("1")
    kinds = F.array(F.struct(F.lit("Small").alias("businessTypeDesc"), F.lit("2X").alias("businessTypeCode")), F.struct(F.lit(None).cast("string").alias("businessTypeDesc"), F.substring("uei", 2, 1).alias("businessTypeCode")))
    record = F.struct(
        F.struct(F.when(~odd, F.col("uei")).alias("ueiSAM"), F.when(odd, F.col("uei")).alias("uei"), F.col("legal_business_name").alias("legalBusinessName"), F.when(odd, "").otherwise(F.date_format("registration_date", "yyyy-MM-dd")).alias("registrationDate"), F.date_format("registration_date", "M/d/yyyy").alias("activationDate")).alias("entityRegistration"),
        F.struct(F.struct(F.lit("TX").alias("state")).alias("physicalAddress"), F.struct(kinds.alias("businessTypeList")).alias("businessTypes")).alias("coreData"),
    )
    out = entity_records(e.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value")), _stamp())
    return out.select("uei", "legal_business_name", "physical_state", "business_type", "registration_date")


def csv_award_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The awards written as CSV with archive headers, descriptions with line breaks and quotes among them, scanned again and mapped."""
    names = {
        "contract_award_unique_key": "award_id", "recipient_uei": "recipient_uei", "awarding_agency_name": "awarding_agency", "type_of_contract_pricing": "award_type",
        "current_total_value_of_award": "total_obligation", "action_date": "award_date", "extent_competed": "competition_type", "modification_number": "modification_number",
    }
    path = scratch_path(spark, "csv")
    text = F.concat(F.lit('line one\nsays "two", of '), F.col("award_id")).alias("award_description")
    raw = awards(spark, sf_dir).select(*[F.col(c).cast("string").alias(name) for name, c in names.items()], text, F.lit("x").alias("number_of_offers_received"), F.lit("unused").alias("other"))
    raw.write.option("header", True).option("escape", '"').csv(path)
    out = map_awards(scan_csv(spark, path), "FILLED", _stamp())
    return out.select(
        "award_id", "recipient_uei", "awarding_agency", "award_type", "award_description", "total_obligation", "award_date", "competition_type", "number_of_offers", "modification_number", "pulled_at"
    )


def latest_snapshot_by_agency(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("award_type") == "DELIVERY ORDER", "Contracts_Full").otherwise("Contracts_Delta")
    text = F.concat(F.lit("<Key>FY2024_075_"), kind, F.lit("_"), F.date_format("award_date", "yyyyMMdd"), F.lit(".zip</Key>"))
    return latest_snapshot(awards(spark, sf_dir).select("awarding_agency", text.alias("text")), by=("awarding_agency",))


def prime_file_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(F.lit("Contracts_PrimeAwardSummaries_"), F.lit("Contracts_Subawards_"), F.lit("Contracts_"))
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select((k % 50).alias("snapshot"), F.concat(F.element_at(kinds, (F.when(k % 50 < 25, k % 3).otherwise(1 + k % 2) + 1).cast("int")), k.cast("string"), F.when(k % 11 == 0, ".txt").otherwise(".csv")).alias("file_name"))
    return prime_files(rows)


QUERIES = {
    "leading_digit_histogram": leading_digit_histogram, "benford_scores": benford_scores, "mod_growth_ratios": mod_growth_ratios, "mod_growth_scores": mod_growth_scores,
    "new_entity_scores": new_entity_scores, "isolation_features": isolation_features, "isolation_features_scaled": isolation_features_scaled, "isolation_outliers": isolation_outliers,
    "detector_results": detector_results, "top_entities_by_detector": top_entities_by_detector, "upsert_replace": upsert_replace_awards, "append_ignore": append_ignore_snapshots,
    "maintained_digit_counts": maintained_digit_counts,
    "entity_worklist": entity_worklist, "new_ueis": new_ueis, "snapshot_build": snapshot_build, "high_watermark_windows": high_watermark_windows, "seed_plan": seed_plan_of_years,
    "capped_date_chunks": capped_chunks, "policy_filter": policy_filter, "award_type_counts": award_type_counts, "joined_sample_count": joined_sample_count,
    **landing_queries.QUERIES,
    "json_award_mapping": json_award_mapping, "json_entity_mapping": json_entity_mapping, "csv_award_mapping": csv_award_mapping, "latest_snapshot": latest_snapshot_by_agency, "prime_file_selection": prime_file_selection,
}

_DIGIT = "substr(printf('%.9e', total_obligation), 1, 1)::INT"
_DIGITS_SQL = f"digits AS (SELECT recipient_uei AS uei, {_DIGIT} AS d FROM positive), hist AS (SELECT uei, COUNT(*)::BIGINT AS n, {', '.join(f'COUNT(*) FILTER (d = {d})::BIGINT AS d{d}' for d in range(1, 10))} FROM digits WHERE d BETWEEN 1 AND 9 GROUP BY uei)"
_GAPS = ", ".join(f"ABS(({' + '.join(f'd{i}' for i in range(1, d + 1))}) / n::DOUBLE - {sum(EXPECTED_DIGITS[:d])!r})" for d in range(1, 10))
_X = "(ks * sqrt(n))"
_HIGH = f"2 * list_sum(list_transform(range(1, 21), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * exp(-2.0::DOUBLE * k * k * {_X} * {_X})))"
_LOW = f"1 - sqrt(2 * pi()) / {_X} * list_sum(list_transform(range(1, 21), lambda k: exp(-((2 * k - 1) * (2 * k - 1))::DOUBLE * pi() * pi() / 8 / ({_X} * {_X}))))"
_BENFORD_SQL = f"ksd AS (SELECT *, GREATEST({_GAPS}) AS ks FROM hist WHERE n >= 30), pv AS (SELECT *, CASE WHEN {_X} <= 0 THEN 1.0::DOUBLE WHEN {_X} < 0.5 THEN {_LOW} ELSE {_HIGH} END AS p FROM ksd), benford AS (SELECT uei, n, ROUND(ks, 6) AS ks_statistic, ROUND(p, 6) AS p_value, ROUND(GREATEST(0.0::DOUBLE, LEAST(1.0::DOUBLE, 1 - p)), 6) AS score FROM pv)"
_RATIOS_SQL = """contract AS (
  SELECT parent_award_id, SUM(total_obligation) AS value, arg_min({'w': recipient_uei, 'c': naics_code, 'v': total_obligation},
    (CASE WHEN modification_number = '0' THEN 'a' WHEN modification_number IS NULL THEN 'c' ELSE 'b' || modification_number END) || chr(1) || award_id) AS start
  FROM positive WHERE parent_award_id IS NOT NULL GROUP BY parent_award_id),
ratios AS (SELECT parent_award_id, start.w AS uei, start.c AS naics_code, start.v AS initial_value, value AS final_value, value / start.v AS growth_ratio FROM contract)"""
_GROWTH_SQL = """peers AS (SELECT *, AVG(growth_ratio) OVER w AS m, STDDEV_SAMP(growth_ratio) OVER w AS s FROM ratios WINDOW w AS (PARTITION BY naics_code)),
zs AS (SELECT *, CASE WHEN s > 0 THEN (growth_ratio - m) / s ELSE 0 END AS z FROM peers),
worst AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY uei ORDER BY z DESC, parent_award_id) AS rn FROM zs WHERE z > 2),
growth AS (SELECT uei, parent_award_id AS worst_award_id, ROUND(growth_ratio, 6) AS growth_ratio, naics_code, ROUND(m, 6) AS naics_avg_ratio, ROUND(z, 6) AS z_score, ROUND(1 / (1 + exp(2 - z)), 6) AS score FROM worst WHERE rn = 1)"""
_FRESH_SQL = """near AS (SELECT registration_date AS since, p.*, award_date - registration_date AS gap FROM entities, positive p WHERE recipient_uei = uei
    AND award_date BETWEEN registration_date AND registration_date + 180 AND regexp_matches(competition_type, 'not competed|not available|sole source', 'i')),
rated AS (SELECT *, LEAST(1.0::DOUBLE, GREATEST(0.0::DOUBLE, log10(total_obligation) * (180 - gap) / 1260.0::DOUBLE)) AS rate FROM near),
chosen AS (SELECT recipient_uei, arg_min(rated, {'a': -rate, 'b': award_id}) AS x FROM rated GROUP BY recipient_uei),
fresh AS (SELECT recipient_uei AS uei, ROUND(x.rate, 6) AS score, x.gap::INT AS days_gap, x.since AS registration_date, x.award_date AS award_date,
  ROUND(x.total_obligation, 6) AS total_obligation, x.competition_type AS competition_type FROM chosen)"""
_FEATURES_SQL = f"""feats AS (SELECT recipient_uei AS uei, log10(GREATEST(SUM(total_obligation), 1.0)) AS log_total_dollars, COUNT(*)::DOUBLE AS award_count, COUNT(DISTINCT awarding_agency)::DOUBLE AS unique_agencies_count, COUNT(DISTINCT naics_code)::DOUBLE AS naics_diversity,
  AVG(CASE WHEN upper(competition_type) LIKE '%FULL AND OPEN%' THEN 1.0::DOUBLE ELSE 0 END) AS competition_ratio, AVG(CASE WHEN modification_number IS NOT NULL AND modification_number <> '0' THEN 1.0::DOUBLE ELSE 0 END) AS modification_frequency FROM positive GROUP BY 1),
features AS (SELECT f.*, date_diff('day', registration_date, DATE '{AS_OF}')::DOUBLE AS entity_age_days FROM feats f LEFT JOIN entities e USING (uei)),
full_features AS (SELECT * REPLACE (COALESCE(entity_age_days, (SELECT COALESCE(MEDIAN(entity_age_days), 0) FROM features)) AS entity_age_days) FROM features)"""


def _oracle(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " " + select


_CHUNKS_SQL = """daily AS (SELECT upper(award_type) AS g, award_date AS day, COUNT(*) AS n FROM awards GROUP BY 1, 2),
ends AS (SELECT MIN(day) AS a, MAX(day) AS b FROM daily),
chunks(g, label, s, e, depth) AS (SELECT DISTINCT g, 'x', a, b, 0 FROM daily, ends
  UNION ALL SELECT c.g, c.label || h.h, CASE WHEN h.h = 'a' THEN c.s ELSE c.s + ((c.e - c.s) // 2)::INT + 1 END, CASE WHEN h.h = 'a' THEN c.s + ((c.e - c.s) // 2)::INT ELSE c.e END, c.depth + 1
  FROM chunks c, (VALUES ('a'), ('b')) h(h) WHERE c.depth < 12 AND c.e > c.s AND (SELECT COALESCE(SUM(n), 0) FROM daily d WHERE d.g = c.g AND d.day BETWEEN c.s AND c.e) >= 10000),
counted AS (SELECT c.*, (SELECT COALESCE(SUM(n), 0) FROM daily d WHERE d.g = c.g AND d.day BETWEEN c.s AND c.e) AS r FROM chunks c)"""

ORACLES = {
    "leading_digit_histogram": _oracle(AWARDS_SQL, _DIGITS_SQL, select="SELECT * FROM hist"),
    "benford_scores": _oracle(AWARDS_SQL, _DIGITS_SQL, _BENFORD_SQL, select="SELECT * FROM benford"),
    "mod_growth_ratios": _oracle(AWARDS_SQL, _RATIOS_SQL, select="SELECT parent_award_id, uei, naics_code, ROUND(initial_value, 6) "
        "AS initial_value, ROUND(final_value, 6) AS final_value, ROUND(growth_ratio, 6) AS growth_ratio FROM ratios"),
    "mod_growth_scores": _oracle(AWARDS_SQL, _RATIOS_SQL, _GROWTH_SQL, select="SELECT * FROM growth"),
    "new_entity_scores": _oracle(AWARDS_SQL, ENTITIES_SQL, _FRESH_SQL, select="SELECT * FROM fresh"),
    "isolation_features": _oracle(AWARDS_SQL, ENTITIES_SQL, _FEATURES_SQL, select="SELECT uei, " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in FEATURES) + " FROM features"),
    "isolation_features_scaled": _oracle(AWARDS_SQL, ENTITIES_SQL, _FEATURES_SQL, select="SELECT uei, " + ", ".join(f"ROUND(CASE WHEN MAX({c}) OVER () > MIN({c}) OVER () THEN "
        f"({c} - MIN({c}) OVER ()) / (MAX({c}) OVER () - MIN({c}) OVER ()) ELSE 0 END, 6) AS {c}" for c in FEATURES) + " FROM full_features"),
    "isolation_outliers": _oracle(AWARDS_SQL, ENTITIES_SQL, _FEATURES_SQL, FOREST_SQL, select=f"SELECT uei, score, ROUND(raw, 6) AS raw_anomaly_score, {CONTAMINATION}::DOUBLE AS contamination_param, " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in FEATURES) + " FROM forest_rows"),
    "detector_results": _oracle(
        AWARDS_SQL, ENTITIES_SQL, _DIGITS_SQL, _BENFORD_SQL, _RATIOS_SQL, _GROWTH_SQL, _FRESH_SQL, _FEATURES_SQL, FOREST_SQL,
        select=" UNION ALL ".join(f"SELECT uei, '{d}' AS detector, score FROM {t}" for d, t in (("benford", "benford"), ("mod_growth", "growth"), ("new_entity", "fresh"), ("isolation", "forest_rows"))),
    ),
    "top_entities_by_detector": _oracle(
        AWARDS_SQL, ENTITIES_SQL, _DIGITS_SQL, _BENFORD_SQL, _RATIOS_SQL, _GROWTH_SQL, _FRESH_SQL,
        select=" UNION ALL ".join(f"SELECT * FROM (SELECT uei, '{d}' AS detector, score FROM {t} ORDER BY score DESC, uei LIMIT 10)" for d, t in (("benford", "benford"), ("mod_growth", "growth"), ("new_entity", "fresh"))),
    ),
    "upsert_replace": _oracle(AWARDS_SQL, f"batches AS (SELECT *, award_date >= DATE '{NEW_AWARDS_FROM}' AS late FROM pulls), "
        f"picked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pull_id ORDER BY late DESC, pulled_at DESC, l_partkey DESC, "
        f"l_suppkey DESC) AS rn FROM batches)", select="SELECT pull_id AS award_id, recipient_uei, total_obligation, award_date, "
            "pulled_at FROM picked WHERE rn = 1"),
    "maintained_digit_counts": _oracle(AWARDS_SQL, f"batches AS (SELECT *, award_date >= DATE '{NEW_AWARDS_FROM}' AS late FROM pulls), "
        f"picked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pull_id ORDER BY late DESC, pulled_at DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM batches), "
        f"held AS (SELECT recipient_uei AS uei, {_DIGIT} AS d FROM picked WHERE rn = 1 AND recipient_uei IS NOT NULL AND total_obligation > 0)",
        select=f"SELECT uei, COUNT(*)::BIGINT AS n, {', '.join(f'COUNT(*) FILTER (d = {d})::BIGINT AS d{d}' for d in range(1, 10))} FROM held WHERE d BETWEEN 1 AND 9 GROUP BY uei"),
    "append_ignore": _oracle(ENTITIES_SQL, select=f"SELECT uei, DATE '{AS_OF}' AS snapshot_date, CASE WHEN registration_date < "
        f"DATE '1998-01-01' THEN legal_business_name ELSE 'renamed' END AS legal_business_name FROM entities"),
    "entity_worklist": _oracle(AWARDS_SQL, ENTITIES_SQL, select="SELECT DISTINCT recipient_uei AS uei FROM awards WHERE "
        "recipient_uei NOT IN (SELECT uei FROM entities) UNION SELECT uei FROM entities JOIN (SELECT recipient_uei, "
        "MAX(period_of_performance_end) AS m FROM awards GROUP BY 1) ON recipient_uei = uei WHERE m > DATE '2000-06-01' AND "
        "registration_date::TIMESTAMP < TIMESTAMP '2000-06-01' - INTERVAL 30 DAY"),
    "new_ueis": _oracle(AWARDS_SQL, ENTITIES_SQL, select="SELECT DISTINCT recipient_uei AS uei FROM awards WHERE recipient_uei NOT "
        "IN (SELECT uei FROM entities)"),
    "snapshot_build": _oracle(ENTITIES_SQL, select=f"SELECT uei, DATE '{AS_OF}' AS snapshot_date, CASE WHEN registration_date >= "
        f"DATE '1998-01-01' THEN upper(legal_business_name) ELSE legal_business_name END AS legal_business_name FROM entities"),
    "high_watermark_windows": _oracle(AWARDS_SQL, POLICY_ROWS, "newest AS (SELECT awarding_agency AS name, MAX(award_date) AS m "
        "FROM awards GROUP BY 1)", select=f"SELECT short, 'incr_{AS_OF}' AS label, m - 7 AS start, DATE '{AS_OF}' AS \"end\", "
            f"'paginate' AS mode FROM policy JOIN newest USING (name) UNION ALL SELECT short, y::VARCHAR, make_date(y - 1, 10, 1), "
            f"make_date(y, 9, 30), mode FROM policy ANTI JOIN newest USING (name), (SELECT unnest({YEARS}) AS y)"),
    "seed_plan": _oracle(AWARDS_SQL, POLICY_ROWS, "years AS (SELECT DISTINCT year(award_date + INTERVAL 3 MONTH)::INT AS y FROM awards)", select="SELECT short, y::VARCHAR AS label, make_date(y - 1, 10, 1) "
        "AS start, make_date(y, 9, 30) AS \"end\", mode FROM policy, years"),
    "capped_date_chunks": _oracle(AWARDS_SQL, _CHUNKS_SQL, select="SELECT g AS \"group\", label, s AS start, e AS \"end\", "
        "depth::INT AS depth, r::BIGINT AS rows, r >= 10000 AS capped FROM counted WHERE NOT (r >= 10000 AND e > s AND depth < 12)"),
    "policy_filter": _oracle(AWARDS_SQL, POLICY_ROWS, select="SELECT award_id, awarding_agency, award_type, total_obligation FROM "
        "awards LEFT JOIN policy ON awarding_agency = name WHERE (types IS NULL OR list_contains(types, upper(award_type))) AND "
        "(COALESCE(least, 0) <= 0 OR COALESCE(total_obligation, 0) >= least)"),
    "award_type_counts": _oracle(AWARDS_SQL, select="SELECT award_type, COUNT(*)::BIGINT AS n FROM awards GROUP BY 1"),
    "joined_sample_count": _oracle(AWARDS_SQL, ENTITIES_SQL, select="SELECT awarding_agency, COUNT(*)::BIGINT AS n, COUNT(DISTINCT "
        "uei)::BIGINT AS n_entities FROM awards JOIN entities ON uei = recipient_uei GROUP BY 1"),
    "json_award_mapping": _oracle(AWARDS_SQL, select="SELECT award_id, parent_award_id, recipient_uei, CASE WHEN awarding_agency = "
        "'FRANCE' THEN 'FILLED' ELSE awarding_agency END AS awarding_agency, award_type, naics_code, lower(naics_code) AS "
        "naics_description, ROUND(CASE WHEN modification_number = '0' OR total_obligation IS NULL THEN total_obligation * 2 ELSE "
        "total_obligation END, 2) AS total_obligation, NULL::DATE AS period_of_performance_start, award_date, NULL::INT AS "
        "number_of_offers, modification_number FROM awards"),
    "json_entity_mapping": _oracle(ENTITIES_SQL, select="SELECT uei, legal_business_name, 'TX' AS physical_state, 'Small, ' || "
        "substr(uei, 2, 1) AS business_type, registration_date FROM entities"),
    "csv_award_mapping": _oracle(AWARDS_SQL, select=f"SELECT award_id, recipient_uei, awarding_agency, award_type, 'line one' || "
        f"chr(10) || 'says \"two\", of ' || award_id AS award_description, total_obligation, award_date, competition_type, "
        f"NULL::INT AS number_of_offers, modification_number, TIMESTAMP '{AS_OF}' AS pulled_at FROM awards"),
    "latest_snapshot": _oracle(AWARDS_SQL, select="SELECT awarding_agency, strftime(MAX(award_date) FILTER (award_type = 'DELIVERY "
        "ORDER'), '%Y%m%d') AS latest FROM awards GROUP BY 1"),
    "prime_file_selection": """WITH f AS (SELECT c_custkey % 50 AS snapshot, ['Contracts_PrimeAwardSummaries_', 'Contracts_Subawards_', 'Contracts_'][(CASE WHEN c_custkey % 50 < 25 THEN c_custkey % 3 ELSE 1 + c_custkey % 2 END + 1)::INT] || c_custkey || CASE WHEN c_custkey % 11 = 0 THEN '.txt' ELSE '.csv' END AS file_name FROM customer),
p AS (SELECT *, bool_or(file_name LIKE '%PrimeAward%') OVER (PARTITION BY snapshot) AS any_prime FROM f WHERE file_name LIKE '%.csv')
SELECT snapshot, file_name FROM p WHERE file_name LIKE '%PrimeAward%' OR (NOT any_prime AND file_name LIKE '%Contract%' AND file_name NOT LIKE '%Subaward%')""",
}

_BENFORD_FIELDS = {"n_transactions": "n", "ks_statistic": "ks", "p_value": "p"}
_DETAILS = [f"SELECT uei, 'benford', '{k}', ROUND({v}::DOUBLE, 5), NULL FROM pv" for k, v in _BENFORD_FIELDS.items()]
_DETAILS += [f"SELECT uei, 'benford', 'observed_distribution.{d}', ROUND(d{d} / n::DOUBLE, 5), NULL FROM pv" for d in range(1, 10)]
_DETAILS += [f"SELECT uei, 'benford', 'expected_distribution.{d}', ROUND(log10(1 + 1.0::DOUBLE / {d}), 5), NULL FROM pv" for d in range(1, 10)]
_DETAILS += [f"SELECT uei, 'mod_growth', '{k}', ROUND({v}, 5), NULL FROM steep" for k, v in (("growth_ratio", "growth_ratio"), ("naics_avg_ratio", "m"), ("z_score", "z"))]
_DETAILS += [f"SELECT uei, 'mod_growth', '{k}', NULL::DOUBLE, {v} FROM steep" for k, v in (("worst_award_id", "parent_award_id"), ("naics_code", "naics_code"))]
_DETAILS += [f"SELECT uei, 'new_entity', '{k}', ROUND({k}::DOUBLE, 5), NULL FROM fresh" for k in ("days_gap", "total_obligation")]
_DETAILS += [f"SELECT uei, 'new_entity', '{k}', NULL::DOUBLE, {k}::VARCHAR FROM fresh" for k in ("registration_date", "award_date", "competition_type")]
_DETECTORS = (AWARDS_SQL, ENTITIES_SQL, _DIGITS_SQL, _BENFORD_SQL, _RATIOS_SQL, _GROWTH_SQL, _FRESH_SQL, "steep AS (SELECT * FROM worst WHERE rn = 1)")
ORACLES |= landing_queries.ORACLES | {
    "detector_details": _oracle(*_DETECTORS, f"d(uei, detector, field, number, text) AS ({' UNION ALL '.join(_DETAILS)})", select="SELECT * FROM d"),
    "detector_contract": _oracle(*_DETECTORS, select=" UNION ALL ".join(f"SELECT '{d}' AS detector, COUNT(*)::BIGINT AS rows, "
        f"0::BIGINT AS violations FROM {t}" for d, t in (("benford", "benford"), ("mod_growth", "growth"), ("new_entity", "fresh")))),
}

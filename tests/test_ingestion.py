from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from awardlens.functions import expressions as X
from awardlens.functions.schemas import AWARDS, ENTITIES, KEYS, SNAPSHOTS
from awardlens.plans.incremental import agency_policy, build_snapshot, capped_date_chunks, fiscal_windows, load_windows, recipient_sample, refresh_list, rows_in_windows, seed_plan, write_worklist
from awardlens.plans.store import Store, append_ignore, upsert_replace
from awardlens.sources.csv_awards import apply_policy, archive_awards, archive_job, map_awards, policy_keeps, scan_csv
from awardlens.sources.json_records import award_records, entity_records
from awardlens.sources.landing import award_recipients, awards_name, land, land_labelled, read_awards, row_count, snapshots_name, write_typed
from awardlens.sources.listing import latest_snapshot, prime_files
from awardlens.streaming.ingest import ingest

NOW = dt.datetime(2026, 5, 1, 12)


def stamp():
    return F.lit("2026-05-01 12:00:00").cast("timestamp_ntz")


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'date' if isinstance(v, dt.date) else 'string'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first()["x"]


def row(schema, **values):
    return tuple((dict.fromkeys(schema.names) | values)[c] for c in schema.names)


@pytest.mark.parametrize(("text", "want"), [("2024-01-05T10:00:00", dt.date(2024, 1, 5)), ("2024-1-5", None), ("", None), ("null", None), (None, None), ("20240105", dt.date(2024, 1, 5)), ("2024-01-05 10:00", dt.date(2024, 1, 5)), ("soon", None)])
def test_award_date(spark, text, want):
    assert one(spark, X.award_date("t"), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("2024-03-15", dt.date(2024, 3, 15)), ("03/15/2024", dt.date(2024, 3, 15)), ("15.03.2024", None), ("", None)])
def test_entity_date(spark, text, want):
    assert one(spark, X.entity_date("t"), t=text) == want


@pytest.mark.parametrize(("x", "want"), [(9.99999999999, 1), (0.05, 5), (0.0, None), (-3.0, None), (float("nan"), None), (float("inf"), None), (123.0, 1), (9000.0, 9)])
def test_leading_digit(spark, x, want):
    assert one(spark, X.leading_digit("x"), x=x) == want


def test_dates_and_keys(spark):
    assert one(spark, X.fiscal_year_start("y"), y=2024) == dt.date(2023, 10, 1)
    assert one(spark, X.fiscal_year_end("y"), y=2024) == dt.date(2024, 9, 30)
    assert one(spark, X.fiscal_year_of("d"), d=dt.date(2023, 10, 1)) == 2024
    assert one(spark, X.midpoint("a", "b"), a=dt.date(2024, 1, 1), b=dt.date(2024, 1, 4)) == dt.date(2024, 1, 2)
    assert one(spark, X.midpoint("a", "b"), a=dt.date(2024, 1, 1), b=dt.date(2024, 1, 1)) is None
    assert one(spark, X.snapshot_key("c", F.lit(2024), F.lit("20260406")), c="75") == "FY2024_075_Contracts_Full_20260406.zip"
    assert one(spark, X.snapshot_key("c", F.lit(2024), F.lit("20260406")), c="9700") == "FY2024_9700_Contracts_Full_20260406.zip"


def test_kolmogorov_survival_at_known_points(spark):
    for x, want in ((0.3, 0.99999069), (0.5, 0.96394524), (1.0, 0.26999967), (1.36, 0.04948), (3.0, 3.0459959e-08)):
        assert one(spark, X.kolmogorov_survival(F.col("x")), x=x) == pytest.approx(want, rel=1e-3)
    assert one(spark, X.sigmoid("x", 2.0), x=-1000.0) == 0.0


def award_json(spark, **record):
    return award_records(spark.createDataFrame([(json.dumps(record),)], "value string"), "Agency", stamp()).first()


def test_award_record_in_full(spark):
    r = award_json(spark, **{"generated_internal_id": "G1", "Award ID": "A1", "Recipient UEI": "U", "Awarding Agency": "D", "Contract Award Type": "DO", "Award Type": "x", "NAICS": "541330", "naics_description": "Eng", "Total Obligations": "12.5", "End Date": "2025-01-01T00:00:00", "Number of Offers Received": 3.7, "Mod Number": "0"})
    assert (r["award_id"], r["award_type"], r["naics_code"], r["total_obligation"], r["number_of_offers"], r["modification_number"]) == ("G1", "DO", "541330", 12.5, 3, "0")
    assert r["period_of_performance_end"] == dt.date(2025, 1, 1) and r["pulled_at"] == NOW


def test_award_record_alternatives(spark):
    r = award_json(spark, **{"Award ID": "A1", "NAICS": {"code": "1", "description": "One"}, "Total Obligations": 0, "Award Amount": 7, "Number of Offers Received": "3.0", "Start Date": "null"})
    assert (r["award_id"], r["naics_code"], r["naics_description"], r["total_obligation"], r["number_of_offers"], r["awarding_agency"]) == ("A1", "1", "One", 7.0, None, "Agency")
    assert award_json(spark, **{"Award ID": "A", "Total Obligations": "0", "Award Amount": 7})["total_obligation"] == 0.0
    bad = spark.createDataFrame([("no json",), (json.dumps({"Award Amount": 1}),), (None,)], "value string")
    assert award_records(bad, "Agency", stamp()).count() == 0


def test_entity_record(spark):
    full = {"entityRegistration": {"ueiSAM": "U1", "legalBusinessName": "L", "registrationDate": "", "activationDate": "03/15/2024"}, "coreData": {"physicalAddress": {"state": "TX", "zip": "7"}, "generalInformation": {"entityStructureCode": "2L"}, "businessTypes": {"businessTypeList": [{"businessTypeDesc": "Small"}, {"businessTypeCode": "2X"}, {}]}}}
    rows = spark.createDataFrame([(json.dumps(full),), (json.dumps({"coreData": {}}),), (json.dumps({"ueiSAM": "U2"}),)], "value string")
    out = {r["uei"]: r for r in entity_records(rows, stamp()).collect()}
    assert set(out) == {"U1", "U2"}
    r = out["U1"]
    assert (r["physical_state"], r["physical_zip"], r["entity_structure"], r["business_type"], r["registration_date"]) == ("TX", "7", "2L", "Small, 2X", dt.date(2024, 3, 15))
    assert out["U2"]["business_type"] is None


def test_csv_mapping_takes_the_first_present_column_and_drops_rows_without_id(spark):
    raw = spark.createDataFrame([("P1", "1e3", "x"), (None, "5", "3")], "award_id_piid string, current_total_value_of_award string, number_of_offers_received string")
    out = map_awards(raw, "Agency", stamp())
    assert out.columns == AWARDS.names
    r = out.collect()
    assert len(r) == 1 and (r[0]["award_id"], r[0]["total_obligation"], r[0]["number_of_offers"], r[0]["awarding_agency"]) == ("P1", 1000.0, None, "Agency")


@pytest.mark.parametrize(("codes", "least", "kept"), [(["C", "D"], 0.0, {"c", "d"}), (["A", "B", "C", "D"], 0.0, {"a", "c", "d", "n"}), (["Z"], 0.0, {"a", "c", "d", "n"}), ([], 100.0, {"a", "c"}), (None, None, {"a", "c", "d", "n"})])
def test_policy(spark, codes, least, kept):
    rows = spark.createDataFrame([("a", "BPA Call", 200.0), ("c", "delivery order", 100.0), ("d", "DEFINITIVE CONTRACT", 5.0), ("n", None, None)], "award_id string, award_type string, total_obligation double")
    rows = rows.withColumns({"types": F.lit(codes).cast("array<string>") if codes is None else F.array(*[F.lit(c) for c in codes]).cast("array<string>"), "least": F.lit(least).cast("double")})
    assert {r["award_id"] for r in rows.filter(policy_keeps("types", "least")).collect()} == kept


def test_agency_policy_falls_back(spark):
    rows = {r["short"]: r for r in agency_policy(spark, [{"code": "1", "name": "A", "short": "A"}, {"code": "2", "name": "B", "short": "B", "award_types": [], "award_amount_min": 0, "seed_strategy": "archive"}], {"award_types": ["C"], "award_amount_min": 9}).collect()}
    assert (rows["A"]["award_types"], rows["A"]["award_amount_min"], rows["A"]["seed_strategy"]) == (["C"], 9.0, "paginate")
    assert (rows["B"]["award_types"], rows["B"]["award_amount_min"], rows["B"]["seed_strategy"]) == (["C"], 0.0, "archive")


def test_archive_job(spark, tmp_path):
    for name, text in (("one", "contract_award_unique_key,award_type,total_dollars_obligated\nA,DELIVERY ORDER,30000\nB,PURCHASE ORDER,30000\nC,DELIVERY ORDER,1\n"), ("two", "award_id_piid,recipient_uei\nD,U\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    policy = agency_policy(spark, [{"code": "097", "name": "DoD", "short": "DoD", "award_types": ["C", "D"], "award_amount_min": 25000}, {"code": "075", "name": "HHS", "short": "HHS"}], {})
    out = archive_awards(spark, [(str(tmp_path / "one.csv"), "DoD"), (str(tmp_path / "two.csv"), "HHS")], policy, stamp())
    assert {r["award_id"] for r in out.collect()} == {"A", "D"}
    assert archive_awards(spark, [], policy, stamp()).count() == 0
    assert apply_policy(spark.createDataFrame([], AWARDS), policy).count() == 0


def test_quoted_line_breaks_stay_in_one_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text('award_id_piid,award_description,total_dollars_obligated\nA,"one\ntwo, ""three""",5\n,"lost",1\nB,,7\nC\n', encoding="utf-8")
    r = {x["award_id"]: x for x in map_awards(scan_csv(spark, str(tmp_path / "a.csv")), "Agency", stamp()).collect()}
    assert set(r) == {"A", "B", "C"} and r["A"]["award_description"] == 'one\ntwo, "three"'
    assert (r["A"]["total_obligation"], r["B"]["total_obligation"], r["C"]["total_obligation"]) == (5.0, 7.0, None)


def test_archive_job_chooses_members_and_lands_by_label(spark, tmp_path):
    text = {"P_PrimeAwardSummaries_1.csv": "award_id_piid,award_type\nA,DELIVERY ORDER\nB,PURCHASE ORDER\n", "P_PrimeAwardSummaries_2.csv": "award_id_piid,award_type\nC,DELIVERY ORDER\n", "Contracts_Subawards_1.csv": "award_id_piid\nS\n", "P_PrimeAwardSummaries_3.csv": ""}
    for name, t in text.items():
        (tmp_path / name).write_text(t)
    rows = [("z", name, str(tmp_path / name), "DoD", len(t)) for name, t in text.items()]
    members = spark.createDataFrame([*rows, rows[0]], "snapshot string, file_name string, path string, agency string, length long")
    policy = agency_policy(spark, [{"code": "097", "name": "DoD", "short": "DOD", "award_types": ["C"]}], {})
    landing = str(tmp_path / "landing")
    assert archive_job(spark, members, policy, stamp(), landing, "FY2024") == {"DOD": 2}
    assert archive_job(spark, members, policy, stamp(), landing, "FY2024") == {"DOD": 2}  # again, replaced
    landed = spark.read.parquet(f"{landing}/awards_labelled.parquet")
    assert {(r["award_id"], r["agency_short"], r["load_label"]) for r in landed.collect()} == {("A", "DOD", "FY2024"), ("C", "DOD", "FY2024")} and landed.count() == 2
    store = Store(spark, f"file://{tmp_path}/db")
    assert store.load_all(landing)["awards"] == 2
    empty = str(tmp_path / "none")
    assert archive_job(spark, members.filter("file_name like '%Sub%'").withColumn("length", F.lit(0)), policy, stamp(), empty, "x") == {}
    assert read_awards(spark, f"{empty}/awards_*.parquet").columns == AWARDS.names and row_count(spark, f"{empty}/{awards_name('none', 'empty')}") == 0


def test_labelled_windows_replace_only_themselves(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([row(AWARDS, award_id=i) for i in ids], AWARDS)
    base = str(tmp_path)
    labelled = lambda df, short, label: df.withColumns({"agency_short": F.lit(short), "load_label": F.lit(label), "other": F.lit(1)})
    assert land_labelled(labelled(rows("A", "B"), "X", "1").union(labelled(rows("C", None), "Y", "1")), base) == {"X": 2, "Y": 2}
    assert land_labelled(labelled(rows("D"), "X", "1"), base) == {"X": 1}
    assert {(r["award_id"], r["agency_short"]) for r in spark.read.parquet(f"{base}/awards_labelled.parquet").collect()} == {("D", "X"), ("C", "Y"), (None, "Y")}
    assert land(rows("Z"), base, awards_name("HHS", "2024", "archive"), AWARDS) == 1 and (tmp_path / "awards_HHS_2024_archive.parquet").exists()
    assert snapshots_name("2026-05-01") == "entity_snapshots_2026-05-01.parquet"


def test_worklist_and_sample(spark, tmp_path):
    awards = spark.createDataFrame([row(AWARDS, recipient_uei=u) for u in ["B", "A", "B", "", None, "C"]], AWARDS)
    out = write_worklist(awards.select(F.col("recipient_uei").alias("uei")), str(tmp_path / "list"))
    assert [r["uei"] for r in out.collect()] == ["A", "B", "C"]
    assert recipient_sample(awards, 2).count() == 2 and recipient_sample(awards, 9).count() == 3
    assert recipient_sample(awards, 2).collect() == recipient_sample(awards.repartition(3), 2).collect()
    assert write_worklist(out.limit(0), str(tmp_path / "empty")).count() == 0


def test_json_records_without_id_are_counted(spark):
    lines = spark.createDataFrame([(json.dumps({"Award ID": "A", "other": 1}),), (json.dumps({"Award Amount": 1}),), ("no json",), (None,)], "value string")
    seen = Observation("json")
    out = award_records(lines, "Agency", stamp(), metric=seen)
    assert out.count() == 1 and seen.get == {"dropped": 1}


def test_listing(spark):
    rows = spark.createDataFrame([("<Key>FY2024_075_Contracts_Full_20260406.zip<Key>FY2024_075_Contracts_Full_20260506.zip",), ("FY2024_075_Contracts_Delta_20270101.zip",)], "text string")
    assert latest_snapshot(rows).first()["latest"] == "20260506"
    assert latest_snapshot(rows.filter("text like '%Delta%'")).first()["latest"] is None
    members = spark.createDataFrame([("a", "X_PrimeAwardSummaries_1.csv"), ("a", "Contracts_Subawards.csv"), ("a", "readme.txt"), ("b", "Contracts_1.csv"), ("b", "Contracts_Subawards_1.csv")], "snapshot string, file_name string")
    assert {r["file_name"] for r in prime_files(members).collect()} == {"X_PrimeAwardSummaries_1.csv", "Contracts_1.csv"}


def test_landing(spark, tmp_path):
    path = str(tmp_path / "awards_x.parquet")
    write_typed(spark.createDataFrame([("A", "U", 1.0), ("B", "", 2.0)], "award_id string, recipient_uei string, total_obligation double"), path, AWARDS)
    assert row_count(spark, path) == 2 and read_awards(spark, path).columns == AWARDS.names
    assert [r["uei"] for r in award_recipients(spark, path).collect()] == ["U"]
    assert award_recipients(spark, str(tmp_path / "none.parquet")).count() == 0
    write_typed(spark.createDataFrame([], AWARDS), str(tmp_path / "empty.parquet"), AWARDS)
    assert spark.read.parquet(str(tmp_path / "empty.parquet")).columns == AWARDS.names


def test_upserts(spark):
    old = spark.createDataFrame([row(ENTITIES, uei="A", cage_code="1"), row(ENTITIES, uei="B", cage_code="1")], ENTITIES)
    new = spark.createDataFrame([row(ENTITIES, uei="B", dba_name="x", last_pulled_at=NOW), row(ENTITIES, uei="B", dba_name="old"), row(ENTITIES, uei="C"), row(ENTITIES)], ENTITIES)
    once = upsert_replace(old, new, KEYS["entities"], "last_pulled_at")
    got = {r["uei"]: (r["dba_name"], r["cage_code"]) for r in once.collect()}
    assert got == {"A": (None, "1"), "B": ("x", None), "C": (None, None)}
    assert upsert_replace(once, new, KEYS["entities"], "last_pulled_at").exceptAll(once).count() == 0
    s = lambda day, name: row(SNAPSHOTS, uei="A", snapshot_date=dt.date(2024, 1, day), legal_business_name=name)
    first, second = spark.createDataFrame([s(1, "old")], SNAPSHOTS), spark.createDataFrame([s(1, "new"), s(2, "new")], SNAPSHOTS)
    assert {(r["snapshot_date"].day, r["legal_business_name"]) for r in append_ignore(first, second, KEYS["entity_snapshots"]).collect()} == {(1, "old"), (2, "new")}


def test_store_and_stream(spark, tmp_path):
    store, landing = Store(spark, f"file://{tmp_path}/db"), str(tmp_path / "landing")
    assert store.load_all(f"file://{landing}") == {"awards": 0, "entities": 0, "entity_snapshots": 0}
    rows = [row(AWARDS, award_id=i, total_obligation=1.0, pulled_at=NOW) for i in "AB"]
    write_typed(spark.createDataFrame(rows, AWARDS), f"{landing}/awards_a.parquet", AWARDS)
    write_typed(spark.createDataFrame([row(ENTITIES, uei="U")], ENTITIES), f"{landing}/entities.parquet", ENTITIES)
    assert store.load_all(landing) == {"awards": 2, "entities": 1, "entity_snapshots": 0}
    assert store.load_all(landing) == {"awards": 0, "entities": 0, "entity_snapshots": 0}
    other = Store(spark, f"{tmp_path}/db2")
    other.init()
    query = ingest(spark, "awards", f"{landing}/awards_a.parquet", other, f"{tmp_path}/ck")
    query.awaitTermination(60)
    assert other.read("awards").count() == 2


def test_incremental(spark):
    policy = agency_policy(spark, [{"code": "1", "name": "A", "short": "a"}, {"code": "2", "name": "B", "short": "b", "seed_strategy": "archive"}], {})
    awards = spark.createDataFrame([row(AWARDS, award_id="1", awarding_agency="A", award_date=dt.date(2024, 5, 10), recipient_uei="U1", period_of_performance_end=dt.date(2030, 1, 1)), row(AWARDS, award_id="2", awarding_agency="A", award_date=dt.date(2020, 1, 1), recipient_uei="U2", period_of_performance_end=dt.date(2020, 1, 1))], AWARDS)
    windows = load_windows(policy, awards, fiscal_windows(spark, [2024, 2025]), F.lit("2024-06-01"))
    got = {(r["short"], r["label"], r["start"], r["mode"]) for r in windows.collect()}
    assert got == {("a", "incr_2024-06-01", dt.date(2024, 5, 3), "paginate"), ("b", "2024", dt.date(2023, 10, 1), "archive"), ("b", "2025", dt.date(2024, 10, 1), "archive")}
    assert seed_plan(policy, fiscal_windows(spark, [2024])).count() == 2
    assert [r["award_id"] for r in rows_in_windows(awards, windows, policy).collect()] == ["1"]
    assert [r["award_id"] for r in rows_in_windows(awards.union(awards), seed_plan(policy, fiscal_windows(spark, [2020])), policy).collect()] == ["2", "2"]
    assert rows_in_windows(awards.limit(0), windows, policy).count() == 0
    entities = spark.createDataFrame([row(ENTITIES, uei="U1", last_pulled_at=dt.datetime(2024, 1, 1)), row(ENTITIES, uei="U2", last_pulled_at=dt.datetime(2024, 1, 1)), row(ENTITIES, uei="U3")], ENTITIES)
    recipients = spark.createDataFrame([("U1",), ("U9",), ("",)], "uei string")
    assert {r["uei"] for r in refresh_list(recipients, entities, awards, F.lit("2024-06-01")).collect()} == {"U1", "U9"}
    snap = build_snapshot(entities.filter("uei = 'U1'").withColumn("cage_code", F.lit("new")), entities, F.lit("2024-06-01"))
    assert snap.columns == SNAPSHOTS.names and {(r["uei"], r["cage_code"]) for r in snap.collect()} == {("U1", "new"), ("U2", None), ("U3", None)}


def test_date_chunks(spark):
    rows = spark.createDataFrame([("g", dt.date(2024, 1, 1 + i % 4)) for i in range(40)] + [("g", dt.date(2024, 1, 1))] * 30 + [("h", None)], "g string, d date")
    out = capped_date_chunks(rows, "d", "g", "2024-01-01", "2024-01-04", "w", cap=25, most_splits=5).orderBy("group", "label").collect()
    got = [(r["group"], r["label"], r["start"].day, r["end"].day, r["rows"], r["capped"]) for r in out]
    assert got == [("g", "waa", 1, 1, 40, True), ("g", "wab", 2, 2, 10, False), ("g", "wb", 3, 4, 20, False), ("h", "w", 1, 4, 0, False)]
    deep = capped_date_chunks(rows.filter("d is not null").union(rows.filter("g = 'g'").withColumn("g", F.lit(None).cast("string"))), "d", "g", "2023-12-01", "2024-03-01", "w", cap=25, most_splits=2).collect()
    assert {(r["group"], r["label"], r["depth"], r["rows"], r["capped"]) for r in deep} == {(g, *x) for g in ("g", None) for x in (("waa", 2, 0, False), ("wab", 2, 70, True), ("wb", 1, 0, False))}
    assert capped_date_chunks(rows.limit(0), "d", "g", "2024-01-01", "2024-01-04", "w").count() == 0


def test_labelled_rows_are_written_once(spark, tmp_path):
    """Only the labelled table is written (a copy beside it doubled the bytes), and earlier windows of an agency aren't counted."""
    from unittest import mock

    labels = lambda ids, label: rows_of(spark, ids).withColumns({"agency_short": F.lit("X"), "load_label": F.lit(label)})
    base = str(tmp_path / "landing")
    with mock.patch("awardlens.sources.scratch.scratch_path", side_effect=AssertionError("a scratch table")):
        assert land_labelled(labels(["A", "B"], "2024-01-01"), base) == {"X": 2}
        assert land_labelled(labels(["C"], "2024-02-01"), base) == {"X": 1}
        assert land_labelled(labels([], "2024-03-01"), base) == {}
    assert spark.read.parquet(f"{base}/awards_labelled.parquet").count() == 3
    assert land_labelled(labels([], "2024-03-01"), str(tmp_path / "none")) == {} and not (tmp_path / "none" / "awards_labelled.parquet").exists()


def rows_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "award_id string").select(*[(F.col("award_id") if f.name == "award_id" else F.lit(None).cast(f.dataType)).alias(f.name) for f in AWARDS])


def test_whole_numbers_are_not_tried_on_other_texts(spark, tmp_path):
    """A failed cast costs an error within Spark; results stay."""
    texts = [" 12 ", "+3", "-4", "\t5\n", "3.0", "x", "1e3", "2147483648", "--1", "1 2", "", "null", None, "٣", "\x7f6"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = [(r["a"], r["b"]) for r in df.select(X.whole_number("t").alias("a"), F.expr("try_cast(nullif(nullif(t, ''), 'null') AS int)").alias("b")).collect()]
    assert [a for a, _ in rows] == [b for _, b in rows] == [12, 3, -4, 5, *[None] * 10, 6]
    raw = spark.createDataFrame([("A1", "x"), ("A2", "7")], "award_id_piid string, number_of_offers_received string")
    mapped = map_awards(raw, "FILLED", stamp())
    assert [r["number_of_offers"] for r in mapped.orderBy("award_id").collect()] == [None, 7]
    assert "RLIKE" in mapped.select("number_of_offers")._jdf.queryExecution().optimizedPlan().toString()


def test_json_keys_are_taken_in_one_pass(spark):
    records = [
        {"generated_internal_id": v, "Award ID": "next", "Total Obligations": v, "Award Amount": 7, "NAICS": n, "naics_description": v, "NAICS Description": "d", "Number of Offers Received": v}
        for v, n in [(0, "5"), ("0", {}), (-0.0, {"code": 1}), (0.00, None), (False, ["x"]), ("false", 3), ({}, "{a}"), ("{}", ""), (None, {"code": {"a": 1}}), ("", "null"), (1.5, True), ([], 0)]
    ]
    lines = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
    out = award_records(lines, "FILLED", stamp())
    assert [r["award_id"] for r in out.collect()] == ["next", "0", "next", "next", "next", "false", "next", "next", "next", "next", "1.5", "next"]
    assert [r["total_obligation"] for r in out.collect()] == [7, 0, 7, 7, 7, None, 7, 7, 7, 7, 1.5, 7]
    assert [r["naics_code"] for r in out.collect()] == ["5", None, "1", None, '["x"]', "3", "{a}", None, '{"a":1}', None, "true", "0"]
    assert [r["number_of_offers"] for r in out.collect()] == [0, 0, 0, 0, *[None] * 6, 1, None]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert '$["Description"]' not in plan  # no path is looked up only for its text


def test_leading_digits_by_product_are_those_of_ten_digits(spark):
    values = [float(f"{m}e{e}") for e in (-320, -291, -8, -1, 0, 1, 5, 22, 290, 307) for m in ("1", "9.9999999995", "9.99999999949", "1.9999999996", "1.99999999", "2", "2.00000001", "4.2", "8.99999999951")] + [5e-324, 1.7e308, 0.1 + 0.2, 999999.99, 20_000.01]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", X.leading_digit("x").alias("d"), F.format_string("%.9e", "x").alias("text"))
    assert [(r["x"], r["d"]) for r in rows.collect()] == [(r["x"], int(r["text"][0])) for r in rows.collect()]
    assert "FLOOR" in rows._jdf.queryExecution().optimizedPlan().toString()  # formatting is the exception

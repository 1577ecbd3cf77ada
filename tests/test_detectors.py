from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest

from awardlens.functions.schemas import AWARDS, ENTITIES, RESULT
from awardlens.operators.benford import detect_benford
from awardlens.operators.fresh_vendor import detect_new_entity_sole_source
from awardlens.operators.growth import detect_mod_growth
from awardlens.operators.isolation import detect_isolation_outlier
from awardlens.operators.results import all_detectors, contract_violations, top

AS_OF = "2026-05-01"


def award(award_id, uei, amount, **changes):
    row = dict.fromkeys(AWARDS.names) | {"award_id": award_id, "recipient_uei": uei, "total_obligation": amount, "awarding_agency": "Department of Defense", "award_type": "DEFINITIVE CONTRACT", "naics_code": "541330", "award_date": dt.date(2024, 6, 1), "competition_type": "FULL AND OPEN COMPETITION", "modification_number": "0"}
    return tuple((row | changes)[c] for c in AWARDS.names)


def entity(uei, registered=dt.date(2015, 1, 1)):
    row = dict.fromkeys(ENTITIES.names) | {"uei": uei, "registration_date": registered}
    return tuple(row[c] for c in ENTITIES.names)


def tables(spark, awards, entities=()):
    return spark.createDataFrame(list(awards), AWARDS), spark.createDataFrame(list(entities), ENTITIES)


def test_benford_flags_all_nines_and_gates_small_groups(spark):
    a, _ = tables(spark, [award(f"n{i}", "NINES", 9000.0 + i) for i in range(30)] + [award(f"f{i}", "FEW", 9000.0 + i) for i in range(29)])
    rows = detect_benford(a).collect()
    assert [r["uei"] for r in rows] == ["NINES"]
    assert rows[0]["score"] > 0.9
    details = json.loads(rows[0]["details"])
    assert details["observed_distribution"]["9"] == 1.0 and details["n_transactions"] == 30


def test_benford_accepts_natural_digits(spark):
    counts = (30, 18, 12, 10, 8, 7, 6, 5, 4)
    a, _ = tables(spark, [award(f"{d}-{i}", "NAT", d * 1000.0 + i) for d, n in enumerate(counts, 1) for i in range(n)])
    assert detect_benford(a).first()["score"] < 0.5


def test_growth_flags_the_outlier_only(spark):
    rows = [award("x0", "BIG", 100.0, parent_award_id="PX"), award("x1", "BIG", 4900.0, parent_award_id="PX", modification_number="P00001")]
    for i in range(20):
        rows += [award(f"{i}a", f"U{i}", 100.0, parent_award_id=f"P{i}"), award(f"{i}b", f"U{i}", 20.0, parent_award_id=f"P{i}", modification_number="P00001")]
    a, _ = tables(spark, rows)
    out = detect_mod_growth(a).collect()
    assert [r["uei"] for r in out] == ["BIG"] and out[0]["score"] > 0.9
    assert json.loads(out[0]["details"])["growth_ratio"] == pytest.approx(50, rel=0.01)
    uniform, _ = tables(spark, rows[2:])
    assert detect_mod_growth(uniform).count() == 0


def test_growth_takes_modification_zero_first_and_nulls_last(spark):
    rows = [award("a", "U", 50.0, parent_award_id="P", modification_number=None), award("b", "U", 10.0, parent_award_id="P", modification_number="0"), award("c", "U", -5.0, parent_award_id="P", modification_number="P1")]
    from awardlens.operators.growth import growth_ratios

    r = growth_ratios(tables(spark, rows)[0]).first()
    assert (r["initial_value"], r["final_value"], r["growth_ratio"]) == (10.0, 60.0, 6.0)


@pytest.mark.parametrize(("competition", "registered", "found"), [("NOT COMPETED", dt.date(2024, 5, 2), True), ("FULL AND OPEN COMPETITION", dt.date(2024, 5, 2), False), ("NOT COMPETED", dt.date(2020, 1, 1), False), ("NOT COMPETED", dt.date(2024, 7, 1), False)])
def test_new_entity(spark, competition, registered, found):
    a, e = tables(spark, [award("a", "NEW", 1_000_000.0, competition_type=competition)], [entity("NEW", registered)])
    rows = detect_new_entity_sole_source(a, e).collect()
    assert bool(rows) == found
    if found:
        assert rows[0]["score"] > 0.5 and json.loads(rows[0]["details"])["days_gap"] == 30


def test_new_entity_edge_of_window_scores_zero(spark):
    a, e = tables(spark, [award("a", "NEW", 1e6, competition_type="Sole Source")], [entity("NEW", dt.date(2024, 6, 1) - dt.timedelta(days=180))])
    assert detect_new_entity_sole_source(a, e).first()["score"] == 0.0


def isolation_tables(spark):
    rows = [award(f"{i}-{k}", f"U{i}", 10_000.0 + 10 * i + k) for i in range(19) for k in range(2)]
    rows += [award(f"o{k}", "ODD", 5e7, awarding_agency=f"A{k}", naics_code=str(k), modification_number=f"P{k}", competition_type="NOT COMPETED") for k in range(20)]
    return tables(spark, rows, [entity(f"U{i}") for i in range(19)] + [entity("ODD", dt.date(2026, 4, 1))])


def test_isolation_ranks_the_outlier_first(spark):
    a, e = isolation_tables(spark)
    rows = detect_isolation_outlier(a, e, AS_OF).orderBy("score", ascending=False).collect()
    assert rows[0]["uei"] == "ODD" and rows[0]["score"] > 0.5
    assert set(json.loads(rows[0]["details"])) == {"feature_vector", "raw_anomaly_score", "contamination_param"}


def test_isolation_handles_missing_ages_homogeneous_and_tiny_input(spark):
    a, e = tables(spark, [award(f"{i}", f"U{i}", 100.0) for i in range(20)], [entity(f"U{i}") for i in range(15)])
    for r in detect_isolation_outlier(a, e, AS_OF).collect():
        assert 0 <= r["score"] <= 1 and "NaN" not in r["details"]
    same, none = tables(spark, [award(f"{i}", f"U{i}", 100.0) for i in range(20)])
    assert detect_isolation_outlier(same, none, AS_OF).count() == 0
    one, _ = tables(spark, [award("a", "U", 1.0)])
    assert detect_isolation_outlier(one, none, AS_OF).count() == 0


def test_contract_over_all_detectors(spark):
    a, e = isolation_tables(spark)
    extra, _ = tables(spark, [award(f"n{i}", "NINES", 9000.0 + i) for i in range(40)])
    a = a.union(extra)
    results = all_detectors(detect_benford(a), detect_mod_growth(a), detect_new_entity_sole_source(a, e), detect_isolation_outlier(a, e, AS_OF))
    assert [f.name for f in results.schema] == RESULT.names
    assert contract_violations(results).count() == 0
    assert top(results, 1).count() == 1


def test_empty_input_gives_empty_typed_frames(spark):
    a, e = tables(spark, [])
    for frame in (detect_benford(a), detect_mod_growth(a), detect_new_entity_sole_source(a, e), detect_isolation_outlier(a, e, AS_OF)):
        assert frame.count() == 0 and [f.dataType for f in frame.schema] == [f.dataType for f in RESULT]


def test_contract_violations_are_found(spark):
    rows = spark.createDataFrame([("a", "x", 1.5, "{}"), ("b", "x", 0.5, "no"), ("c", "x", 0.5, "{}"), ("c", "x", 0.5, "{}")], RESULT)
    assert sorted(r["reason"] for r in contract_violations(rows).collect()) == ["details", "repeated", "repeated", "score"]


def test_exact_quantiles(spark):
    from awardlens.operators.quantiles import exact_quantile

    rng = np.random.default_rng(5)
    cases = [rng.normal(size=3000), np.repeat([1.0, 2.0, 7.0], [500, 1, 900]), np.array([3.0]), np.concatenate((rng.random(500), np.full(800, 0.5), [1e9, -1e9]))]
    for values in cases:
        df = spark.createDataFrame([(float(x), "extra") for x in values] + [(None, None), (float("nan"), None)], "x double, n string")
        for share in (0.0, 0.05, 0.31, 0.5, 1.0):
            assert exact_quantile(df, "x", share, few=50) == pytest.approx(np.quantile(values, share), rel=1e-12)
    assert exact_quantile(spark.createDataFrame([(None,)], "x double"), "x", 0.5) is None


def test_detectors_pass_over_nulls_and_ignore_other_columns(spark):
    names = ["award_id", "parent_award_id", "recipient_uei", "awarding_agency", "naics_code", "total_obligation", "award_date", "competition_type", "modification_number"]
    kinds = {"total_obligation": "double", "award_date": "date"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names) + ", uei int, score string, n long"
    day = dt.date(2001, 1, 1)
    rows = [(f"A{i}", f"P{i % 20}", f"U{i % 4}", "x", "1", float(10 + i), day, "NOT COMPETED", str(i % 3)) for i in range(160)]
    rows += [rows[0], rows[0], (None,) * 9, (None, None, "U0", None, None, 5.0, None, None, None), ("A", "P", "U0", "x", None, float("nan"), day, None, None), ("B", "P", None, "x", None, 5.0, day, None, None)]
    awards = spark.createDataFrame([(*r, 7, "clash", 9) for r in rows], schema)
    entities = spark.createDataFrame([(f"U{i}", day, 1) for i in range(3)] + [(None, day, 1), ("U3", None, 1)], "uei string, registration_date date, score int")
    results = all_detectors(detect_benford(awards), detect_mod_growth(awards), detect_new_entity_sole_source(awards, entities), detect_isolation_outlier(awards, entities, "2002-01-01"))
    assert contract_violations(results).count() == 0 and results.filter("detector = 'benford'").count() == 4
    none = awards.limit(0)
    assert all(d.count() == 0 for d in (detect_benford(none), detect_mod_growth(none), detect_new_entity_sole_source(none, entities), detect_isolation_outlier(none, entities, "2002-01-01")))

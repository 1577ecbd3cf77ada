from __future__ import annotations

import random

import duckdb
import pytest

from awardlens.llm.mixing import CAP, pareto_mix, source_targets
from awardlens.llm.queries_mixing import ORACLES, op3_pareto_mix
from pyspark.sql import functions as F

ROWS = [(i, f"s{i % 7}" if i % 50 else None, (i * 37) % 211) for i in range(6000)] + [(None, "s1", 40), (None, "s1", 40), (3, "s3", 5), (3, "s3", 5)]


def plain_targets(sizes):
    """The rule as told: shares by weight, what is above the cap goes back to the others, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > CAP * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / total for s in free}
        for s in above:
            target[s] = CAP * sizes[s]
            left -= target[s]
        free -= above
    return target


def test_targets_follow_the_rule(spark):
    sizes = {}
    for _, s, n in ROWS:
        sizes[s] = sizes.get(s, 0) + n
    sizes |= {"tiny": 10, "none": 0}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").withColumn("m_weight", F.lit(1.0))
    got = {r["m_source"]: r["m_target"] for r in source_targets(rows, "source", "size").collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_targets_of_many_sources(spark):
    rng = random.Random(4)
    names = [None, *{"".join(rng.choices("abzAZé0😀", k=rng.randint(0, 6))) for _ in range(300)}]
    sizes = {s: rng.choice([0, 1, 2, 5, 40, 300, 9000]) for s in names}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").withColumn("m_weight", F.lit(1.0))
    found = source_targets(rows.repartition(7), "source", "size").collect()
    order = sorted(names, key=lambda s: (s is None, s or ""))
    assert [r["m_source"] for r in sorted(found, key=lambda r: r["m_rank"])] == order
    assert {r["m_source"]: r["m_target"] for r in found} == pytest.approx(plain_targets(sizes))


def test_mix_is_near_its_targets_and_agrees_with_itself(spark):
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in ROWS], "doc_id long, source string, size long, taken string, target double")
    mixed = pareto_mix(docs)
    rows = [tuple(r) for r in mixed.collect()]
    assert mixed.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"] and len(rows) == len(ROWS)
    taken, target = {}, {}
    for _, s, n, _, t, c, k in rows:
        assert k == c * n and 0 <= c <= CAP
        taken[s], target[s] = taken.get(s, 0) + k, t
    for s in target:
        assert taken[s] == pytest.approx(target[s], rel=0.01)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(rows, key=key) == sorted((tuple(r) for r in pareto_mix(docs.repartition(7)).collect()), key=key)


def test_weights_shift_copies_to_heavier_documents(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", 10, 1.0 if i % 4 < 2 else 3.0) for i in range(4000)], "doc_id long, source string, size long, w double")
    rows = pareto_mix(docs, weight_col="w").groupBy("w").agg(F.avg("copies").alias("c")).collect()
    by = {r["w"]: r["c"] for r in rows}
    assert by[3.0] > 2 * by[1.0]
    odd = docs.withColumn("w", F.when(F.col("doc_id") < 10, -1.0))
    assert pareto_mix(odd, weight_col="w").filter("copies > 0").count() == 0


def test_empty_and_wordless_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, size long")
    assert pareto_mix(docs).count() == 0
    zero = spark.createDataFrame([(1, None, None), (2, "a", 0)], "doc_id long, source string, size long")
    assert [r["taken"] for r in pareto_mix(zero).collect()] == [0, 0]


def test_one_source_is_taken_whole_and_no_window_holds_it(spark, monkeypatch):
    from awardlens.llm import mixing

    seen = []
    plain = mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda df, name: (seen.append((name, plain(df, name))), seen[-1][1])[1])
    docs = spark.createDataFrame([(i, "only", 1 + i % 9) for i in range(20_000)], "doc_id long, source string, size long")
    rows = pareto_mix(docs).collect()
    assert all(r["copies"] == 1 for r in rows)
    assert all(t.count() == 0 for name, t in seen if name == "mix-inside")
    # next to whole copies: nearly all ranks are in the last bucket, and its pieces stay small
    seen.clear()
    docs = spark.createDataFrame([(i, "a", 1.0 if i else 40.0, 10) for i in range(20_000)], "doc_id long, source string, w double, size long")
    rows = pareto_mix(docs, weight_col="w").collect()
    assert sum(r["taken"] for r in rows) == pytest.approx(200_000, rel=0.01)
    for name, t in seen:
        if name == "mix-inside" and t.count():
            assert t.groupBy("m_rank", "m_piece").count().agg(F.max("count")).first()[0] < 4 * mixing.BUCKET_ROWS


def test_columns_named_like_scratch_ones_stay(spark):
    docs = spark.createDataFrame([(i, "s", 3, f"q{i}", "t", i) for i in range(50)], "doc_id long, source string, size long, m_q string, target string, `m.row` long")
    out = pareto_mix(docs)
    assert out.columns == ["doc_id", "source", "size", "m_q", "m.row", "source_size", "target", "copies", "taken"]
    assert sorted((r["doc_id"], r["m_q"], r["m.row"]) for r in out.collect()) == [(i, f"q{i}", i) for i in range(50)]


def test_query_matches_its_sql(spark, tmp_path):
    docs = spark.createDataFrame([(i, s, " ".join("w" * n) if n % 5 else None) for i, s, n in ROWS], "doc_id long, source string, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in op3_pareto_mix(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLES['op3_pareto_mix']})").fetchall()
    assert got == sorted((str(a), b, c, round(d, 6), e) for a, b, c, d, e in want)

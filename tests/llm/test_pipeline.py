from __future__ import annotations

import random
import re

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline as P
from awardlens.llm.quality import THRESHOLD, score, train
from awardlens.llm.queries_mixing import MIX_SQL
from awardlens.llm.queries_pii import session_key

from test_pii import plain_text

SF = "/root/testdata/sf0.001"


def test_stages_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    now = docs
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, now, SF)
        rows = out.collect()
        kept[name] = {r["doc_id"] for r in rows}
        if k + 1 < len(P.STAGES):
            assert out.columns == columns
            now = spark.createDataFrame(rows, out.schema)
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontamination", "pseudonyms", "mix"]
    _, scorer, _ = train(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept["quality"] == {r["doc_id"] for r in score(docs.select("doc_id", "text"), scorer).collect() if r["bad_score"] < THRESHOLD}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    shingles = {}
    for i in kept["quality"]:
        w = texts[i].encode().lower().split()
        shingles[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    near = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    root = {i: i for i in kept["quality"]}
    for a in sorted(root):
        for b in sorted(root):
            if b < a and root[a] != root[b] and near(a, b):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert kept["near_dedup"] == {i for i, r in root.items() if i == r}
    assert kept["decontamination"] < kept["near_dedup"] and kept["pseudonyms"] == kept["decontamination"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_the_last_three_stages_match_plain_versions(spark):
    """Decontamination by all windows, pseudonyms value by value, the mix by the SQL of its operator."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    windows = {tuple(w[k : k + 10]) for b in bench if (w := words(b["text"])) for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    held = {r["doc_id"]: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)) for r in docs.collect() if (w := words(r["text"])) is not None}
    clean = P.decontamination(spark, docs, SF)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, hit in held.items() if not hit} and any(held.values())

    key = session_key(spark)
    safe = P.pseudonyms(spark, clean, SF)
    before = {r["doc_id"]: r for r in clean.collect()}
    after = {r["doc_id"]: r for r in safe.collect()}
    assert before.keys() == after.keys() and safe.columns == docs.columns
    for i, r in after.items():
        text = None if before[i]["text"] is None else plain_text(before[i]["text"], key)[0]
        assert r["text"] == text and r["n_chars"] == (before[i]["n_chars"] if text is None else len(text))
        assert (r["lang"], r["source"]) == (before[i]["lang"], before[i]["source"])

    con = duckdb.connect()
    con.register("held", pa.table({"doc_id": list(after), "source": [r["source"] for r in after.values()], "size": [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in after.values()]}))
    want = con.execute(f"WITH sized AS (SELECT * FROM held),{MIX_SQL} SELECT doc_id, taken FROM mixed WHERE taken > 0").fetchall()
    got = P.mix(spark, spark.createDataFrame(list(after.values()), safe.schema), SF)
    assert sorted((r["doc_id"], r["taken"]) for r in got.collect() if r["taken"]) == sorted(want)


def test_odd_documents_pass_through_all_stages(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, very long and empty texts, and columns named like those used inside."""
    rng = random.Random(4)
    vocabulary = [f"word{k}" for k in range(900)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = [(i, prose(60), "en", f"s{i % 3}", 1, i, "t", 2) for i in range(150)]
    rows += [(None, prose(80), None, None, None, None, None, None), (None, prose(80), None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [rows[3], rows[3], (3, prose(50), "en", "s0", 1, 0, "t", 2), (900, rows[5][1] + " tail", "en", "s1", 1, 0, "t", 2), (901, "", "en", "s1", 0, 0, "t", 2)]
    rows += [(910, prose(60_000), "en", "s2", 1, 0, "t", 2), (911, "x@" + "a." * 100_000 + " " + prose(300), "en", "s2", 1, 0, "t", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, bad_score string, pii_parts int")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[7][1]), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = docs, {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, now, str(tmp_path))
        kept[name] = out.collect()
        if k + 1 < len(P.STAGES):
            assert out.columns == docs.columns
            now = spark.createDataFrame(kept[name], out.schema)
    ids = {name: [r["doc_id"] for r in found] for name, found in kept.items()}
    assert ids["quality"].count(3) == 4 and {911, 910} <= set(ids["pseudonyms"])
    assert ids["near_dedup"].count(3) == 2 and 900 not in ids["near_dedup"] and ids["near_dedup"].count(None) == 2  # the null text is a wordless one, as that of 901
    assert 7 not in ids["decontamination"] and sorted(map(str, ids["pseudonyms"])) == sorted(map(str, ids["decontamination"]))
    assert kept["mix"][0].asDict().keys() == {*docs.columns, "source_size", "target", "copies", "taken"}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", ["conftest"])
def test_entry_lists_the_queries(name):
    import __spark_entry__ as entry

    known = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {k[: k.index("_") + 1] for k in known if k.startswith("op")} and "pipeline" in known
    assert set(entry.oracle_sql()) <= set(known)

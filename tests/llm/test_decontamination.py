from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from awardlens.llm import decontamination as D
from awardlens.llm.common import collected

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, bench, window=10):
    out = []
    for _, text in docs:
        w, hit, items = split(text), set(), set()
        for item, passage in bench:
            b = split(passage)
            n = min(window, len(b))
            for j in range(len(b) - n + 1 if b else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == b[j : j + n]:
                        hit |= set(range(i, i + n))
                        items.add(item)
        out.append((len(w), hit, items))
    return out


def tables(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(25)] + ["é", "Naïve", "x-y", "Z"]
    bench = [(i, " ".join(rng.choices(words, k=k))) for i, k in enumerate((30, 12, 10, 9, 3, 1, 22))] + [(50, None), (51, "?!"), (52, None)]
    bench.append((60, bench[0][1]))
    docs = []
    for i in range(80):
        text = rng.choices(words, k=rng.randint(0, 80))
        if i % 3 == 0:
            b = bench[rng.randrange(7)][1].split()
            a = rng.randrange(len(b))
            text[5:5] = b[a : a + rng.randint(1, 25)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(200, None), (201, ""), (202, bench[0][1].upper()), (202, bench[0][1].upper()), (None, bench[1][1]), (None, "nothing"), (203, (bench[2][1] + " ") * 400)]
    frames = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, d_hits string"), spark.createDataFrame(bench, "item_id long, text string")
    return docs, bench, frames


def test_phrases_match_brute_force(spark):
    docs, bench, (d, b) = tables(spark)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["d_words"], sorted(r["d_hits"]), sorted(r["d_items"])) for r in D.phrase_matches(d, b).collect())
    assert got == sorted((i if i is not None else -1, n, sorted(h), sorted(s)) for (i, _), (n, h, s) in zip(docs, plain(docs, bench), strict=True))


def test_proximity_matches_brute_force(spark):
    docs, bench, (d, b) = tables(spark)
    index = D.build_index(d)
    hashes = {(r["doc_id"], r["h"]): r["text"] for r in d.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()}
    got = {(hashes[r["p_id"], r["p_hash"]], r["item_id"], r["start"], r["at"]) for r in D.proximity_matches(index, b, window=4, within=7).collect()}
    want = set()
    for _, text in docs:
        w = split(text)
        for item, passage in bench:
            words = split(passage)
            n = min(4, len(words))
            for j in range(len(words) - n + 1 if words else 0):
                need = set(words[j : j + n])
                at = [i for i in range(len(w)) if w[i] in need and need <= set(w[i : i + 7])]
                if at:
                    want.add((text, item, j, at[0]))
    assert len(want) > 100 and got == want


def test_a_stored_index_serves_another_test_set(spark, tmp_path):
    docs, bench, (d, b) = tables(spark)
    D.build_index(d, path=f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    assert index.columns == list(D.POSTING) and index.count() == sum(len(split(t)) for _, t in docs)
    few = b.filter("item_id <> 0")
    got = sorted((r["d_words"], len(r["d_hits"])) for r in D.phrase_matches(d, few, index=index).collect())
    assert got == sorted((n, len(h)) for n, h, _ in plain(docs, [x for x in bench if x[0] != 0]))


def test_shuffles_give_the_same_as_broadcasts(spark, monkeypatch):
    docs, bench, (d, b) = tables(spark)
    monkeypatch.setattr(D, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(D, "BROADCAST_BYTES", -1)
    got = sorted((r["d_words"], len(r["d_hits"])) for r in D.phrase_matches(d, b).collect())
    assert got == sorted((n, len(h)) for n, h, _ in plain(docs, bench))
    assert D.decontaminate(d, b).count() == sum(not h for _, h, _ in plain(docs, bench))


def test_clashing_columns_stay(spark):
    _, _, (d, b) = tables(spark)
    odd = d.select(F.col("doc_id").alias("p_id"), "text", *[F.lit(k).alias(c) for k, c in enumerate(("p_words", "p_found", "p_hash", "d_hash", "term", "i.x"))])
    out = D.phrase_matches(odd, b, id_col="p_id")
    assert out.columns == [*odd.columns, "d_words", "d_items", "d_hits"]
    assert {tuple(r)[2:8] for r in out.collect()} == {(0, 1, 2, 3, 4, 5)}
    assert D.decontaminate(odd, b, id_col="p_id").columns == odd.columns


def test_decontaminated_documents_and_empty_tables(spark):
    docs, bench, (d, b) = tables(spark)
    clean = sum(not h for _, h, _ in plain(docs, bench))
    out = D.decontaminate(d.drop("d_hits"), b)
    assert out.count() == clean and out.columns == ["doc_id", "text"]
    assert D.phrase_matches(d.limit(0), b).count() == 0
    assert D.decontaminate(d.drop("d_hits"), b.limit(0)).count() == len(docs)


def test_decontamination_stores_only_postings_that_are_looked_up(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(f"x{i}" for i in range(500))), (3, "w0 w1"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", " ".join(words[5:17])), ("b", "w0 w1"), ("c", "absent " * 10)], "item_id string, text string")
    with collected() as held:
        hits = {r["p_id"]: (sorted(r["d_items"]), sorted(r["d_hits"])) for r in D.phrase_hits(docs, bench).collect()}
    assert hits == {1: (["a", "b"], [0, 1, *range(5, 17)]), 3: (["b"], [0, 1])}
    (path,) = [p for p in held if "/decon-index-" in p]
    assert 0 < spark.read.parquet(path).count() <= 16  # of 542 words
    assert [r["doc_id"] for r in D.decontaminate(docs, bench).orderBy("doc_id").collect()] == [2, 4]

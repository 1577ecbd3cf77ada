"""Compression-distance toxicity: windows and histograms against plain code, held-out accuracy, odd input."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from awardlens.llm import toxicity as T
from awardlens.llm.queries_toxicity import op12_compression_toxicity

SMALL = "/root/testdata/sf0.01"


def plain_windows(text: str | None) -> list[bytes]:
    """Word by word: pieces of at most LONGEST_WORD bytes, so many to a window, with what lies between them and a blank at either end."""
    data = " " + (text or "") + " "
    raw = bytearray()
    for c in data:
        raw += b" " if c in "\t\n\v\f\r " else c.lower().encode() if c.isascii() else c.encode()
    starts, i = [], 0
    while i < len(raw):
        if raw[i] == 32:
            i += 1
            continue
        j = i
        while raw[j] != 32:
            j += 1
        starts += range(i, j, T.LONGEST_WORD)
        i = j
    begins = starts[:: T.WINDOW_WORDS]
    return [bytes(raw[b - 1 : (begins[k + 1] if k + 1 < len(begins) else len(raw))]) for k, b in enumerate(begins)]


def test_windows_match_plain_code():
    rng = random.Random(5)
    texts = [None, "", "  ", "a", "x" * 300, "Étion\tIdiot\n\nb " * 40, " lead and trail "]
    texts += ["".join(rng.choice("ab É\n\t\x0b") for _ in range(rng.randrange(400))) for _ in range(200)]
    for text in texts:
        data = T.folded(text)
        assert [data[a : a + n] for a, n in T.window_bounds(data).astype(int)] == plain_windows(text)


def test_histograms_match_one_compression_each(monkeypatch):
    monkeypatch.setattr(T, "CHUNK_BYTES", 700)  # many pieces, also within a text
    texts = ["so worthless and disgusting " * 90, "", None, "clown " * 3, "w" * 500, "plain words only here " * 20]
    distances = T.Distances(b" worthless  disgusting " * 2, b" plain words " * 2)
    got = distances.histograms(texts)
    for row, text in zip(got, texts):
        want = np.zeros(len(row), int)
        for window in plain_windows(text):
            d = len(distances.ordinary.compress(window)) - len(distances.toxic.compress(window))
            want[min(max(d, T.LEAST), T.MOST) - T.LEAST] += 1
        assert row.tolist() == want.tolist()
    assert got[0][: -T.LEAST + 1].sum() < got[0].sum()


def test_copies_make_no_mark():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "sta"]) for _ in range(3))
    ordinary = [" ".join(word() for _ in range(200)) for _ in range(200)]
    toxic = [" ".join(word() for _ in range(60)) + " grobian " + " ".join(word() for _ in range(60)) for _ in range(60)]
    toxic += ["zzyzzyx among the copies"] * 500
    marked = T.marks(T._neighbourhoods(toxic), T._neighbourhoods(ordinary))
    assert b" grob" in marked and b"zzyzz" not in marked
    assert set(T.fragments(T._neighbourhoods(["ein grobian hier"]), marked)) == {b" grobian "}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learns = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = T.train(docs, labels, learns)
    held = T.toxicity(docs.join(labels.filter(~learns), "doc_id"), model).select("toxic", "toxic_score").toPandas()
    said = held["toxic_score"] >= 0.5
    assert (said == (held["toxic"] == 1)).mean() > 0.91  # 0.976 where five times as many labels train (README)
    assert held.loc[said, "toxic"].mean() > 0.7
    rank = held["toxic_score"].rank()
    bad = held["toxic"] == 1
    assert (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum()) > 0.75


def test_query_is_whole_and_repeats(spark):
    rows = op12_compression_toxicity(spark, SMALL).toPandas()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert len(rows) == docs.count() and rows["score"].between(0, 1).all()
    assert ((rows["score"] >= 0.5) == (rows["predicted"] == 1)).all()
    again = op12_compression_toxicity(spark, SMALL).toPandas()
    assert rows.sort_values("doc_id")["score"].tolist() == again.sort_values("doc_id")["score"].tolist()


def test_odd_input(spark):
    docs = spark.createDataFrame(
        [(1, "some words", "x", 1.0), (1, "some words", "y", 2.0), (None, None, None, None), (2, "", "z", 0.0), (3, "t" * 100_000, "z", 0.0)], "doc_id long, text string, toxic_text string, Toxic_Score double"
    )
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (9, 1)], "doc_id long, toxic int")
    model = T.train(docs, labels, F.lit(True))
    out = T.toxicity(docs, model)
    assert out.columns == ["doc_id", "text", "toxic_text", "toxic_score", "toxic_windows"]
    rows = out.collect()
    assert len(rows) == 5 and all(0 <= r["toxic_score"] <= 1 for r in rows)
    assert {r["toxic_text"] for r in rows} == {"x", "y", "z", None}
    assert T.toxicity(docs.limit(0), model).count() == 0
    assert T.toxicity(docs, T.train(docs.limit(0), labels.limit(0), F.lit(True))).filter("toxic_score = 0.5").count() == 5

from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from awardlens.llm import quality as Q


def corpus(n=1200):
    rng = random.Random(10)
    words = [f"word{i}" for i in range(800)]
    docs, labels, bad = [], [], {}
    for i in range(n):
        text = rng.choices(words, k=rng.randint(30, 120))
        kind = i % 8
        if kind == 0:
            text = [w + "$$$" for w in text]
        elif kind == 1:
            text = [w.upper() + "!!" for w in text]
        elif kind == 2:
            text = [w for w in text[:5] for _ in range(12)]
        elif kind == 3:
            for w in ("idiot", "moron", "scum"):
                text.insert(rng.randrange(len(text)), w)
        bad[i] = kind < 4
        docs.append((i, " ".join(text)))
        if i % 3 == 0:
            labels.append((i, 0 if kind < 3 else 1, int(kind == 3)))
    return docs, labels, bad


def test_classifier_on_unlabelled_documents(spark):
    docs, labels, bad = corpus()
    d = spark.createDataFrame([(*r, 0.5) for r in docs], "doc_id long, text string, bad_score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, scorer, voted = Q.train(d, lab)
    assert voted.count() == len(docs)
    assert all(model.right[k] > 0.8 for k in (0, 1, 2, 5, 6, 7))
    rows = {r["doc_id"]: r["bad_score"] for r in Q.score(d, scorer).collect()}
    open_ = [i for i in bad if i % 3]
    assert np.mean([rows[i] >= Q.THRESHOLD for i in open_ if bad[i]]) > 0.97
    assert np.mean([rows[i] < Q.THRESHOLD for i in open_ if not bad[i]]) > 0.97
    kept = Q.accepted(d, lab)
    assert kept.columns == ["doc_id", "text", "bad_score"] and kept.filter("bad_score <> 0.5").isEmpty() and abs(kept.count() - sum(not b for b in bad.values())) < 40


def test_accuracies_are_recovered_from_overlaps():
    rng = np.random.default_rng(4)
    truth = rng.random(60_000) < 0.3
    right = np.array([0.9, 0.75, 0.8, 0.7, 0.85, 0.65, 0.95, 0.9])
    votes = np.where(rng.random((len(truth), 8)) < right, truth[:, None], ~truth[:, None])
    seen = rng.random(votes.shape) < 0.6
    patterns, counts = np.unique(["".join("-" if not s else "1" if v else "0" for v, s in zip(vs, ss, strict=True)) for vs, ss in zip(votes, seen, strict=True)], return_counts=True)
    model = Q.estimate(patterns.tolist(), counts.astype(float))
    assert np.abs(model.right - right).max() < 0.04 and abs(model.prior - 0.3) < 0.03


def test_without_labels_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a b c " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model, scorer, _ = Q.train(docs, none)
    assert Q.score(docs, scorer).count() == 4
    odd = spark.createDataFrame([(None, 1, 0), (9, None, None), (1, 1, None), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert {(r["l_id"], r["label"]) for r in Q.label_votes(odd, "doc_id").collect()} == {(9, None), (1, 1)}
    assert Q.accepted(docs.limit(0), none).count() == 0


def test_variety_covers_all_words_at_every_length():
    def variety(words):
        return Q.measures(b" ".join(words), words)["variety"]

    fresh = [b"w%d" % i for i in range(20_000)]
    assert variety(fresh[:1000] + [b"same", b"phrase"] * 9000 + fresh[1000:2000]) < 0.2
    assert variety(fresh) == 1.0 and variety(fresh[:500] * 2) == 0.5
    drawn = [fresh[k] for k in np.random.default_rng(1).integers(0, 2000, 6000)]
    assert abs(variety(drawn[:1999]) - variety(drawn[:2000])) < 0.01 and abs(variety(drawn[:2000]) - variety(drawn)) < 0.02


def test_abusive_words_come_from_the_labels(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(200):
        text = rng.choices([f"word{k}" for k in range(60)], k=40)
        if i % 10 == 0:
            text.insert(rng.randrange(40), "Zounderkite," if i % 20 else "(gobermouch)")
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 10 == 0)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    abusive = Q.abusive_words(d, lab, "doc_id", "text")
    assert abusive == {b"zounderkite", b"gobermouch"}
    words = b"what a zounderkite".split()
    assert Q.vote(b" ".join(words), words, Q.measures(b" ".join(words), words), abusive)[5] == "1"
    assert Q.abusive_words(d, lab.limit(0), "doc_id", "text") == frozenset()


def plain_votes(text, abusive):
    data = (text or "").encode()
    words, lines = data.split(), data.split(b"\n")
    n = max(1, len(words))
    symbols = sum(c < 128 and not chr(c).isalnum() and not chr(c).isspace() for c in data) / max(1, len(data))
    shouting = sum(w.isupper() for w in words) / n
    stutter = sum(words[i] == words[i - 1] for i in range(1, len(words))) / n
    seen = [words[i] not in words[i - i % 1000 : i] for i in range(len(words))]
    variety, repeated = sum(seen) / n, 1 - len(set(lines)) / len(lines)
    trimmed = {w.lower().strip(bytes(c for c in range(33, 127) if not chr(c).isalnum())) for w in words if len(w) < 24}
    insults = bool(trimmed & abusive)
    m = {"symbols": symbols, "shouting": shouting, "stutter": stutter, "variety": variety, "lines": repeated}
    bad = [symbols > 0.08, shouting > 0.2, stutter > 0.1, variety < 0.2, repeated > 0.25, insults]
    fine = symbols < 0.06 and shouting < 0.1 and stutter < 0.05 and variety > 0.3 and repeated < 0.2 and not insults
    return [1 if b else None for b in bad] + [0 if fine else None], m, words


def plain_model(votes):
    """Expectation-maximisation document by document: accuracies where two opinions meet, the prior over all."""
    right, prior = [0.8] * 7 + [0.95], 0.2
    posterior = lambda vs: 1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum((1 if v else -1) * math.log(r / (1 - r)) for v, r in zip(vs, right, strict=True) if v is not None))))
    for _ in range(100):
        bad = [posterior(vs) for vs in votes]
        hits, given = [0.0] * 8, [0] * 8
        for vs, p in zip(votes, bad, strict=True):
            if sum(v is not None for v in vs) > 1:
                for k, v in enumerate(vs):
                    if v is not None:
                        hits[k] += p if v else 1 - p
                        given[k] += 1
        prior = min(0.6, max(0.01, sum(bad) / len(bad)))
        right = [min(0.995, max(0.55, (h + 4) / (g + 5))) for h, g in zip(hits, given, strict=True)]
    return [posterior(vs) for vs in votes]


def test_query_matches_a_plain_version(spark):
    """Votes, accuracies and posteriors one document at a time, and a dense scorer, on the whole small table."""
    from awardlens.llm.queries_quality import op10_weak_labels

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {}
    for r in labels.collect():
        if r["quality"] is not None or r["toxic"] is not None:
            marks[r["doc_id"]] = max(marks.get(r["doc_id"], 0), int(r["quality"] == 0 or r["toxic"] == 1))
    abusive = Q.abusive_words(docs, labels, "doc_id", "text")
    order = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("h")).collect()}
    ids = sorted(texts, key=order.get)
    made = [plain_votes(texts[i], abusive) for i in ids]
    targets = np.array(plain_model([[*v, marks.get(i)] for i, (v, _, _) in zip(ids, made, strict=True)]))
    features = []
    for _, m, words in made:
        own = {w.lower().strip(Q.TRIM) for w in words} | {f"\0{k}={min(20, int(v * 20))}".encode() for k, v in m.items()} | {f"\0words={len(words).bit_length()}".encode()}
        features.append({zlib.crc32(f) % Q.DIMENSIONS for f in own})
    names = sorted(f for f, c in Counter(f for fs in features for f in fs).items() if c >= Q.LEAST_DOCS)
    x = np.array([[f in fs for f in names] for fs in features], float)
    w, square, bias, bias_square = np.zeros(len(names)), np.full(len(names), 1e-8), 0.0, 1e-8
    for _ in range(60):
        wrong = targets - 1 / (1 + np.exp(-(x @ w + bias)))
        g = x.T @ wrong / len(x) - 3e-4 * w
        square += g**2
        w += 0.3 * g / np.sqrt(square)
        bias_square += wrong.mean() ** 2
        bias += 0.3 * wrong.mean() / np.sqrt(bias_square)
    want = dict(zip(ids, 1 / (1 + np.exp(-(x @ w + bias))), strict=True))
    rows = op10_weak_labels(spark, sf).collect()
    assert len(rows) == len(texts)
    assert all(abs(r["bad_score"] - want[r["doc_id"]]) < 1e-3 and r["keep"] == (r["bad_score"] < Q.THRESHOLD) for r in rows)


def test_bounds_of_the_sample(spark):
    docs, labels, _ = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for options in ({"sample_docs": 40}, {"sample_features": 2000}):
        _, scorer, voted = Q.train(d, lab, **options)
        assert voted.count() == 300 and np.isfinite(scorer.weights).all()
    assert not Q.train(d, lab, sample_features=0)[1].weights.any()


def test_workers_hold_the_words_of_few_texts(spark, monkeypatch):
    """However many new words a batch has, a task holds those of one text, and a bounded cache."""
    taken, d = [], spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(d), "mapInPandas", lambda self, f, schema: taken.append(f) or self)
    Q.score(d, Q.Scorer(np.zeros(Q.DIMENSIONS, np.float32), 0.0))
    Q.heuristic_votes(d, "doc_id", "text")
    texts = [" ".join(f"w{i}x{k}" for k in range(100)) for i in range(4000)]
    batch = pd.DataFrame({"doc_id": range(4000), "text": texts, "q_id": range(4000), "q_text": texts})
    for f, most in zip(taken, (30e6, 5e6), strict=True):
        tracemalloc.start()
        assert [len(x) for x in f(iter([batch]))] == [4000]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most, peak

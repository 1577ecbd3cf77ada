from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from awardlens.llm import hmm as H


def test_forward_sums_over_all_state_paths_and_pools_keep_order():
    rng = np.random.default_rng(0)
    model = H.Model(*(x / x.sum(axis=a, keepdims=True) for x, a in ((rng.random(3), 0), (rng.random((3, 3)), 1), (rng.random((5, 3)), 0))))
    texts = [rng.integers(0, 5, n) for n in (4, 1, 6, 4, 2)]
    want = []
    for t in texts:
        total = 0.0
        for path in itertools.product(range(3), repeat=len(t)):
            p = model.start[path[0]] * model.emits[t[0], path[0]]
            for k in range(1, len(t)):
                p *= model.moves[path[k - 1], path[k]] * model.emits[t[k], path[k]]
            total += p
        want.append(math.log10(total))
    assert H.Pool(texts).log10(model) == pytest.approx(want)


def test_expected_counts_match_path_sums():
    rng = np.random.default_rng(1)
    model = H.Model(*(x / x.sum(axis=a, keepdims=True) for x, a in ((rng.random(2), 0), (rng.random((2, 2)), 1), (rng.random((4, 2)), 0))))
    texts = [rng.integers(0, 4, n) for n in (3, 5, 1)]
    start, moves, emits = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for t in texts:
        paths = {}
        for path in itertools.product(range(2), repeat=len(t)):
            p = model.start[path[0]] * model.emits[t[0], path[0]]
            for k in range(1, len(t)):
                p *= model.moves[path[k - 1], path[k]] * model.emits[t[k], path[k]]
            paths[path] = p
        total = sum(paths.values())
        for path, p in paths.items():
            start[path[0]] += p / total
            for k, s in enumerate(path):
                emits[t[k], s] += p / total
                if k:
                    moves[path[k - 1], s] += p / total
    for got, want in zip(H.Pool(texts).expected(model)[:3], (start, moves, emits), strict=True):
        assert got == pytest.approx(want)


def corpus(n=300):
    rng = random.Random(3)
    kinds = [[f"{a}{i}" for i in range(40)] for a in "xyz"]
    texts = [" ".join(rng.choices(kinds[i % 3], k=rng.randint(0, 60))) for i in range(n)]
    return [*texts, None, "", "never seen words", "X1 x1\tx1", "long " * 5000]


@pytest.mark.parametrize("known", [20, H.KNOWN])
def test_scores(spark, known):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    held = F.col("doc_id") % 7 == 2
    rows = {r["doc_id"]: r for r in H.hmm_scores(docs, held, known=known).collect()}
    counts = Counter()
    for i, t in enumerate(texts):
        if i % 7 != 2:
            counts.update((t or "").lower().split())
            counts[""] += 1
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        tokens = [*(t or "").lower().split(), ""]
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i % 7 == 2, len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
        assert r["score"] < 0
    if known == H.KNOWN:
        out = [r for r in rows.values() if r["held_out"] and r["n_tokens"] < 100]
        assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_are_sums_over_all_state_paths(spark, monkeypatch):
    """Every score, from the trained model's numbers by brute force, with words that are frequent, rare, and never seen."""
    seen = {}
    plain_trained, plain_vocabulary = H.trained, H.vocabulary
    monkeypatch.setattr(H, "FREQUENT", 6)
    monkeypatch.setattr(H, "trained", lambda *a: seen.setdefault("model", plain_trained(*a)))
    monkeypatch.setattr(H, "vocabulary", lambda counts, known: seen.setdefault("vocab", plain_vocabulary(counts, known, 6)))
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["the", "of", "a", "in", "Cat", "dog", "bird", "fish", "xox"], [9, 8, 7, 6, 3, 2, 1, 1, 1], k=rng.randint(0, 5))) for _ in range(80)] + ["unseen words", "birds", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, texts[1])], "doc_id long, text string")
    rows = H.hmm_scores(docs, F.col("doc_id") % 7 == 2, states=2, known=8).collect()
    model, vocab = seen["model"], seen["vocab"]
    counts = Counter()
    for i, t in [*enumerate(texts), (1, texts[1])]:
        if i % 7 != 2:
            counts.update([*(t or "").lower().encode().split(), b""])
    frequent = vocab.words[: vocab.frequent]
    assert len(frequent) == 6 and len(rows) == len(texts) + 1
    held = Counter()
    for w, c in counts.items():
        if w not in frequent:
            held[H.bucket(w)] += c + 1
    for r in rows:
        tokens = [*(texts[r["doc_id"]] or "").lower().encode().split(), b""]
        ids = [frequent.index(w) if w in frequent else len(frequent) + H.bucket(w) for w in tokens]
        total = 0.0
        for path in itertools.product(range(2), repeat=len(ids)):
            p = model.start[path[0]] * model.emits[ids[0], path[0]]
            for k in range(1, len(ids)):
                p *= model.moves[path[k - 1], path[k]] * model.emits[ids[k], path[k]]
            total += p
        share = sum(math.log10((counts[w] + 1) / (held[H.bucket(w)] + 1)) for w in tokens if w not in frequent)
        assert r["score"] == pytest.approx(math.log10(total) + share)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2, 3, 4)], "doc_id long, text string, ids int, rare int, row_key int, h_0 int")
    out = H.hmm_scores(docs, F.lit(False))
    assert out.columns == ["doc_id", "ids", "rare", "row_key", "h_0", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert tuple(out.first())[:5] == (1, 1, 2, 3, 4)


def test_training_raises_the_likelihood(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus())], "doc_id long, text string")
    total = [H.hmm_scores(docs, F.lit(False), rounds=k).agg(F.sum("score")).first()[0] for k in (0, 1, 3)]
    assert total[0] < total[1] <= total[2] + 1e-6


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(None, "a b"), (2, None)], "doc_id long, text string")
    rows = H.hmm_scores(docs, F.lit(True)).collect()
    assert [(r["train_tokens"], r["n_known"]) for r in rows] == [(0, 0), (0, 0)] and all(r["base_score"] == 0 and np.isfinite(r["score"]) for r in rows)
    assert H.hmm_scores(docs.limit(0), F.lit(False)).count() == 0

from __future__ import annotations

import random

from awardlens.llm import substring_index as X


def plain(docs, window):
    least = {}
    order = lambda i: X.LAST if i is None else i
    split = [(order(i), (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    passages = [rng.choices(words, k=k) for k in (49, 50, 51, 80, 200)]
    docs = []
    for i in range(120):
        text = rng.choices(words, k=rng.randint(0, 150))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 20)
            at = rng.randrange(len(text) + 1)
            text[at:at] = p[a:] if rng.random() < 0.5 else p
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(text)))
    docs += [(500 + k, docs[3 * k][1]) for k in range(10)] + [(600, docs[5][1].replace("\n", " ")), (601, None), (602, ""), (603, "same " * 300), (604, "same " * 100)]
    docs += [(None, docs[7][1]), (None, docs[7][1]), (7, docs[7][1]), (8, docs[7][1] + " more"), (8, "short")]
    return docs


def run(spark, docs, **options):
    frame = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, kept string")
    rows = X.remove_repeats(frame, **options).collect()
    return sorted((X.LAST if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows)


def test_matches_brute_force(spark):
    docs = corpus()
    assert run(spark, docs) == plain(docs, X.WINDOW)


def test_batches_compaction_and_shuffled_joins_change_nothing(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(X, "BROADCAST_IDS", 0)
    monkeypatch.setattr(X, "FAN_OUT", 1)
    assert run(spark, docs, window=20, run=8, batches=4) == plain(docs, 20)


def test_index_over_batches(spark, tmp_path):
    index = X.FingerprintIndex(spark, f"file://{tmp_path}/index", fan_out=2)
    frame = lambda *rows: spark.createDataFrame(rows, "doc long, print long")
    found = [sorted(r["print"] for r in index.add(frame(*rows)).distinct().collect()) for rows in (((1, 10), (1, 11), (2, 11)), ((3, 10), (3, 12)), ((4, 12), (4, 13)))]
    assert found == [[11], [10], [12]] and len(index.runs) == 1
    assert {(r["print"], r["low"], r["high"]) for r in next(iter(index.runs.values())).collect()} == {(10, 1, 3), (11, 1, 2), (12, 3, 4), (13, 4, 4)}


def test_later_calls_are_held_against_the_stored_index(spark, tmp_path):
    docs = [d for d in corpus() if d[0] is not None]
    path, kept, done = f"file://{tmp_path}/index", [], []
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    for k in range(3):
        batch = docs[k * len(docs) // 3 : (k + 1) * len(docs) // 3]
        rows = X.remove_repeats(frame(batch), window=20, run=8, batches=2, index_path=path, history=frame(done) if done else None).collect()
        kept += [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows]
        done += batch
        judged = sorted(x for x in plain(done, 20) if x[0] in {i for i, _ in batch})
        assert sorted(x for x in kept if x[0] in {i for i, _ in batch}) == judged
    index = X.FingerprintIndex(spark, path)
    assert 1 <= len(index.runs) <= X.FAN_OUT and index.scans().count() == len(docs)


def test_hot_digests_are_joined_apart(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(X, "HOT_ROWS", 20)
    monkeypatch.setattr(X, "HOT_SHARE", 1 << 30)
    assert run(spark, docs, window=20, run=8, batches=1) == plain(docs, 20)


def test_text_ids_and_clashing_columns(spark):
    docs = [(f"d{i:03d}" if i is not None else None, t) for i, t in corpus()]
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id string, text string, x_id int, sequence int, at int")
    out = X.remove_repeats(frame, window=20, run=8)
    assert out.columns == ["doc_id", "x_id", "sequence", "at", "n_words", "n_removed", "kept"]
    rows = out.collect()
    assert {tuple(r)[1:4] for r in rows} == {(1, 2, 3)}
    want = plain([(X.LAST_TEXT if i is None else i, t) for i, t in docs], 20)
    assert sorted((X.LAST_TEXT if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows) == want


def test_empty_table(spark):
    assert run(spark, corpus()[:1])[0][2] == 0
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert X.remove_repeats(frame).count() == 0

from __future__ import annotations

import hashlib
import random

import numpy as np
import xxhash

from awardlens.llm import simhash as S
from awardlens.llm.components import components


def plain_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=2):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, fps, strict=True):
            m = min(label[j] for j, b in zip(ids, fps, strict=True) if (a ^ b).bit_count() <= radius)
            if m < label[i]:
                label[i], changed = m, True
    return label


def test_fingerprints_and_components_match_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(120)]
    texts += [t + " x" for t in texts[:30]] + [texts[5]] * 40 + [None, "", " \t", "ONE", "one  two", "Ää ää É"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = {r["doc_id"]: r for r in S.simhash_components(docs).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    want = plain_components([i for i, _ in rows], fps)
    for (i, _), fp in zip(rows, fps, strict=True):
        assert got[i]["fp"] & (2**64 - 1) == fp and got[i]["component_id"] == want[i]


def test_every_link_is_found_through_shards_and_boundaries(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 400, dtype=np.int64)
    points = set(base.tolist())
    for p in base[:200].tolist():
        for _ in range(3):
            p ^= (1 << int(rng.integers(0, 63))) | (1 << int(rng.integers(0, 63)))
            points.add(p)
    fps = sorted(points)
    edges = S.hamming_links(spark.createDataFrame([(p,) for p in fps], "fp long"), sample=512, leaf=32)
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    want = plain_components(fps, fps)
    assert all(roots.get(p, p) == want[p] for p in fps)


def test_large_leaves_are_split_again(spark, monkeypatch):
    rng = np.random.default_rng(19)
    points = set(rng.integers(0, 1 << 63, 1500, dtype=np.int64).tolist())
    for p in list(points)[:500]:
        points.add(p ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))))
    fps = sorted(points)
    split = []
    plain = S._trees
    monkeypatch.setattr(S, "_trees", lambda dealt, sizes, *rest: (split.append(sizes), plain(dealt, sizes, *rest))[1])
    edges = S.hamming_links(spark.createDataFrame([(p,) for p in fps], "fp long"), sample=64, leaf=16)
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    array = np.array(fps, np.int64).view(np.uint64)
    linked = np.bitwise_count(array[:, None] ^ array[None]) <= 2
    label = np.arange(len(fps))
    while (least := np.where(linked, label[None], len(fps)).min(axis=1)).tolist() != label.tolist():
        label = least
    assert len(split) > 1
    assert [roots.get(p, p) for p in fps] == [fps[k] for k in label]


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "q r s t u v w x y z")], "doc_id long, text string")
    rows = sorted((str(r["doc_id"]), str(r["component_id"])) for r in S.simhash_components(docs).collect())
    assert rows == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]
    assert S.simhash_components(docs.limit(0)).count() == 0
    assert S.without_near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (1, 0), (1, 0)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(51)} == {0} and {got[1000 + i] for i in range(200)} == {1000} and got[5000] == 5000
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def similarity(a, b):
    a, b = (set(S.shingle_hashes(t, 5)[0].tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_duplicates_one_of_each_group_stays(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    originals = [rng.choices(words, k=rng.randint(60, 400)) for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(originals)]
    for i, w in enumerate(originals[:40]):
        for c in range(3):
            edited = list(w)
            for _ in range(max(1, len(w) // 120)):
                edited[rng.randrange(len(w))] = "edit"
            rows.append((1000 + 10 * i + c, " ".join(edited)))
    rows += [(5000, ""), (5001, None), (5002, "  "), (6000, rows[0][1].upper()), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    groups = {}
    for r in S.near_duplicate_groups(docs).collect():
        groups[(r["doc_id"], r["text_md5"])] = r["group_key"]
    by_id = {k[0]: g for k, g in groups.items()}
    texts = dict(rows)
    links = [(a, b) for a in texts for b in texts if a < b and similarity(texts[a], texts[b]) >= 0.8]
    assert len(links) > 100
    assert sum(by_id[a] == by_id[b] for a, b in links) >= 0.98 * len(links)
    kept = sorted(r["doc_id"] for r in S.without_near_duplicates(docs).collect())
    assert kept.count(0) == 1 and kept.count(5000) == 1 and 5001 not in kept and 6000 not in kept
    assert set(range(60)) <= set(kept)
    assert S.without_near_duplicates(docs).columns == docs.columns


def test_all_links_in_a_shard_of_partly_similar_members_are_found(spark):
    rng = np.random.default_rng(8)
    held = np.zeros((1500, 3000), np.float32)
    held[0, rng.choice(3000, 300, replace=False)] = 1
    for i in range(1, len(held)):  # each from an earlier one by 10 to 60 changes; up to 33 leave them linked
        held[i] = held[rng.integers(max(0, i - 300), i)]
        k = int(rng.integers(10, 61))
        out, new = rng.choice(np.flatnonzero(held[i]), k, replace=False), rng.choice(np.flatnonzero(held[i] == 0), k, replace=False)
        held[i, out], held[i, new] = 0, 1
    common = held @ held.T
    linked = common >= 0.8 * (600 - common)
    label = np.arange(len(held))
    while (least := np.where(linked, label[None], len(held)).min(axis=1)).tolist() != label.tolist():
        label = least
    names = [f"{i:05d}" for i in range(len(held))]
    sets = spark.createDataFrame([(n, np.flatnonzero(h).tolist()) for n, h in zip(names, held, strict=True)], "node string, shingles array<long>")
    shard = spark.createDataFrame([(n, 1) for n in names], "node string, shard long")
    got = {r["node"]: r["root"] for r in components(S._links(shard, sets, 0.8)).collect()}
    assert 50 < len(set(label.tolist())) < 1450
    assert [got.get(n, n) for n in names] == [names[k] for k in label]


def test_repeated_passages_do_not_hide_equal_shingle_sets(spark):
    rng = random.Random(6)
    rows = []
    for i in range(30):
        first, second = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(2))
        rows += [(10 * i, f"{first} {first} {first} {first} {first} {first} {second}"), (10 * i + 1, f"{first} {first} {second} {second} {second} {second} {second}")]
    texts = dict(rows)
    assert all(similarity(texts[10 * i], texts[10 * i + 1]) > 0.9 for i in range(30))
    assert any((plain_fingerprint(texts[10 * i], 5) ^ plain_fingerprint(texts[10 * i + 1], 5)).bit_count() > 18 for i in range(30))
    kept = S.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [10 * i for i in range(30)]


def test_null_and_repeated_ids_over_different_texts(spark):
    rng = random.Random(12)
    ids, texts = [], []
    for i in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(150)]
        for _ in range(2):
            edited = list(words)
            edited[rng.randrange(150)] = "edit"
            ids.append(None if i % 2 else 7)
            texts.append(" ".join(edited))
    ids += [None, 7, 7, None]
    texts += ["one short text", "another short text", texts[0], texts[2]]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    keys = {}
    for r in S.near_duplicate_groups(docs).collect():
        keys.setdefault(r["text_md5"], set()).add(r["group_key"])
    key = [keys[hashlib.md5(t.encode()).hexdigest()] for t in texts]
    assert all(len(k) == 1 for k in key)
    for a in range(len(texts)):
        for b in range(a):
            assert (key[a] == key[b]) == (similarity(texts[a], texts[b]) >= 0.8), (a, b)
    assert S.without_near_duplicates(docs).count() == 42


def test_rare_shingles_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    rng = np.random.default_rng(3)
    held = [set(rng.choice(14, int(rng.integers(4, 13)), replace=False).tolist()) for _ in range(150)]
    held = [set(x) for x in {frozenset(h) for h in held}]
    names = [f"{i:03d}" for i in range(len(held))]
    sets = spark.createDataFrame([(n, sorted(h)) for n, h in zip(names, held, strict=True)], "node string, shingles array<long>")
    left = spark.createDataFrame([(n, n) for n in names], "node string, root string")
    got = {(r["u"], r["v"]) for r in S._rest(left, S._ranked(sets), 0.8).collect()}
    want = {(a, b) for a, x in zip(names, held, strict=True) for b, y in zip(names, held, strict=True) if a < b and len(x & y) >= 0.8 * len(x | y)}
    assert len(want) > 5 and want <= got


def test_clashing_columns_and_ties(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 7), (1, "a b c", "y", 8), (2, "A b c", "z", 9)], "doc_id long, text string, g_row string, s_id long")
    out = S.without_near_duplicates(docs)
    assert out.columns == docs.columns and [r["doc_id"] for r in out.collect()] == [1]
    assert {(r["doc_id"], r["component_id"]) for r in S.simhash_components(docs).collect()} == {(1, 1), (2, 1)}


def test_a_large_group_of_edited_copies_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(15)
    original = [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(original))]
    for i in range(1, 400):
        edited = list(original)
        for _ in range(rng.randint(1, 16)):
            edited[rng.randrange(400)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(edited)))
    counts = []
    plain = S._rest
    monkeypatch.setattr(S, "_rest", lambda *a: (counts.append(plain(*a).count()), plain(*a))[1])
    kept = sorted(r["doc_id"] for r in S.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    sets = [set(S.shingle_hashes(t, 5)[0].tolist()) for _, t in rows]
    label = list(range(400))
    for i in range(400):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert kept == sorted(set(label)) and counts[0] < 4000


def test_near_fingerprints_link_similar_documents_without_a_common_band(spark, monkeypatch):
    plain = S._shards
    monkeypatch.setattr(S, "_shards", lambda classes: plain(classes).limit(0))
    rng = random.Random(21)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(9000)}" for _ in range(600)]
        edited = list(words)
        edited[rng.randrange(600)] = "edit"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
    texts = dict(rows)
    linked = {2 * i + 1 for i in range(60) if (plain_fingerprint(texts[2 * i], 5) ^ plain_fingerprint(texts[2 * i + 1], 5)).bit_count() <= S.RADIUS}
    assert len(linked) > 20 and all(similarity(texts[k - 1], texts[k]) >= 0.8 for k in linked)
    kept = {r["doc_id"] for r in S.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(texts) - linked


def test_fingerprints_alone_link_nothing_and_the_original_is_nearest_to_the_centre(spark):
    hashes = np.random.default_rng(2).integers(0, 1 << 62, (40, 100)).tolist()
    sets = spark.createDataFrame([(f"{k:02d}", h) for k, h in enumerate(hashes)], "node string, shingles array<long>")
    shards = spark.createDataFrame([(f"{k:02d}", 1 + k // 20) for k in range(40)], "node string, shard long")
    prints = spark.createDataFrame([(f"{k:02d}", -1 ^ (1 << k if k % 20 else 0)) for k in range(40)], "node string, fp long")
    near = spark.createDataFrame([(f"{k:02d}", "00") for k in range(1, 40)], "u string, v string")
    assert S._links(shards, sets, 0.8, near=near, prints=prints).count() == 0
    assert {(r["node"], r["far"], r["size"]) for r in S._centred(shards, prints).collect()} == {(f"{k:02d}", int(k % 20 > 0), 20) for k in range(40)}


def test_components_grow_by_the_links_between_them_alone(spark, monkeypatch):
    rng = random.Random(12)
    links = [(f"n{rng.randrange(120):03}", f"n{rng.randrange(120):03}") for _ in range(100)]
    followed, plain = [], S.components
    monkeypatch.setattr(S, "components", lambda edges: (followed.append(edges.count()), plain(edges))[1])
    roots, sizes = None, [50, 0, 30, 20]
    for n in sizes:
        part, links = links[:n], links[n:] + links[:n]
        roots = S._grown(roots, spark.createDataFrame(part, "u string, v string"))
    want = {r["node"]: r["root"] for r in plain(spark.createDataFrame(links, "u string, v string")).collect() if r["node"] != r["root"]}
    rows = [(r["node"], r["root"]) for r in roots.collect()]
    assert len(rows) == len(want) and dict(rows) == want
    assert followed[1] == 0 and followed[2] <= 30 and followed[3] <= 20  # not those of earlier rounds again


def test_components_that_are_stars_already_take_one_round(spark, monkeypatch):
    from awardlens.llm import components as C

    rounds, plain = [], C._stars
    monkeypatch.setattr(C, "_stars", lambda edges, large: (rounds.append(large), plain(edges, large))[1])
    assert {(r["node"], r["root"]) for r in C.components(spark.createDataFrame([(5, 1), (4, 1), (7, 6)], "u long, v long")).collect()} == {(1, 1), (4, 1), (5, 1), (6, 6), (7, 6)}
    assert rounds == [True, False]
    assert C.components(spark.createDataFrame([(3, 3)], "u long, v long")).collect()[0]["root"] == 3 and rounds == [True, False]

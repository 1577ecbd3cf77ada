"""Token alignment: units against whole texts, links against all pairs of byte ranges, the query against plain code."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from awardlens.llm import token_alignment as A
from awardlens.llm.queries_alignment import FOLDER, op11_token_alignment

SMALL = "/root/testdata/sf0.001"
ODD = ["", " ", "  two  blanks ", "\n", "a\n b", "tab\t tab", "x " * 5, "▁ under", "a▁b c", "<|endoftext|> is text", "<0x41> <s> </s> <unk>", "Été naïve 日本語 🙂🙂", "don't we'll", " nbsp  em", "\x1c sep \x1f", "\x00 nul", "ﬁ ﬀ é", "1234 56,7"]


@pytest.fixture(scope="module")
def sides():
    return A.Sides(FOLDER)


def plain(sides, text):
    """(ids of A, ids of B, links, groups) of a whole text, or None."""
    if not text:
        return None
    (a,), (b,) = sides.encode_a([text]), sides.encode_b([text])
    want = b" " + text.encode()
    if b"".join(sides.bytes_a[i] for i in a) != want or b"".join(sides.bytes_b[i] for i in b) != want:
        return None

    def spans(ids, table):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(table[i])))
            at = out[-1][1]
        return out

    sa, sb = spans(a, sides.bytes_a), spans(b, sides.bytes_b)
    links, j0 = [], 0
    for i, (s, e) in enumerate(sa):
        while sb[j0][1] <= s:
            j0 += 1
        j = j0
        while j < len(sb) and sb[j][0] < e:
            links.append((i, j))
            j += 1
    groups, ends, i, j = [], sorted({e for _, e in sa} & {e for _, e in sb}), 0, 0
    for end in ends:
        ga, gb = [], []
        while i < len(sa) and sa[i][1] <= end:
            ga.append(str(a[i]))
            i += 1
        while j < len(sb) and sb[j][1] <= end:
            gb.append(str(b[j]))
            j += 1
        groups.append(",".join(ga) + "|" + ",".join(gb))
    return a, b, links, groups


def expected(sides, texts):
    found = [plain(sides, t) for t in texts]
    counts = Counter((f[0][i], f[1][j]) for f in found if f for i, j in f[2])
    most: dict = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        pairs = [(f[0][i], f[1][j]) for i, j in f[2]]
        best = sum(counts[p] == most[p[1]] for p in pairs)
        out.append((len(f[0]), len(f[1]), len(f[3]), len(pairs), best, sum(counts[p] for p in pairs), hashlib.sha256(";".join(f[3]).encode()).hexdigest()))
    return out


def rows_of(df):
    return {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()}


def test_units_give_the_tokens_of_whole_texts(sides):
    rng = random.Random(11)
    texts = [t for t in ODD if t] + ["".join(rng.choice(["a", "Bc", " ", " ", "\n", "é", "日", "'s", "12", ".", "▁", " ", "\t"]) for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    own = A.Aligner(FOLDER)
    for text, got in zip(texts, own.align(texts)):
        want = plain(sides, text)
        assert (got is None) == (want is None), repr(text)
        if want:
            assert (got.n_a, got.n_b, got.n_groups, got.n_links) == (len(want[0]), len(want[1]), len(want[3]), len(want[2])), repr(text)
            assert got.digest.hexdigest() == hashlib.sha256(";".join(want[3]).encode()).hexdigest(), repr(text)
            keys, n = got.counted()
            pairs = Counter(want[0][i] * len(sides.bytes_b) + want[1][j] for i, j in want[2])
            assert dict(zip(keys.tolist(), n.tolist())) == pairs


def test_pieces_and_slices_change_nothing(monkeypatch):
    texts = [" ".join(random.Random(k).choices(["the", "quick", "brown\nfox", "über", "12.5", "  "], k=400)) for k in range(6)]
    whole = A.Aligner(FOLDER).align(texts)
    monkeypatch.setattr(A, "PIECE_CHARS", 100)
    monkeypatch.setattr(A, "SLICE_CHARS", 250)
    monkeypatch.setattr(A, "KNOWN_UNITS", 3)
    cut = A.Aligner(FOLDER).align(texts)
    for w, c in zip(whole, cut):
        assert (w.n_a, w.n_b, w.n_groups, w.n_links, w.digest.hexdigest()) == (c.n_a, c.n_b, c.n_groups, c.n_links, c.digest.hexdigest())
        assert all(np.array_equal(x, y) for x, y in zip(w.counted(), c.counted()))


@pytest.mark.parametrize("broadcast", [500_000, 40, 0])
def test_query_matches_plain_code(spark, sides, monkeypatch, broadcast):
    monkeypatch.setattr(A, "BROADCAST_PAIRS", broadcast)  # all, some or no pairs are broadcast
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = dict(zip([r["doc_id"] for r in docs], expected(sides, [r["text"] for r in docs])))
    assert rows_of(op11_token_alignment(spark, SMALL)) == want


def test_odd_input(spark, sides):
    texts = [*ODD, None, "word " * 3, "word " * 3, "z" * 50_000]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, row long, pairs string")
    assert rows_of(A.align_corpus(docs, FOLDER)) == dict(enumerate(expected(sides, texts)))
    twice = docs.unionByName(docs).withColumn("doc_id", docs["doc_id"] * 0)
    assert A.align_corpus(twice, FOLDER).count() == 2 * len(texts)
    assert A.align_corpus(docs.limit(0), FOLDER).count() == 0

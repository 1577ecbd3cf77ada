"""Conversation repair: auctions against all edit strings, segments against whole conversations, the query against plain code."""

from __future__ import annotations

import hashlib
import random
import zlib

from awardlens.llm import conversation_repair as C
from awardlens.llm.queries_conversations import op13_conversation_repair

SMALL = "/root/testdata/sf0.01"
SPACES = " \t\n\v\f\r"


def brute(shape: str) -> tuple[int, str]:
    """The least (cost, edits) over all edit strings, row by row: the best strings into every state."""
    follows, keeps = C._FOLLOWS, C._KEEPS

    def with_inserts(best):
        for _ in range(3):
            for q, (c, e) in list(best.items()):
                new = (c + 3, e + "I")
                if follows[q] not in best or new < best[follows[q]]:
                    best[follows[q]] = new
        return best

    best = with_inserts({0: (0, "")})
    for row in shape:
        new: dict[int, tuple[int, str]] = {}
        for q, (c, e) in best.items():
            steps = [(4, "D", q)]
            if row != "-":
                more = 3 if row.isupper() else 0
                steps.append((3 + more, "R", follows[q]))
                if (q, row.lower()) in keeps:
                    steps.append((more, "K", keeps[q, row.lower()]))
            for cost, letter, to in steps:
                new[to] = min(new.get(to, (10**9, "")), (c + cost, e + letter))
        best = with_inserts(new)
    return min(best[q] for q in (0, 3) if q in best)


def test_auction_matches_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        shape = "".join(rng.choice("suaSUAxX-") for _ in range(rng.randrange(12)))
        assert C.solve(shape) == brute(shape), shape
    for _ in range(10):
        shape = "".join(rng.choice("suaUA-") for _ in range(300))
        assert C.solve(shape) == brute(shape)


def test_prices_are_dual_feasible_and_tight_on_the_path():
    rng = random.Random(4)
    for _ in range(100):
        shape = "".join(rng.choice("suaSUAx-") for _ in range(20))
        price = C.prices(shape, C.ENDS)
        arcs = [(n, c, j) for n in range(4 * len(shape)) for _, c, j in C._arcs(shape, n)]
        assert all(price[n] <= c + price[j] for n, c, j in arcs)
        assert all(price[n] == min(c + price[j] for m, c, j in arcs if m == n) for n in range(0, 4 * len(shape), 7))


def test_segments_chain_to_the_whole():
    rng = random.Random(5)
    for _ in range(300):
        shape = "".join(rng.choice("suaSUAx-") for _ in range(rng.randrange(1, 30)))
        cuts = sorted(rng.sample(range(len(shape) + 1), min(3, len(shape))))
        parts = [shape[a:b] for a, b in zip([0, *cuts], [*cuts, len(shape)])]
        left, ends = C.ENDS, []
        for part in reversed(parts):
            ends.append(left)
            left = C.costs_before(part, left)
        state, edits = 0, ""
        for part, end in zip(parts, reversed(ends)):
            more, state = C.repairs(part, tuple(x - min(end) if x < C.FAR else C.FAR for x in end))[state]
            edits += more
        assert (left[0], edits + C.TAILS[state]) == C.solve(shape)


def plain(rows: list[tuple]) -> dict:
    """The query's rows by plain code: rows are (conv_id, turn, role, text), without two rows of one turn."""
    blank = lambda v: " " if v is None else str(v)
    convs: dict = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1])):
        kept = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        seen, shape, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in kept:
            body, letter = text.strip(SPACES), role[:1] if role[:1] in ("s", "u", "a") else "x"
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            shape += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        cost, audit = brute(shape)
        state, said, rest = 0, [], iter(kept)
        for e in audit:
            if e == "I":
                state = C._FOLLOWS[state]
                said.append("user:" if state == 2 else "assistant:")
                continue
            _, role, text = next(rest)
            if e == "K":
                state = C._KEEPS[state, role[:1]]
                said.append(f"{role}:{text}")
            elif e == "R":
                state = C._FOLLOWS[state]
                said.append(("user:" if state == 2 else "assistant:") + text)
        turns = [t for t, _, _ in kept if t is not None]
        initials = [r[:1] or " " for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def as_dict(df) -> dict:
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def test_query_matches_plain_code(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(op13_conversation_repair(spark, SMALL)) == plain(rows)


def test_long_conversation_and_odd_input(spark, tmp_path):
    rng = random.Random(6)
    big = 2**60 + 1
    rows = [(big, t, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "no", " ", "Why?", f"text {t}."])) for t in range(700)]
    rows += [(None, 1, "user", "Hi."), (None, None, "system", None), (None, 2, None, "x" * 200_000), (5, None, "user", "Only."), (big + 2, 2**62, "user", "Far!"), (big + 2, -5, "assistant", "Near\v")]
    rows += [(c, 0, "user", "Gone or not.") for c in range(100, 160)]
    spark.createDataFrame([(*r, "kept") for r in rows], "conv_id long, turn long, role string, text string, segment string").repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    got = as_dict(op13_conversation_repair(spark, str(tmp_path)))
    assert got == plain(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert (0, 0, 0, 0, 0, 0, "", empty) in got.values()


def test_repaired_rows_follow_the_grammar(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet")
    repaired, report = C.repair(rows)
    initials: dict = {}
    for r in repaired.orderBy("conv_id", "at", "sort").collect():
        initials[r["conv_id"]] = initials.get(r["conv_id"], "") + r["role"][0]
    import re

    assert all(re.fullmatch("s?(ua)+", i) for i in initials.values())
    assert report.count() == rows.select("conv_id").distinct().count()
    assert all(t.count() == 0 for t in C.repair(rows.limit(0)))


def test_equal_rows_of_one_turn(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Same.")] * 200 + [(1, 1, "assistant", "Fine.")], "conv_id long, turn long, role string, text string")
    (row,) = C.repair(rows)[1].collect()
    assert (row["duplicate"], row["cost"], row["audit"]) == (199, 199 * 4, "D" * 199 + "KK") or sorted(row["audit"]) == sorted("D" * 199 + "KK")

"""Conversations repaired at least cost: an auction algorithm for shortest paths on the lattice of rows and grammar states.

A conversation's role initials have to read ``(s?(ua)+)?``. Nodes are (rows consumed, what the initials so far end in); arcs
keep, re-role, delete or insert a row at whole-number costs. A path from an origin is extended along the arc of least cost
plus price, or contracted while its end's price is raised to that sum. Prices never exceed the cost left, and equal it once
the path arrives; origins are taken from the last row backwards with the prices of those before, so that each auction is
short. The converged prices expose the tight arcs, which are followed in the order of the edits' letters.

Spark orders the rows by ranges, so that no conversation is one task's work: it is cut into segments of 64 rows, each solved
on its own to costs between the four states at either end. Only those small tables are chained along a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import cut

#: Costs of the edits. Undeleted truncated rows cost ``TRUNCATED`` more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: What the initials so far end in: nothing, s, u or a. An inserted or re-roled row has the one role that may follow.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_KEEPS = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
_FOLLOWS = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)

#: Cost from each state at a conversation's end, and the inserts that it takes.
ENDS, TAILS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")

SEGMENT_BITS = 6
CACHED = 1 << 15
_BAD = "-"  # must be deleted
_GONE = "."  # dropped before: holds the conversation's place only
FAR = 1 << 40

Costs = tuple[int, ...]


def _arcs(shape: str, node: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next node) in the order of the edits' letters. Node 4 * i + q has consumed i rows and ended in state q."""
    i, q = divmod(node, 4)
    row, after = shape[i], _FOLLOWS[q]
    out = [("D", DELETE, node + 4), ("I", INSERT, 4 * i + after)]
    if row != _BAD:
        more = TRUNCATED if row.isupper() else 0
        kept = _KEEPS.get((q, row.lower()))
        if kept is not None:
            out.append(("K", KEEP + more, 4 * i + 4 + kept))
        out.append(("R", REROLE + more, 4 * i + 4 + after))
    return out


def prices(shape: str, ends: Sequence[int]) -> list[int]:
    """The least cost from every node to the end of ``shape``, ``ends`` being what is left from there (``FAR``: no way)."""
    n = len(shape)
    price = [0] * (4 * n) + list(ends)
    settled = [False] * (4 * n) + [True] * 4
    arcs = [_arcs(shape, node) for node in range(4 * n)]
    if FAR in ends:  # nodes without a way would be bid up for ever
        alive = [end < FAR for end in ends]
        for i in range(n - 1, -1, -1):
            onward = [any(alive[j % 4] for _, _, j in arcs[4 * i + q] if j >= 4 * i + 4) for q in range(4)]
            for _ in range(2):
                onward = [onward[q] or onward[_FOLLOWS[q]] for q in range(4)]
            for q in range(4):
                if not onward[q]:
                    price[4 * i + q], settled[4 * i + q] = FAR, True
            alive = onward
    for origin in range(4 * n - 1, -1, -1):
        path = [origin]
        while not settled[path[-1]]:
            end = path[-1]
            least, onward = min((cost + price[j], j) for _, cost, j in arcs[end])
            if price[end] < least:  # contract: the end's price rises, and all before it is looked at again
                price[end] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(onward)
        for node in path:
            settled[node] = True
    return price


def traced(shape: str, price: Sequence[int], state: int) -> tuple[str, int]:
    """The edits of the least cheapest path from ``state``, by their letters, and the state it ends in."""
    node, edits = state, []
    while node < 4 * len(shape):
        edit, _, node = next((e, c, j) for e, c, j in _arcs(shape, node) if price[node] == c + price[j])
        edits.append(edit)
    return "".join(edits), node % 4


@lru_cache(CACHED)
def crossing(shape: str) -> Costs:
    """Costs from each state before a segment to each state after it, row by row."""
    columns = [prices(shape, [0 if q == end else FAR for q in range(4)])[:4] for end in range(4)]
    return tuple(min(columns[end][q], FAR) for q in range(4) for end in range(4))


@lru_cache(CACHED)
def repairs(shape: str, ends: Costs) -> tuple[tuple[str, int], ...]:
    """For each state before a segment the edits of the cheapest way on and the state after it."""
    price = prices(shape, ends)
    return tuple(traced(shape, price, q) if price[q] < FAR else ("", q) for q in range(4))


def costs_before(shape: str, ends: Costs) -> Costs:
    """What is left from each state before a segment, from what is left after it."""
    across = crossing(shape)
    return tuple(min(min(across[4 * q + end] + ends[end], FAR) for end in range(4)) for q in range(4))


def solve(shape: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    price = prices(shape, ENDS)
    edits, state = traced(shape, price, START)
    return price[START], edits + TAILS[state]


def lines(shape: str, edits: str, state: int) -> list[str]:
    """What each row of a segment becomes: u and a for rows inserted before it, = for itself, U and A for itself re-roled."""
    out, now = [], ""
    rows = iter(shape)
    for edit in edits:
        if edit == "I":
            state = _FOLLOWS[state]
            now += "-sua"[state]
            continue
        row = next(rows)
        while row == _GONE:
            out.append("")
            row = next(rows)
        if edit == "K":
            state, now = _KEEPS[state, row.lower()], now + "="
        elif edit == "R":
            state = _FOLLOWS[state]
            now += "-sua"[state].upper()
        out.append(now)
        now = ""
    return out + [""] * (len(shape) - len(out))


def _ahead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of a conversation, last first: adds the costs left after and before each, and whether it is the last."""
    conv, left = (), ENDS
    for batch in batches:
        ends, totals, last = [], [], []
        for key, shape in zip(batch["key"], batch["shape"]):
            last.append(key != conv)
            if key != conv:
                conv, left = key, ENDS
            ends.append(list(left))
            left = costs_before(shape.replace(_GONE, ""), left)
            totals.append(left[START])
        yield batch.assign(ends=ends, total=totals, last=last)


def _along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of a conversation, first first: adds the edits, and what the counts need from the segment before."""
    conv, state, initial, turn = (), START, "", None
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            first = r.key != conv
            if first:
                conv, state, initial, turn = r.key, START, "", None
            edits, after = r.ways[state]["edits"], r.ways[state]["state"]
            done = lines(r.shape, edits, state)
            tail = TAILS[after] if r.last else ""
            initials = ([initial] if initial else []) + [i if len(i) == 1 else " " for i in r.initials]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            turns = r.turns - (turn is not None and r.least == turn)
            rows.append((edits + tail, done, {"": "", "I": "a", "II": "ua"}[tail], int(r.total) if first else 0, illegal, turns, first and r.last))
            state, initial, turn = after, initials[-1] if initials else "", r.most if r.most is not None else turn
        yield pd.concat([batch[["key", "segment", "last", "first_at", "least", "most", "blank", "duplicate", "truncated"]], pd.DataFrame(rows, columns=["audit", "lines", "tail", "cost", "illegal", "turns", "alone"])], axis=1)


@F.pandas_udf(ArrayType(StructType().add("edits", "string").add("state", "integer")))
def _ways(shapes: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for shape, left in zip(shapes, ends):
        least = min(left)
        scaled = tuple(int(x - least) if x < FAR else FAR for x in left)
        out.append([{"edits": e, "state": s} for e, s in repairs(shape.replace(_GONE, ""), scaled)])
    return pd.Series(out)


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def _shape(role: Column, text: Column, gone: Column) -> Column:
    """One letter a row: the role's initial (x: none that the grammar has), upper case where truncated, - where blank."""
    last = F.right(F.rtrim(text, F.lit(" \t\n\v\f\r")), F.lit(1))
    letter = F.when(_initial(role).isin("s", "u", "a"), _initial(role)).otherwise("x")
    return F.when(gone, _GONE).when(last == "", _BAD).when(last.isin(".", "!", "?"), letter).otherwise(F.upper(letter))


def ordered_turns(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, place, gone) with ``at``, which counts along each conversation in the order of its turns.

    Written to the shared folder. Rows of equal turns are ordered by role, hash of the text and ``place``; equal rows may
    change places. Ranges of rows are sorted apart, so that a conversation of any length is spread over tasks.
    """
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("tie"), F.col("place"), F.col("row")]
    keyed = rows.withColumn("row", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.length("role"), "role", "text"))
    out = dealt.select("conv_id", "turn", "role", "text", "gone", F.monotonically_increasing_id().alias("at"), _shape(F.col("role"), F.col("text"), F.col("gone")).alias("shape"), digest.alias("digest"))
    return cut(out, "turns")


def repair_segments(turns: DataFrame) -> DataFrame:
    """One row per conversation and segment of ``ordered_turns``: its edits, what becomes of each row, and its counts."""
    here = ~F.col("gone")
    narrow = turns.select("conv_id", "turn", "at", "shape", "digest", "gone", _initial(F.col("role")).alias("initial"))
    firsts = narrow.filter(here).groupBy("digest").agg(F.min("at").alias("first"))
    seen = narrow.join(firsts, "digest", "left").withColumn("again", here & (F.col("shape") != _BAD) & (F.col("at") > F.col("first")))
    letter = F.when(F.col("again"), _BAD).otherwise(F.col("shape"))
    count = lambda c: F.count_if(c).alias
    segments = seen.groupBy("conv_id", F.shiftright("at", SEGMENT_BITS).alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("at", letter.alias("letter"), F.when(here, F.col("initial")).alias("initial")))).alias("held"),
        F.min("at").alias("first_at"),
        F.min(F.when(here, F.col("turn"))).cast("string").alias("least"),
        F.max(F.when(here, F.col("turn"))).cast("string").alias("most"),
        F.size(F.collect_set(F.when(here, F.col("turn")))).alias("turns"),
        count(here & (F.col("shape") == _BAD))("blank"),
        count(F.col("again"))("duplicate"),
        count(here & ~F.col("again") & (F.upper("shape") == F.col("shape")) & ~F.col("shape").isin(_BAD, _GONE))("truncated"),
    )
    key = F.col("conv_id").cast("string").alias("key")  # pandas would turn whole numbers beside a null into floats
    letters, initials = (F.transform("held", lambda h: h[name]) for name in ("letter", "initial"))
    shaped = segments.select(key, "*", F.array_join(letters, "").alias("shape"), F.array_compact(initials).alias("initials")).drop("conv_id", "held")
    dealt = shaped.repartition("key").sortWithinPartitions("key", F.desc("segment"))
    ahead = dealt.mapInPandas(_ahead, StructType([*dealt.schema.fields]).add("ends", ArrayType(LongType())).add("total", "long").add("last", "boolean"))
    ways = ahead.withColumn("ways", _ways("shape", "ends")).sortWithinPartitions("key", "segment")
    fields = "key string, segment long, last boolean, first_at long, least string, most string, blank long, duplicate long, truncated long, audit string, lines array<string>, tail string, cost long, illegal long, turns long, alone boolean"
    return cut(ways.mapInPandas(_along, fields), "segments")


def repaired_turns(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, segment, at, sort (within a row's place), edit, role, text.

    Inserted rows have an empty text and the ``at`` of the row that they come before; at a conversation's end, of the last.
    """
    plan = segments.select("key", "segment", "first_at", "lines", "tail", F.size("lines").alias("n"))
    rows = turns.select("conv_id", F.shiftright("at", SEGMENT_BITS).alias("seg"), "at", "role", "text")
    joined = rows.join(plan, F.col("conv_id").cast("string").eqNullSafe(F.col("key")) & (F.col("seg") == F.col("segment")))
    nth = (F.col("at") - F.col("first_at")).cast("int")
    own = F.concat(F.get("lines", nth), F.when(nth == F.col("n") - 1, F.col("tail")).otherwise(""))
    each = joined.withColumn("own", own).select("conv_id", "segment", "at", "role", "text", F.posexplode(F.filter(F.split("own", ""), lambda c: c != "")).alias("sort", "line"))
    role = F.when(F.lower("line") == "u", "user").when(F.lower("line") == "a", "assistant").otherwise(F.col("role"))
    edit = F.when(F.col("line") == "=", "K").when(F.col("line").isin("U", "A"), "R").otherwise("I")
    return each.select("conv_id", "segment", "at", "sort", edit.alias("edit"), role.alias("role"), F.when(edit == "I", "").otherwise(F.col("text")).alias("text"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per conversation from its segments in order: sums, the whole audit, and the digest of the joined texts as they stream by."""
    for_now: dict | None = None
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if for_now is None or for_now["key"] != r.key:
                for_now = {"key": r.key, "turns": 0, "least": None, "most": None, "audit": [], "sha": hashlib.sha256(), "any": False} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
            for name in ("turns", "blank", "duplicate", "truncated", "illegal", "cost"):
                for_now[name] += int(getattr(r, name))
            for_now["least"] = for_now["least"] if for_now["least"] is not None else r.least
            for_now["most"] = r.most if r.most is not None else for_now["most"]
            for_now["audit"].append(r.audit)
            if r.body is not None:
                for_now["sha"].update((("\n" if for_now["any"] else "") + r.body).encode("utf-8", "replace"))
                for_now["any"] = True
            if r.last:
                gaps = int(for_now["most"]) - int(for_now["least"]) + 1 - for_now["turns"] if for_now["least"] is not None else 0
                out.append((for_now["key"], gaps, *(for_now[n] for n in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(for_now["audit"]), r.whole if r.whole is not None else for_now["sha"].hexdigest()))
                for_now = None
        yield pd.DataFrame(out, columns=["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


def repair_report(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 (of role:text, joined by newlines).

    A conversation of one segment is digested where it lies. The digest of a longer one needs its bytes in order: they stream
    through one task, a segment at a time, and are never held as a whole.
    """
    rows = repaired_turns(turns, segments)
    said = rows.groupBy(F.col("conv_id").cast("string").alias("k"), F.col("segment").alias("s")).agg(F.array_sort(F.collect_list(F.struct("at", "sort", F.concat("role", F.lit(":"), "text").alias("said")))).alias("held"))
    bodies = said.select("k", "s", F.array_join(F.transform("held", lambda h: h["said"]), "\n").alias("body"))
    joined = segments.drop("lines", "tail", "first_at").join(bodies, F.col("key").eqNullSafe(F.col("k")) & (F.col("segment") == F.col("s")), "left").drop("k", "s")
    whole = F.when(F.col("alone"), F.sha2(F.coalesce("body", F.lit("")), 256))
    dealt = joined.withColumns({"whole": whole, "body": F.when(~F.col("alone"), F.col("body"))}).repartition("key").sortWithinPartitions("key", "segment")
    told = dealt.mapInPandas(_digests, "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return told.withColumn("key", F.col("key").cast(turns.schema["conv_id"].dataType)).withColumnRenamed("key", "conv_id")


def prepared(rows: DataFrame) -> DataFrame:
    """Conversation rows as ``ordered_turns`` takes them: nulls as one blank; ``tie`` orders rows of one turn."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.concat(role, F.lit(":"), F.hex(F.xxhash64(text))).alias("tie"), F.lit(0).alias("place"), F.lit(False).alias("gone"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repaired rows, report) of conversations with the columns conv_id, turn, role and text; others are ignored.

    Null roles and texts count as one blank, null conv_ids as one conversation, null turns come first; rows of one turn are
    ordered by role and a hash of the text. Repeated rows are duplicates, an empty role or another initial than s, u and a
    can't be kept. An empty table gives empty results.
    """
    turns = ordered_turns(prepared(rows))
    segments = repair_segments(turns)
    return repaired_turns(turns, segments), repair_report(turns, segments)

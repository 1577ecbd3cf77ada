"""Two tokenizers' tokens of the same text aligned by bytes, and how often ids meet in the whole corpus.

Per batch the tokens of either side are a table of byte starts, keyed by document (each document's bytes have a range of
their own). ``pandas.merge_asof`` finds for each start the other side's covering token; both directions together are all
overlapping pairs. Where tokens of both sides end at the same byte, a group ends.

Neither tokenizer joins a blank to what stands before it, so that texts are encoded by units: a unit ends where a single
blank follows a character and precedes one. Units come back in natural text, and each worker keeps a bounded number of them.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import cut

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"

PIECE_CHARS, SLICE_CHARS = 1 << 18, 1 << 19  # a long text is aligned by pieces; so much text is aligned at once
KNOWN_UNITS, JOINED_CHARS = 400_000, 1 << 15
ROWS_OUT = 256
BROADCAST_PAIRS = 500_000  # pairs of ids with their counts, 20 MB; rarer ones are joined by a shuffle

_UNIT_END = re.compile(r"(?<=\S) (?=\S)")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes are themselves, the others follow 255."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Sides:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, folder: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.byte_bpe = Tokenizer.from_file(f"{folder}/{BYTE_BPE}")
        self.byte_bpe.encode_special_tokens = True  # their strings are ordinary text
        self.piece_bpe = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_BPE}")
        alphabet = _byte_alphabet()
        size = self.byte_bpe.get_vocab_size(with_added_tokens=True)
        names = [self.byte_bpe.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(alphabet[c] for c in n) if all(c in alphabet for c in n) else n.encode() for n in names]
        pieces = self.piece_bpe
        self.bytes_b = [bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(pieces.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(b) for b in side], np.int64) for side in (self.bytes_a, self.bytes_b))

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.byte_bpe.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.piece_bpe.encode(texts, num_threads=1)


class _Ragged:
    """Rows of ids, one after another, with their bounds."""

    def __init__(self) -> None:
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def extend(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(lengths)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows in turn, and how many each has."""
        begins, n = self.bounds[rows], self.bounds[rows + 1] - self.bounds[rows]
        return self.ids[np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


class Units:
    """The tokens of units by either side; forgets all it knows once that is too much."""

    def __init__(self, sides: Sides) -> None:
        self.sides = sides
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.a, self.b, self.sound = _Ragged(), _Ragged(), np.zeros(0, bool)

    def codes(self, units: Sequence[Sequence[str]]) -> list[np.ndarray]:
        """A number for each unit, by which ``a``, ``b`` and ``sound`` have it until the next call."""
        if len(self.code) > KNOWN_UNITS:
            self.clear()
        code = self.code
        new = list(dict.fromkeys(u for row in units for u in row if u not in code))
        if new:
            whole = [u for u in new if not (u[:1].isspace() or u[-1:].isspace() or not u)]
            odd = [u for u in new if u[:1].isspace() or u[-1:].isspace() or not u]
            for lot in _lots(whole):
                self._learn(lot, joined=True)
            for at in range(0, len(odd), 1024):
                self._learn(odd[at : at + 1024], joined=False)
        return [np.fromiter(map(code.__getitem__, row), np.int64, len(row)) for row in units]

    def _learn(self, units: list[str], joined: bool) -> None:
        """Encode units: as one text, cut at their ends, or each on its own."""
        want = [b" " + u.encode() for u in units]
        found = []
        for encode, table, length in ((self.sides.encode_a, self.sides.bytes_a, self.sides.length_a), (self.sides.encode_b, self.sides.bytes_b, self.sides.length_b)):
            if joined:
                (ids,) = encode([" ".join(units)])
                if b"".join(map(table.__getitem__, ids)) != b"".join(want):
                    return self._learn(units, joined=False)
                ids = np.array(ids, np.int64)
                stops = np.searchsorted(np.cumsum(length[ids]), np.cumsum([len(w) for w in want])) + 1
                found.append((ids, np.diff(stops, prepend=0), np.ones(len(units), bool)))
            else:
                rows = encode(units)
                sound = np.array([b"".join(map(table.__getitem__, r)) == w for r, w in zip(rows, want)], bool)
                found.append((np.array([i for r in rows for i in r], np.int64), np.array([len(r) for r in rows], np.int64), sound))
        for side, (ids, n, _) in zip((self.a, self.b), found):
            side.extend(ids, n)
        self.sound = np.concatenate([self.sound, found[0][2] & found[1][2]])
        self.code.update(zip(units, range(len(self.code), len(self.code) + len(units))))


def _lots(units: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for u in units:
        held.append(u)
        size += len(u) + 1
        if size >= JOINED_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def pieces(text: str) -> Iterator[str]:
    """A text in pieces that end where a unit does; the blank between two goes with neither, as each gets one before it."""
    at = 0
    while len(text) - at > PIECE_CHARS and (end := _UNIT_END.search(text, at + PIECE_CHARS)):
        yield text[at : end.start()]
        at = end.end()
    yield text[at:] if at else text


def links(start_a: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens (their numbers on either side) whose bytes overlap, where both sides cover the same bytes."""
    a = pd.DataFrame({"start": start_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"start": start_b, "b": np.arange(len(start_b))})
    by_a = pd.merge_asof(a, b, on="start")
    by_b = pd.merge_asof(b, a, on="start")
    other = start_a[by_b["a"].to_numpy()] != start_b  # equal starts are in both directions
    return np.concatenate([by_a["a"].to_numpy(), by_b["a"].to_numpy()[other]]), np.concatenate([by_a["b"].to_numpy(), by_b["b"].to_numpy()[other]])


@dataclass
class Aligned:
    """What is known of a document; a long one is aligned in several pieces."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    sound: bool = True
    digest: hashlib._Hash = field(default_factory=hashlib.sha256)
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs and how often each is linked here."""
        if len(self.pairs) == 1:
            return self.pairs[0]
        keys, at = np.unique(np.concatenate([k for k, _ in self.pairs]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in self.pairs]), len(keys)).astype(np.int64)


class Aligner:
    """Aligns texts; one to a worker."""

    def __init__(self, folder: str) -> None:
        self.sides = Sides(folder)
        self.units = Units(self.sides)
        named = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.names = {end: named(n, end) for n, ends in ((len(self.sides.bytes_a), ",|"), (len(self.sides.bytes_b), ";")) for end in ends}
        self.b_comma = self.names[","][: len(self.sides.bytes_b)]

    def align(self, texts: Sequence[str | None]) -> list[Aligned | None]:
        """One result per text, None where there are no tokens."""
        out: list[Aligned | None] = [Aligned() if t else None for t in texts]
        held, size = [], 0
        for k, text in enumerate(texts):
            for piece in pieces(text) if text else ():
                held.append((out[k], _UNIT_END.split(piece)))
                size += len(piece)
                if size >= SLICE_CHARS:
                    self._slice(held)
                    held, size = [], 0
        self._slice(held)
        return [d if d is not None and d.sound else None for d in out]

    def _slice(self, held: list[tuple[Aligned, list[str]]]) -> None:
        codes = self.units.codes([units for _, units in held])
        good = []
        for (doc, _), code in zip(held, codes):
            doc.sound = doc.sound and bool(self.units.sound[code].all())
            if doc.sound:
                good.append((doc, code))
        if not good:
            return
        every = np.concatenate([code for _, code in good])
        unit_owner = np.repeat(np.arange(len(good)), [len(code) for _, code in good])
        (ids_a, per_a), (ids_b, per_b) = self.units.a.take(every), self.units.b.take(every)
        owner_a, owner_b = np.repeat(unit_owner, per_a), np.repeat(unit_owner, per_b)
        end_a, end_b = np.cumsum(self.sides.length_a[ids_a]), np.cumsum(self.sides.length_b[ids_b])
        link_a, link_b = links(end_a - self.sides.length_a[ids_a], end_b - self.sides.length_b[ids_b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        text = self._written(ids_a, ids_b, group_a, group_b)
        n = len(good)
        n_a, n_b = np.bincount(owner_a, minlength=n), np.bincount(owner_b, minlength=n)
        n_links = np.bincount(owner_a[link_a], minlength=n)
        n_groups = np.bincount(owner_a[np.searchsorted(end_a, common)], minlength=n)
        key = ids_a[link_a].astype(np.int64) * len(self.sides.bytes_b) + ids_b[link_b]
        both, times = np.unique(owner_a[link_a] << 40 | key, return_counts=True)
        bounds = np.searchsorted(both, np.arange(n + 1) << 40)
        both &= (1 << 40) - 1
        upto = np.concatenate([[0], np.cumsum(n_a + n_b)])
        for k, (doc, _) in enumerate(good):
            said = "".join(text[upto[k] : upto[k + 1]].tolist())[:-1]
            doc.digest.update(((";" if doc.n_a else "") + said).encode())
            doc.n_a, doc.n_b = doc.n_a + int(n_a[k]), doc.n_b + int(n_b[k])
            doc.n_groups, doc.n_links = doc.n_groups + int(n_groups[k]), doc.n_links + int(n_links[k])
            doc.pairs.append((both[bounds[k] : bounds[k + 1]], times[bounds[k] : bounds[k + 1]]))

    def _written(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> np.ndarray:
        """The ids in decimal with what follows each: first a group's of one side, then those of the other."""
        in_a, in_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
        out = np.empty(len(ids_a) + len(ids_b), object)
        at_a = np.arange(len(ids_a)) + np.concatenate([[0], in_b])[group_a]
        at_b = np.arange(len(ids_b)) + in_a[group_b]
        out[at_a], out[at_b] = self.names[","][ids_a], self.b_comma[ids_b]
        out[at_a[in_a - 1]], out[at_b[in_b - 1]] = self.names["|"][ids_a[in_a - 1]], self.names[";"][ids_b[in_b - 1]]
        return out


@lru_cache(2)
def aligner(folder: str) -> Aligner:
    return Aligner(folder)


def align(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` the id, n_a, n_b, n_groups, n_links, groups_sha256, and its linked pairs (first id * size of the second vocabulary + second id) with how often each is linked.

    Texts that are null, empty or that either side doesn't give back byte for byte have no tokens: zeros, an empty text for
    the digest, no pairs. Whole texts are aligned, long ones piece by piece; repeated rows give equal results, an empty table
    an empty one. Other columns are left out, whatever they are called.
    """
    fields = docs.select(F.col(f"`{id_col}`").alias("doc_id")).schema
    for name, kind in (("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string")):
        fields = fields.add(name, kind)
    fields = fields.add("pairs", ArrayType(LongType())).add("times", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                found = own.align(part.column(1).to_pylist())
                counted = [d.counted() if d else (np.zeros(0, np.int64),) * 2 for d in found]
                bounds = pa.array(np.concatenate([[0], np.cumsum([len(k) for k, _ in counted])]), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([c[i] for c in counted]), pa.int64())) for i in (0, 1)]
                numbers = [pa.array([getattr(d, name) if d else 0 for d in found], pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links")]
                digests = pa.array([d.digest.hexdigest() if d else "" for d in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *numbers, digests, *lists], names=fields.names)

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, fields)


def pair_counts(aligned: DataFrame, second_size: int) -> DataFrame:
    """(pair, count, best) of all linked pairs: how many links of the corpus are of the pair, and whether no pair of its second id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = each.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("second", F.col("pair") % second_size)
    most = counts.groupBy("second").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "second").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))  # one row per id of a vocabulary


def with_pair_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` (written; with a column row of its own for each row) with n_best and count_sum in place of its pairs.

    The most frequent pairs, by powers of two of their counts and up to ``BROADCAST_PAIRS`` of them, are broadcast: no pair
    that many documents hold is shuffled. Any others are joined by a shuffle, where none can be hot.
    """
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    band = F.floor(F.log2("count")).cast("int")
    bands = sorted(counts.groupBy(band.alias("band")).count().collect(), key=lambda r: -r["band"])  # at most 63 rows
    least, n = 0, 0
    for row in bands:
        n += row["count"]
        if n > BROADCAST_PAIRS:
            least = row["band"] + 1
            break
    met = each.join(F.broadcast(counts.filter(band >= least)), "pair", "left" if least else "inner")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    found = met.filter("count is not null").groupBy("row").agg(*sums)
    if least:
        rare = met.filter("count is null").select("row", "pair", "times").join(counts.filter(band < least), "pair")
        found = found.unionByName(rare.groupBy("row").agg(*sums)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pairs", "times").join(found, "row", "left").fillna(0, ["n_best", "count_sum"]).drop("row")


def align_corpus(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``align`` with, in place of the pairs, n_best (links whose pair is the most frequent one of its second id in the corpus, ties included) and count_sum (the pairs' counts over all links)."""
    stored = cut(align(docs, folder, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    second = Sides(folder).piece_bpe.get_piece_size()
    return with_pair_counts(stored, cut(pair_counts(stored, second), "pair-counts"))

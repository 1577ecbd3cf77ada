"""Toxicity by compression distance: two Zstandard dictionaries, one trained on toxic and one on ordinary text.

A text is cut into windows of a few words. Each window is compressed with either dictionary; what the toxic one saves
over the ordinary one is the window's distance. A document is judged by the histogram of its distances, that is by how
many windows save how much, whose weights and threshold are calibrated on labelled documents that no dictionary has seen.

A dictionary's samples are the fragments of words that its class has far oftener than the other. Occurrences count once
for each pair of neighbouring words, so that copies and near copies of one document don't make its words a mark.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fresh

WINDOW_WORDS, LONGEST_WORD = 4, 64  # longer words are cut into pieces of this many bytes
DICTIONARY_BYTES = 4096  # of trained content, and of frequent fragments
GRAM, OFTENER, SIGMAS = 5, 4.0, 4.0
HAND, COVER_K, COVER_D = 16, 64, 6  # fragments a sample; the trainer's segment and match lengths
MOST_DOCS, MOST_BYTES = 3072, 16 << 10  # of either label, for training; each of at most so many bytes
CHUNK_BYTES, SLICE_ROWS = 2 << 20, 256  # texts are taken out of Arrow a slice at a time
LEAST, MOST = -8, 16  # distances beyond count as these
STEPS = (1, 2, 3, 4, 6, 8)

#: The white space of the other operators as blanks, A-Z as a-z.
_FOLD = bytes.maketrans(UPPER.encode() + b"\t\n\v\f\r", LOWER.encode() + b" " * 5)


@dataclass(frozen=True)
class ToxicityModel:
    """Either dictionary, and the calibrated weights of ``features`` (the last is the constant)."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def folded(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased, white space as blanks and a blank at either end."""
    return b" " + (text or "").encode("utf-8", "replace").translate(_FOLD) + b" "


def window_bounds(data: bytes) -> np.ndarray:
    """Offsets and lengths of the windows of a folded text: so many words, with the blanks around them."""
    raw = np.frombuffer(data, np.uint8)
    blank = raw == 32
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    if len(starts) == 0:
        return np.zeros((0, 2), "<u8")
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    if (ends - starts).max() > LONGEST_WORD:
        pieces = (ends - starts + LONGEST_WORD - 1) // LONGEST_WORD
        first = np.cumsum(pieces) - pieces
        starts = np.repeat(starts, pieces) + LONGEST_WORD * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    begins = starts[::WINDOW_WORDS] - 1
    stops = np.append(begins[1:] + 1, len(data))
    return np.stack([begins, stops - begins], axis=1).astype("<u8")


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    """Matches of 4 bytes and more, and small tables: a window is tens of bytes long. The format indexes no dictionary's last 8 bytes."""
    shared = zstandard.ZstdCompressionDict(data + b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(
        window_log=14, hash_log=12, chain_log=13, search_log=5, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_dict_id=False
    )
    shared.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=shared, compression_params=how)


def _lengths(press: zstandard.ZstdCompressor, data: bytes, bounds: np.ndarray) -> np.ndarray:
    pressed = press.multi_compress_to_buffer(zstandard.BufferWithSegments(data, bounds.tobytes()), threads=1)
    return np.fromiter(map(len, pressed), np.int32, len(bounds))


class Distances:
    """Histograms of window distances. Holds the compressors of one task."""

    def __init__(self, model_toxic: bytes, model_ordinary: bytes) -> None:
        self.toxic, self.ordinary = _compressor(model_toxic), _compressor(model_ordinary)

    def histograms(self, texts: list[str | None]) -> np.ndarray:
        """One row per text: how many of its windows have each distance. Works on bounded pieces, however long the texts."""
        out = np.zeros((len(texts), MOST - LEAST + 1), np.int64)
        held: list[tuple[int, bytes, np.ndarray]] = []
        size = 0
        for k, text in enumerate(texts):
            data = folded(text)
            bounds = window_bounds(data)
            per = max(1, CHUNK_BYTES // (8 * WINDOW_WORDS))
            for at in range(0, len(bounds), per):
                part = bounds[at : at + per].copy()
                begin, end = int(part[0, 0]), int(part[-1, 0] + part[-1, 1])
                part[:, 0] -= part[0, 0]
                held.append((k, data[begin:end], part))
                size += end - begin
                if size >= CHUNK_BYTES:
                    self._add(out, held)
                    held, size = [], 0
        self._add(out, held)
        return out

    def _add(self, out: np.ndarray, held: list[tuple[int, bytes, np.ndarray]]) -> None:
        if not held:
            return
        base = np.cumsum([0] + [len(d) for _, d, _ in held])
        data = b"".join(d for _, d, _ in held)
        bounds = np.concatenate([b for _, _, b in held])
        owner = np.repeat([k for k, _, _ in held], [len(b) for _, _, b in held])
        bounds[:, 0] += np.repeat(base[:-1], [len(b) for _, _, b in held]).astype("<u8")
        saved = np.clip(_lengths(self.ordinary, data, bounds) - _lengths(self.toxic, data, bounds), LEAST, MOST) - LEAST
        np.add.at(out, (owner, saved), 1)


def features(counts: np.ndarray) -> np.ndarray:
    """From histograms of distances: the largest, the mean, the mean of the largest three, and how many and which share reach each step."""
    n = counts.sum(axis=1)
    some = np.maximum(n, 1)
    values = np.arange(LEAST, MOST + 1)
    beyond = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # windows of each distance or more
    top = [np.where(n > 0, values[np.argmax(np.where(counts > 0, values, LEAST), axis=1)], 0)]
    best = np.minimum(beyond, 3)
    three = np.where(n > 0, (best * 1).sum(axis=1) / np.minimum(some, 3) + LEAST - 1, 0)
    columns = [*top, three, counts @ values / some, np.log1p(n)]
    for step in STEPS:
        reach = beyond[:, step - LEAST]
        columns += [np.log1p(reach), reach / some, np.minimum(reach, 1)]
    return np.stack(columns, axis=1).astype(float)


def _neighbourhoods(texts: Iterable[str]) -> Counter[str]:
    """How many different pairs of neighbours each word has."""
    seen = set()
    for text in texts:
        words = ["", *folded(text).decode("utf-8", "replace").split(), ""]
        seen.update(zip(words, words[1:], words[2:]))
    return Counter(word for _, word, _ in seen)


def _grams(word: str) -> set[bytes]:
    data = f" {word[:LONGEST_WORD]} ".encode()
    return {data[i : i + GRAM] for i in range(max(1, len(data) - GRAM + 1))}


def marks(own: Counter[str], other: Counter[str]) -> set[bytes]:
    """Byte sequences that words of one class have far oftener, by ratio and by the standard error of the difference."""
    n_own, n_other = sum(own.values()), sum(other.values())
    if not n_own or not n_other:
        return set()
    mine, theirs = Counter(), Counter()
    for words, into in ((own, mine), (other, theirs)):
        for word, n in words.items():
            for gram in _grams(word):
                into[gram] += n
    found = set()
    for gram, a in mine.items():
        b = theirs[gram]
        p = (a + b) / (n_own + n_other)
        error = math.sqrt(p * (1 - p) * (1 / n_own + 1 / n_other))
        if a / n_own - b / n_other > SIGMAS * error and (a + 0.5) / n_own > OFTENER * (b + 0.5) / n_other:
            found.add(gram)
    return found


def fragments(words: Counter[str], marked: set[bytes]) -> Iterator[bytes]:
    """The marked stretches of words, as often as the words have different neighbours."""
    for word, n in sorted(words.items()):
        data = f" {word[:LONGEST_WORD]} ".encode()
        begin, end = None, 0
        for i in [*(i for i in range(max(1, len(data) - GRAM + 1)) if data[i : i + GRAM] in marked), None]:
            if begin is not None and (i is None or i > end):
                yield from [data[begin:end]] * n
                begin = None
            if i is not None:
                begin, end = (i if begin is None else begin), i + GRAM


def trained_dictionary(samples: list[bytes]) -> bytes:
    """The content of a dictionary: the most frequent fragments, and what Zstandard's trainer makes of all of them.

    The trainer looks for pieces of samples of some length, so that each sample is a handful of fragments, dealt evenly.
    It keeps one of several words with a common beginning; the fragments before it hold the others. The result serves as
    plain content, as the trainer's tables of symbol frequencies would tell languages apart, not classes.
    """
    frequent = b"".join(s for s, _ in reversed(Counter(samples).most_common(DICTIONARY_BYTES // 8)))[-DICTIONARY_BYTES:]
    hands = max(1, len(samples) // HAND)
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, [b"".join(samples[i::hands]) for i in range(hands)], k=COVER_K, d=COVER_D).as_bytes()
    except zstandard.ZstdError:  # too few samples
        trained = b""
    return trained + frequent


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic weights by Newton's method with a ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + np.eye(len(w)), z.T @ (y - p) - w)
    return mean, scale, w


def fitted(texts: list[str], toxic: list[int], share: float | None = None) -> ToxicityModel:
    """A model of labelled texts: of either label two in three train the dictionaries, the rest calibrate.

    ``share`` is that of toxic documents among all labelled ones, where the texts hold another; scores are then moved to
    it. Without two texts of both labels all documents get the share as their score (nothing at all: 0.5).
    """
    y = np.array(toxic, float)
    if share is None:
        share = (y.sum() + 0.5) / (len(y) + 1)
    part = np.ones(len(y), bool)
    for label in (0, 1):
        part[np.flatnonzero(y == label)[2::3]] = False
    width = features(np.zeros((1, MOST - LEAST + 1), np.int64)).shape[1]
    if any(len(set(y[p])) < 2 for p in (part, ~part)):
        return ToxicityModel(b"", b"", np.zeros(width), np.ones(width), np.append(np.zeros(width), math.log(share / (1 - share))))
    bad, good = (_neighbourhoods(t for t, v, p in zip(texts, y, part) if p and v == label) for label in (1, 0))
    pressed = [trained_dictionary(list(fragments(own, marks(own, other)))) for own, other in ((bad, good), (good, bad))]
    held = Distances(*pressed).histograms([t for t, p in zip(texts, part) if not p])
    mean, scale, weights = _calibrated(features(held), y[~part])
    sampled = y[~part].mean()
    weights[-1] += math.log(share / (1 - share)) - math.log(sampled / (1 - sampled))
    return ToxicityModel(*pressed, mean, scale, weights)


def training_sample(docs: DataFrame, labels: DataFrame, learns: Column) -> tuple[list[tuple[str, int]], float]:
    """Up to ``MOST_DOCS`` texts of either label, of at most ``MOST_BYTES`` bytes, by a hash of their ids, and the share of toxic documents.

    Only ids are chosen from the labels, so that the documents are read once and never shuffled; the share counts all
    labels. A document of several labels counts as toxic if one says so; null ids, texts and labels take no part.
    """
    own = labels.filter(learns & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    n, bad = own.agg(F.count(F.lit(1)), F.count_if("toxic")).first()
    order = F.xxhash64(F.col("doc_id").cast("string"))
    ids = own.filter("toxic").orderBy(order, "doc_id").limit(2 * MOST_DOCS).unionByName(own.filter("not toxic").orderBy(order, "doc_id").limit(2 * MOST_DOCS))
    texts = docs.filter(F.octet_length("text") <= MOST_BYTES).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = [r for label in ("toxic", "not toxic") for r in texts.filter(label).orderBy(order, "doc_id", F.xxhash64("text")).limit(MOST_DOCS).collect()]
    return [(r["text"], int(r["toxic"])) for r in rows], (bad + 0.5) / (n + 1)


def train(docs: DataFrame, labels: DataFrame, learns: Column) -> ToxicityModel:
    """The model of the labelled documents that ``learns`` (a condition on labels) lets in."""
    rows, share = training_sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), learns)
    return fitted([t for t, _ in rows], [v for _, v in rows], share)


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All rows and columns of ``docs`` with toxic_score (0 to 1) and toxic_windows, the windows that the toxic dictionary shortens by 2 bytes or more.

    Whole texts are scored, window by window, in pieces of bounded size. Null, empty and blank texts have no windows and
    get the model's score for that; repeated rows get equal scores, an empty table gives an empty one. Columns of these
    names are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("toxic_score", "toxic_windows")]
    (text,) = fresh(kept, "toxic_text")
    schema = docs.select(*kept).schema.add("toxic_score", "double").add("toxic_windows", "long")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model.toxic, model.ordinary)
        for batch in batches:
            texts = batch.column(len(kept))
            parts = [distances.histograms(texts.slice(at, SLICE_ROWS).to_pylist()) for at in range(0, batch.num_rows, SLICE_ROWS)]
            counts = np.concatenate(parts) if parts else np.zeros((0, MOST - LEAST + 1), np.int64)
            logit = np.clip((features(counts) - model.mean) / model.scale @ model.weights[:-1] + model.weights[-1], -30, 30)
            said = [pa.array(1 / (1 + np.exp(-logit))), pa.array(counts[:, 2 - LEAST :].sum(axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *said], names=[*kept, "toxic_score", "toxic_windows"])

    return docs.select(*kept, F.col("text").alias(text)).mapInArrow(score, schema)

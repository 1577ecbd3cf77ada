"""Quality classifier from weak labels.

Overlapping heuristic labellers (one by abusive words, which are counted from the labels), and hand-made labels where
there are any, vote on whether a document should go, or have no opinion. How often each is right is estimated by expectation-maximisation over the counts of vote patterns, which cover
all documents and are few. The posteriors of a bounded sample then train a linear scorer over hashed
words and bucketed measures, and the scorer decides on every document, with or without votes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

SAMPLE_DOCS, SAMPLE_FEATURES = 8192, 1 << 23  # most documents, and their features, that the scorer is fitted on
DIMENSIONS = 1 << 20
LEAST_DOCS = 4  # a hashed feature counts if so many sampled documents have it
THRESHOLD = 0.5
CACHED_WORDS = 1 << 16  # of a task, some 10 MB
TEXTS_AT_ONCE = 256  # whose distinct words a task holds

BLOCK = 1000  # words within which distinct ones are counted

#: Abusive words: in so many toxic documents, and such a share of them, and so often in toxic ones among all labelled documents.
TOXIC_DOCS, TOXIC_SHARE, TOXIC_PRECISION = 4, 0.05, 0.9
BROADCAST_ROWS = 1_000_000
PLAIN = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum() or chr(c).isspace())
TRIM = bytes(c for c in range(33, 127) if not chr(c).isalnum())
LABELLERS = ("symbols", "shouting", "stutter", "variety", "lines", "insults", "plain", "label")


def measures(data: bytes, words: list[bytes]) -> dict[str, float]:
    """Shares: of symbols in the text, shouted words, words that repeat the one before, distinct words, repeated lines.

    Distinct words are those of each block of 1000 words, over all blocks, so that long texts are not less varied by their length.
    """
    n, lines = max(1, len(words)), data.split(b"\n")
    return {
        "symbols": len(data.translate(None, PLAIN)) / max(1, len(data)),
        "shouting": sum(map(bytes.isupper, words)) / n,
        "stutter": sum(map(eq, words, words[1:])) / n,
        "variety": sum(len(set(words[i : i + BLOCK])) for i in range(0, len(words), BLOCK)) / n,
        "lines": 1 - len(set(lines)) / len(lines),
    }


def votes(m: dict[str, float], insults: int) -> str:
    """One sign per heuristic labeller: 1 for bad, 0 for good, - for no opinion. All but plain have an opinion on bad signs only."""
    bad = (m["symbols"] > 0.08, m["shouting"] > 0.2, m["stutter"] > 0.1, m["variety"] < 0.2, m["lines"] > 0.25, insults > 0)
    plain = m["symbols"] < 0.06 and m["shouting"] < 0.1 and m["stutter"] < 0.05 and m["variety"] > 0.3 and m["lines"] < 0.2 and not insults
    return "".join("1" if x else "-" for x in bad) + ("0" if plain else "-")


class _Features(dict):
    """A word's hashed feature; words are trimmed of symbols and lower-cased."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = zlib.crc32(word.lower().strip(TRIM)) % DIMENSIONS
        return value


def _plain(words: set[bytes]) -> set[bytes]:
    return {w.lower().strip(TRIM) for w in words if len(w) < 24} - {b""}


def vote(data: bytes, words: list[bytes], m: dict[str, float], abusive: frozenset[bytes] = frozenset()) -> str:
    """The heuristics' votes on a text of these words and measures; ``abusive`` words count as insults."""
    low = data.lower()
    return votes(m, len(abusive & _plain(set(words))) if any(x in low for x in abusive) else 0)


def feature_ids(words: list[bytes], m: dict[str, float], cache: _Features) -> np.ndarray:
    """Distinct hashed features: the words, the measures in steps, and the length."""
    ids = set(map(cache.__getitem__, set(words)))
    ids.update(zlib.crc32(f"\0{k}={min(20, int(v * 20))}".encode()) % DIMENSIONS for k, v in m.items())
    ids.add(zlib.crc32(f"\0words={len(words).bit_length()}".encode()) % DIMENSIONS)
    return np.fromiter(ids, np.int32, len(ids))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def abusive_words(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> frozenset[bytes]:
    """Words that toxic documents have in common and others lack, by counts over all labelled documents; none without such labels."""
    marked = cut(labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.max("toxic").alias("toxic")), "quality-toxic")
    toxic = marked.filter("toxic = 1").select("l_id")
    few = F.broadcast(toxic) if toxic.count() <= BROADCAST_ROWS else toxic
    texts = docs.select(F.col(f"`{id_col}`").alias("q_id"), F.col(f"`{text_col}`").alias("q_text"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                yield pd.DataFrame({"words": [[b"", *_plain(set(_bytes(t).split()))] for t in batch["q_text"].iloc[at : at + TEXTS_AT_ONCE]]})  # b"" counts documents

    found = texts.join(few, F.col("q_id") == F.col("l_id"), "left_semi").mapInPandas(spread, "words array<binary>")
    counts = cut(found.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= TOXIC_DOCS), "quality-words")
    total = counts.filter(F.length("word") == 0).agg(F.max("n")).first()[0]
    if not total:
        return frozenset()
    often = {bytes(r["word"]): r["n"] for r in counts.filter((F.length("word") > 0) & (F.col("n") >= TOXIC_SHARE * total)).collect()}
    names = sorted(often)
    place = {w: k for k, w in enumerate(names)}

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"q_id": batch["q_id"], "at": [sorted(place[w] for w in place.keys() & _plain(set(_bytes(t).split()))) for t in batch["q_text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    others = texts.mapInPandas(hits, f"q_id {kind}, at array<int>").join(marked.filter("toxic <> 1"), F.col("q_id") == F.col("l_id"), "left_semi")
    elsewhere = {r["k"]: r["n"] for r in others.select(F.explode("at").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    return frozenset(w for k, w in enumerate(names) if often[w] >= TOXIC_PRECISION * (often[w] + elsewhere.get(k, 0)))


def heuristic_votes(docs: DataFrame, id_col: str, text_col: str, abusive: frozenset[bytes] = frozenset()) -> DataFrame:
    """(id, votes) per row."""

    def one(data: bytes) -> str:
        words = data.split()
        return vote(data, words, measures(data, words), abusive)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"q_id": batch["q_id"], "votes": [one(_bytes(t)) for t in batch["q_text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("q_id"), F.col(f"`{text_col}`").alias("q_text")).mapInPandas(run, f"q_id {kind}, votes string")


def label_votes(labels: DataFrame, id_col: str) -> DataFrame:
    """(l_id, label): 1 if a label calls the document bad or toxic, else 0; one row per id."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.max(bad).alias("label"))


@dataclass
class Accuracies:
    """prior: of a bad document; right: how often each labeller's opinions are right."""

    prior: float
    right: np.ndarray

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """The probability that a document of each pattern is bad."""
        if not patterns:
            return np.zeros(0)
        signs = np.array([[{"1": 1, "0": -1, "-": 0}[v] for v in p] for p in patterns])
        return 1 / (1 + np.exp(-(np.log(self.prior / (1 - self.prior)) + signs @ np.log(self.right / (1 - self.right)))))


def estimate(patterns: list[str], counts: np.ndarray, rounds: int = 100) -> Accuracies:
    """Expectation-maximisation over pattern counts, from labellers that are right four times in five, labels more often.

    Accuracies come from documents on which two labellers or more have opinions: alone, an opinion can't be checked.
    """
    right = np.full(len(LABELLERS), 0.8)
    right[-1] = 0.95
    model = Accuracies(0.2, right)
    signs = np.array([[{"1": 1, "0": -1, "-": 0}[v] for v in p] for p in patterns]).reshape(len(patterns), len(LABELLERS))
    shared = ((signs != 0) & ((signs != 0).sum(axis=1, keepdims=True) > 1)) * counts[:, None]
    for _ in range(rounds if patterns else 0):
        bad = model.posterior(patterns)
        hits = (np.where(signs == 1, bad[:, None], 1 - bad[:, None]) * shared).sum(axis=0)
        given = shared.sum(axis=0)
        model = Accuracies(float(np.clip((bad * counts).sum() / counts.sum(), 0.01, 0.6)), np.clip((hits + 4) / (given + 5), 0.55, 0.995))
    return model


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[ids].sum(dtype=np.float64) + self.bias, -30, 30))))


def fit_scorer(rows: list[np.ndarray], targets: np.ndarray, rounds: int = 60, rate: float = 0.3, decay: float = 3e-4) -> Scorer:
    """Logistic regression on soft targets by adaptive full-batch gradient steps."""
    weights = np.zeros(DIMENSIONS, np.float32)
    if not rows:
        return Scorer(weights, 0.0)
    ids, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen = np.bincount(ids, minlength=DIMENSIONS)
    used = np.flatnonzero(seen >= min(LEAST_DOCS, len(rows)))
    place = np.full(DIMENSIONS, -1)
    place[used] = np.arange(len(used))
    ids = place[ids]
    ids, owner = ids[ids >= 0], owner[ids >= 0]
    w, square, bias, bias_square = np.zeros(len(used)), np.full(len(used), 1e-8), 0.0, 1e-8
    for _ in range(rounds):
        wrong = targets - 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[ids], len(rows)) + bias, -30, 30)))
        g = np.bincount(ids, wrong[owner], len(used)) / len(rows) - decay * w
        square += g**2
        w += rate * g / np.sqrt(square)
        bias_square += wrong.mean() ** 2
        bias += rate * wrong.mean() / np.sqrt(bias_square)
    weights[used] = w
    return Scorer(weights, bias)


def sampled(docs: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` rows, somewhat more, with q_hash: those with the smallest hashes of ``key``."""
    share = min(1.0, 1.1 * most / max(1, docs.count()))
    return docs.withColumn("q_hash", F.pmod(key, F.lit(1 << 40))).filter(F.col("q_hash") <= int(share * (1 << 40)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_features: int = SAMPLE_FEATURES) -> tuple[Accuracies, Scorer, DataFrame]:
    """The labellers' accuracies over all documents, the scorer, and (q_id, pattern) per row.

    The scorer is fitted on the documents of the smallest hashes, at most ``sample_docs`` with ``sample_features`` features
    altogether; features are computed where the texts are, and only they meet. Null and empty texts count like others;
    repeated rows have one hash and come in, or stay out, together; labels of unknown or null ids have no effect, of several
    for one id the worse counts. Empty tables give a scorer that keeps all.
    """
    abusive = abusive_words(docs, labels, id_col, text_col)
    found = heuristic_votes(docs, id_col, text_col, abusive)
    marked = label_votes(labels, id_col)
    pattern = F.concat("votes", F.coalesce(F.col("label").cast("string"), F.lit("-"))).alias("pattern")
    voted = cut(found.join(marked, found["q_id"] == marked["l_id"], "left").select("q_id", pattern), "quality-votes")
    counts = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    model = estimate([r["pattern"] for r in counts], np.array([r["n"] for r in counts], float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Features()
        for batch in batches:
            made = []
            for data in map(_bytes, batch["q_text"]):
                words = data.split()
                m = measures(data, words)
                made.append((vote(data, words, m, abusive), feature_ids(words, m, cache)))
            yield pd.DataFrame({"q_id": batch["q_id"], "q_hash": batch["q_hash"], "votes": [m[0] for m in made], "ids": [m[1] for m in made]})

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = sampled(docs.select(F.col(f"`{id_col}`").alias("q_id"), F.col(f"`{text_col}`").alias("q_text")), F.xxhash64("q_id", "q_text"), sample_docs)
    rows = cut(chosen.mapInPandas(run, f"q_id {kind}, q_hash long, votes string, ids array<int>"), "quality-sample")
    sizes = rows.select("q_hash", F.size("ids").alias("n")).orderBy("q_hash", "n").toArrow()
    fits = np.flatnonzero((np.arange(1, sizes.num_rows + 1) <= sample_docs) & (np.cumsum(sizes["n"].to_numpy()) <= sample_features))
    edge = sizes["q_hash"].to_numpy()[fits[-1]] if len(fits) else -1
    few = rows.filter(F.col("q_hash") <= int(edge))
    table = few.join(marked, few["q_id"] == marked["l_id"], "left").select("q_hash", "q_id", pattern, "ids").toArrow().to_pandas().sort_values(["q_hash", "q_id", "pattern"], kind="stable")
    return model, fit_scorer([np.asarray(x, np.int64) for x in table["ids"]], model.posterior(table["pattern"].tolist())), voted


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """``docs`` with bad_score, from 0 to 1. Null counts as empty; rows stay; a column named bad_score is replaced."""
    fields = [f for f in docs.schema.fields if f.name != "bad_score"]
    used = np.flatnonzero(scorer.weights)
    values, bias = scorer.weights[used], scorer.bias

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = np.zeros(DIMENSIONS, np.float32)
        weights[used] = values
        own, cache = Scorer(weights, bias), _Features()

        def one(data: bytes) -> float:  # words of one text at a time: those of a whole batch are ten times its size
            words = data.split()
            return own.score(feature_ids(words, measures(data, words), cache))

        for batch in batches:
            yield batch.assign(bad_score=[one(_bytes(t)) for t in batch[text_col]])

    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInPandas(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["bad_score double"]))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns. Labels may be empty or hold unknown ids."""
    _, scorer, _ = train(docs, labels, id_col, text_col)
    (name,) = fresh(docs.columns, "bad_score")
    if name == "bad_score":
        return score(docs, scorer, text_col).filter(F.col("bad_score") < threshold).drop("bad_score")
    scored = score(docs.withColumnRenamed("bad_score", name), scorer, text_col)
    return scored.filter(F.col("bad_score") < threshold).drop("bad_score").withColumnRenamed(name, "bad_score")

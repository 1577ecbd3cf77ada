"""Hidden Markov language model: Baum-Welch over all training documents, exact scoring by the scaled forward recursion.

A state emits a class: one of the most frequent words (the end of a text among them), or for any other word the bucket of
its last bytes, in which the word has its add-one share. So P(text) is a sum over all state paths, times the shares of the
rarer words, and texts with unseen words have a probability too.

Word counts cover all training documents. At most ``KNOWN`` words go to the workers with their counts; the counts of all
others are joined in by a shuffle. Each round of Baum-Welch is one job: tasks add up expected counts over their documents,
sums by cell of the model are made by Spark, and the driver holds the model only, whose size is fixed.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KNOWN = 1 << 18  # words whose counts are broadcast, of at most WORD_BYTES each
WORD_BYTES = 64
FREQUENT = 8192  # words that are a class of their own
BUCKETS, SUFFIX = 1024, 3
STATES, ROUNDS = 8, 3
GAIN = 0.002  # Baum-Welch ends when a round gains less in log10 per token
SEED_DOCS = 2048  # documents whose clusters the emissions start from
POOL, LONG = 1 << 19, 2000  # tokens that are handled together; longer texts are pooled apart
BANDS = 16  # frequency bands to a doubling
COUNTED = 200_000  # distinct words that a task holds while counting
SCALE = float(1 << 20)  # expected counts are summed as whole multiples of 1 / SCALE, so that their order has no effect
END = b""


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n): words as bytes, the end of a text as an empty one."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["h_text"]:
                seen.update(words_of(text))
                seen[END] += 1
                if len(seen) >= COUNTED:
                    yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"word": list(seen.keys()), "n": np.array(list(seen.values()), np.int64)})

    return docs.select(F.col(text_col).alias("h_text")).mapInPandas(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % BUCKETS


@dataclass
class Vocabulary:
    """The words with their counts' logarithms and classes; classes of frequent words come before the buckets."""

    words: list[bytes]
    log_counts: np.ndarray
    classes: np.ndarray
    frequent: int
    tokens: int
    distinct: int
    shares: np.ndarray  # by bucket: log10 of the tokens and words that share it

    @property
    def size(self) -> int:
        return self.frequent + BUCKETS


def vocabulary(counts: DataFrame, known: int = KNOWN, frequent: int = FREQUENT) -> Vocabulary:
    """At most ``known`` words: the most frequent ones, down to the least band of frequencies that fits whole.

    Bands are counted first, so that no task gathers every partition's candidates.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    short = counts.filter(F.octet_length("word") <= WORD_BYTES).withColumn("band", F.floor(F.log2("n") * BANDS).cast("int"))
    bands = short.groupBy("band").agg(F.count(F.lit(1)).alias("v")).orderBy(F.desc("band")).collect()
    fits = [b["band"] for b, total_v in zip(bands, np.cumsum([b["v"] for b in bands]), strict=True) if total_v < known]
    edge = fits[-1] if fits else 1 << 30
    top = short.filter((F.col("band") >= edge) | (F.col("word") == F.lit(END))).select("word", "n").toArrow()
    found = dict(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True))
    words = [END, *sorted((w for w in found if w != END), key=lambda w: (-found[w], w))]
    n = np.array([found.get(w, 0) for w in words], np.int64)
    frequent = min(frequent, len(words))
    classes = np.array([*range(frequent), *(frequent + bucket(w) for w in words[frequent:])], np.uint16)
    suffix = F.when(F.octet_length("word") > SUFFIX, F.substring("word", -SUFFIX, SUFFIX)).otherwise(F.col("word"))
    sums = counts.groupBy((F.crc32(suffix) % BUCKETS).alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    held = np.zeros(BUCKETS)
    for r in sums:
        held[r["b"]] = r["n"] + r["v"]
    for w, c in zip(words[:frequent], n[:frequent].tolist(), strict=True):
        held[bucket(w)] -= c + 1
    return Vocabulary(words, np.log10(n + 1.0), classes, frequent, int(total["n"]), int(total["v"]), np.log10(np.maximum(held, 0) + 1))


def encode(docs: DataFrame, text_col: str, vocab: Vocabulary) -> DataFrame:
    """Rows with their texts as classes (two bytes each), sums over the known words, and the words that aren't known."""
    fields = [f for f in docs.schema.fields if f.name != text_col]
    words, log_counts, classes, frequent, shares = vocab.words, vocab.log_counts, vocab.classes, vocab.frequent, vocab.shares

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = dict(zip(words, range(len(words)), strict=True))
        for batch in batches:
            rows = []
            for text in batch[text_col]:
                tokens = [*words_of(text), END]
                at = np.fromiter(map(places.get, tokens, repeat(-1)), np.int64, len(tokens))
                other = np.flatnonzero(at < 0).tolist()
                rare = [tokens[i] for i in other]
                ids = classes[at]
                if other:
                    ids[other] = [frequent + bucket(w) for w in rare]
                inside = at[at >= 0]
                mid = inside[inside >= frequent]
                shared = ids[ids >= frequent].astype(np.int64) - frequent
                rows.append((len(tokens), len(inside) if log_counts[0] > 0 else int((log_counts[inside] > 0).sum()), float(log_counts[inside].sum()), float(log_counts[mid].sum() - shares[shared].sum()), ids.astype("<u2").tobytes(), rare))
            out = batch.drop(columns=text_col)
            yield out.assign(**{name: [r[k] for r in rows] for k, name in enumerate(("n_tokens", "n_seen", "seen_log", "share_log", "ids", "rare"))})

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_tokens long, n_seen long, seen_log double, share_log double, ids binary, rare array<binary>"])
    return docs.mapInPandas(encoded, kinds)


class Model:
    """start[state], moves[state, next], emits[class, state]."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> None:
        self.start, self.moves, self.emits = start, moves, emits

    @staticmethod
    def estimated(start: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> Model:
        """From expected counts. Emissions lean on all states' mean, in which every class has one count more."""
        mean = emits.sum(axis=1) + 1
        mean /= mean.sum()
        start, moves, emits = start + 1, moves + 1, emits + 50 * mean[:, None]
        return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


class Pool:
    """Texts laid out step by step, the longest first, so that one array operation advances all of them by a token."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        lengths = np.array([len(t) for t in texts])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        self.starts = np.concatenate(([0], np.cumsum(self.active)))
        step = np.concatenate([np.arange(n) for n in lengths])
        rank = np.repeat(np.arange(len(texts)), lengths)
        self.ids = np.empty(len(step), np.int64)
        at = self.starts[step] + rank
        self.ids[at] = np.concatenate([texts[k] for k in self.order])
        self.before = (self.starts[step - 1] + rank)[step > 0]
        self.after = at[step > 0]
        self.last = self.starts[lengths - 1] + np.arange(len(texts))

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Scaled state probabilities after each token, and the scales, whose product is the text's probability."""
        alpha, scale = model.emits[self.ids], np.empty(len(self.ids))
        now = np.broadcast_to(model.start, (len(self.order), len(model.start)))
        for t, n in enumerate(self.active):
            a = alpha[self.starts[t] : self.starts[t] + n]
            a *= now[:n] if t == 0 else now[:n] @ model.moves
            s = a.sum(axis=1)
            a /= s[:, None]
            scale[self.starts[t] : self.starts[t] + n] = s
            now = a
        return alpha, scale

    def log10(self, model: Model) -> np.ndarray:
        """Each text's log10 probability, in the order in which the texts were given."""
        _, scale = self.forward(model)
        rank = np.concatenate([np.arange(n) for n in self.active])
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(rank, np.log10(scale), len(self.order))
        return out

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts, moves and emissions, and the texts' log10 probability."""
        alpha, scale = self.forward(model)
        ahead = model.emits[self.ids] / scale[:, None]  # becomes emission times backward probability over scale
        beta = np.ones_like(alpha)
        for t in range(len(self.active) - 2, -1, -1):
            n, a, b = self.active[t + 1], self.starts[t], self.starts[t + 1]
            ahead[b : b + n] *= beta[b : b + n]
            beta[a : a + n] = ahead[b : b + n] @ model.moves.T
        moves = model.moves * (alpha[self.before].T @ ahead[self.after])
        gamma = alpha * beta
        emits = np.stack([np.bincount(self.ids, gamma[:, k], len(model.emits)) for k in range(gamma.shape[1])], axis=1)
        return gamma[: self.active[0]].sum(axis=0), moves, emits, float(np.log10(scale).sum())


def pools(rows: Iterator[tuple[object, np.ndarray]]) -> Iterator[tuple[list, Pool]]:
    """Rows' keys and pools of their texts; long texts wait for one another."""
    waiting: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}
    held = {False: 0, True: 0}
    for key, ids in rows:
        far = len(ids) > LONG
        keys, texts = waiting[far]
        keys.append(key)
        texts.append(ids)
        held[far] += len(ids)
        if held[far] >= POOL:
            yield keys, Pool(texts)
            waiting[far], held[far] = ([], []), 0
    for keys, texts in waiting.values():
        if keys:
            yield keys, Pool(texts)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, np.ndarray]]:
    for batch in batches:
        for key, ids in zip(batch["row_key"], batch["ids"], strict=True):
            yield key, np.frombuffer(ids, "<u2").astype(np.int64)


def first_model(training: DataFrame, vocab: Vocabulary, states: int, seed_docs: int = SEED_DOCS) -> Model:
    """A model whose states are clusters of at most ``seed_docs`` documents (those with the smallest hashes); Baum-Welch goes on from it."""
    share = min(1.0, 1.2 * seed_docs / max(1, training.count()))
    hashed = training.select("ids", F.pmod(F.xxhash64("ids"), F.lit(1 << 40)).alias("h")).filter(F.col("h") <= int(share * (1 << 40)))
    sample = hashed.orderBy("h").limit(seed_docs).toArrow()["ids"].to_pylist()
    texts = [np.frombuffer(x, "<u2") for x in sample]
    emits, rng = np.zeros((vocab.size, states)), np.random.default_rng(11)
    top = min(2000, vocab.size)
    if texts:
        shape = np.stack([np.sqrt(np.bincount(np.minimum(t, top), minlength=top + 1)[:top]) for t in texts]).astype(np.float32)
        shape /= np.maximum(np.linalg.norm(shape, axis=1, keepdims=True), 1e-9)
        centres = [shape[0]]
        for _ in range(states - 1):
            centres.append(shape[int((shape @ np.stack(centres).T).max(axis=1).argmin())])
        own = np.zeros(len(texts), int)
        for _ in range(10):
            own = (shape @ np.stack(centres).T).argmax(axis=1)
            centres = [shape[own == k].mean(axis=0) if (own == k).any() else rng.random(top, np.float32) for k in range(states)]
            centres = [c / max(np.linalg.norm(c), 1e-9) for c in centres]
        for t, k in zip(texts, own, strict=True):
            emits[:, k] += np.bincount(t, minlength=vocab.size)
    return Model.estimated(np.ones(states), np.eye(states) * 1000, emits)


def baum_welch(training: DataFrame, model: Model) -> tuple[Model, float]:
    """One round over all rows of ``training`` (row_key, ids): the new model, and the mean log10 per token by the old one."""
    states, size = len(model.start), len(model.emits)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, log10, tokens = np.zeros((1 + states + size, states)), 0.0, 0
        for _, pool in pools(_rows(batches)):
            start, moves, emits, likelihood = pool.expected(model)
            log10, tokens = log10 + likelihood, tokens + len(pool.ids)
            total[0] += start
            total[1 : 1 + states] += moves
            total[1 + states :] += emits
        cells = np.rint(np.append(total.ravel(), (log10, tokens)) * SCALE).astype(np.int64)
        there = np.flatnonzero(cells)
        yield pd.DataFrame({"cell": there, "n": cells[there]})

    sums = training.select("row_key", "ids").mapInPandas(summed, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((1 + states + size) * states + 2)
    total[sums["cell"].to_numpy()] = sums["n"].to_numpy() / SCALE
    log10, tokens = total[-2:]
    total = total[:-2].reshape(-1, states)
    return Model.estimated(total[0], total[1 : 1 + states], total[1 + states :]), log10 / max(1.0, tokens)


def trained(training: DataFrame, vocab: Vocabulary, states: int, rounds: int) -> Model:
    """The model after ``rounds`` rounds of Baum-Welch, or after the first one that gained less than ``GAIN``."""
    model, before = first_model(training, vocab, states), -np.inf
    for _ in range(rounds):
        better, mean = baum_welch(training, model)
        if mean - before < GAIN:
            break
        model, before = better, mean
    return model


def _forward(encoded: DataFrame, model: Model) -> DataFrame:
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, pool in pools(_rows(batches)):
            yield pd.DataFrame({"row_key": keys, "class_log": pool.log10(model)})

    return encoded.select("row_key", "ids").mapInPandas(scored, "row_key long, class_log double")


def hmm_scores(docs: DataFrame, held_out: Column, text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, known: int = KNOWN) -> DataFrame:
    """``docs`` without its text, with held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Rows where ``held_out`` isn't true train the model, by at most ``rounds`` rounds of Baum-Welch, fewer if the likelihood
    hardly rises any more. A null text is an empty one: its only token is the end. Rows stay, repeated ones too. With no
    training rows all counts are 0 and the model is uniform; an empty table stays empty. Columns of ``docs`` named like
    an added one are replaced, all others stay whatever they are called. The longest text counts, not the longest batch:
    texts are pooled by their tokens.
    """
    keep = [c for c in docs.columns if c not in {"held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", text_col}]
    # the caller's columns go by numbers here, so that none can clash
    rows = docs.select(*[F.col(f"`{c}`").alias(f"h_{k}") for k, c in enumerate(keep)], F.coalesce(held_out, F.lit(False)).alias("held"), F.col(f"`{text_col}`").alias("text"))
    counts = cut(word_counts(rows.filter(~F.col("held")), "text"), "hmm-counts")
    vocab = vocabulary(counts, known)
    encoded = cut(encode(rows, "text", vocab).withColumn("row_key", F.monotonically_increasing_id()), "hmm-encoded")
    model = trained(encoded.filter(~F.col("held")), vocab, states, rounds)

    rare = encoded.select("row_key", F.explode("rare").alias("word")).groupBy("row_key", "word").agg(F.count(F.lit(1)).alias("k"))
    rare = rare.join(counts, "word").groupBy("row_key").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("rare_log"), F.sum("k").alias("n_rare"))
    out = encoded.drop("ids", "rare").join(_forward(encoded, model), "row_key").join(rare, "row_key", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return out.select(
        *[F.col(f"h_{k}").alias(c) for k, c in enumerate(keep)],
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_seen") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("seen_log") + rare_log - F.col("n_tokens") * F.log10(F.lit(float(vocab.tokens + vocab.distinct + 1)))).alias("base_score"),
        (F.col("class_log") + F.col("share_log") + rare_log).alias("score"),
    )

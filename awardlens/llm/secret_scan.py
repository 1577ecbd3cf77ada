"""Secret scans: fixed patterns, and a linear-chain conditional random field that finds secrets of other looks.

The field tags every token of a text as B (a secret begins), I (inside) or O. Its features are the token's shape, the kinds
of the tokens beside it and features of its file. It is trained by gradient steps on the conditional log-likelihood, on a
bounded sample of chunks labelled by the fixed patterns, and decodes whole token sequences by Viterbi; stretches in which
a bound shows that the best path is O throughout needn't be walked. Scores of a distinct token are computed once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 6, "access": 20, "hex": 24}

TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+(?:={1,2}(?![A-Za-z0-9+/_.=-]))?|[^\s\x00-\x7F]+|\S")
CONTEXT_WORDS = frozenset("password passwd pwd secret token key apikey api_key auth bearer credential private access login pass".split())
HEX_TABLE = bytes(ord("x") if chr(i) in "0123456789abcdef" else ord(" ") for i in range(256))
CLASS_TABLE = bytes(ord("d" if chr(i).isdigit() and i < 128 else "u" if chr(i).isupper() else "l" if chr(i).islower() else "p") for i in range(256))
SHAPE = ("classes", "size", "digits", "turns", "distinct", "number", "dots", "hex", "head")
BESIDE_LETTERS = re.compile("[^a-z]+")
DIGIT_RUN = re.compile(rb"d+")
BESIDE = (-3, -2, -1, 1)  # neighbours whose kind is a feature
FEATURES, MASKED = 4096, 0  # feature 0 has no weight: it stands for a masked one
OWN, FILE = 10, 2
O, B, I = 0, 1, 2
NEVER = -1e6
SAMPLE_DOCS, POSITIVE_CHUNKS, OTHER_CHUNKS, CHUNK = 16384, 1024, 2048, 32
CACHED_TOKENS, CACHED_LENGTH = 1 << 19, 64
LOOKALIKE = 16  # an unlabelled mixed token of so many characters may or may not be a secret
Span = tuple[int, str, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the fixed patterns' matches. The tests before each pattern only skip texts without any."""
    out = []
    low = text.lower()
    if any(x in low for x in NAMES):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    marks, at = text.encode("latin-1", "replace").translate(HEX_TABLE), 0
    while (at := marks.find(b"x" * LEAST["hex"], at)) >= 0:
        m = HEX.match(text, at)
        out.append((at, "hex", m.end()))
        at = m.end()
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def value_spans(text: str) -> list[tuple[int, int]]:
    """The secrets themselves in the fixed patterns' matches: of an assignment the value alone."""
    out = []
    for start, kind, end in base_spans(text):
        m = ASSIGN.match(text, start) if kind == "assign" else None
        out.append(m.span(2) if m else (start, end))
    return sorted(set(out))


@lru_cache(1 << 16)
def _hashed(name: str) -> int:
    return 1 + int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % (FEATURES - 1)


def signature(token: str) -> tuple:
    """All that a token's features say, with ``OWN`` - 1 parts; the last two are among the fixed patterns' own cues."""
    n = len(token)
    hexadecimal, head = not token.strip("0123456789abcdef"), token[:4] if token[:4].isupper() else ""
    if token.isalpha() and token.isascii():
        classes = "l" if token.islower() else "u" if token.isupper() else "ul"
        return classes, min(n // 4, 12), 0, 0, len(set(token)) * 5 // n, False, 0, hexadecimal, head
    kinds = token.encode("latin-1", "replace").translate(CLASS_TABLE)
    classes = "".join(c for c in "dulp" if c.encode() in kinds)
    digits, runs = kinds.count(b"d"), len(DIGIT_RUN.findall(kinds))
    turns = 2 * runs - (kinds[:1] == b"d") - (kinds[-1:] == b"d")  # between a digit and another character
    return classes, min(n // 4, 12), digits * 5 // n, min(turns * 4 // n, 3) + 4 * (turns > 4), len(set(token)) * 5 // n, not token.strip("0123456789.-/"), min(token.count("."), 4), hexadecimal, head


def shape(token: str) -> list[str]:
    """The ``OWN`` features of a token by itself."""
    return ["any", *(f"{name}={x}" for name, x in zip(SHAPE, signature(token), strict=True))]


def kind_of(token: str) -> str:
    """What a token is to its neighbours."""
    if len(token) == 1 and not token.isalnum():
        return token if token.isascii() else "other"
    low = token.lower()
    if low in CONTEXT_WORDS or (not low.isalpha() and not CONTEXT_WORDS.isdisjoint(BESIDE_LETTERS.split(low))):
        return "named"
    digit, letter = any(map(str.isdigit, token)), any(map(str.isalpha, token))
    return "mixed" if digit and letter else "number" if digit else "word" if token.isascii() else "other"


def file_features(text: str, mixed: int) -> list[str]:
    """The ``FILE`` features of a whole text: assignments to a line, and how many mixed tokens it has."""
    lines = text.count("\n") + 1
    return [f"assignments={min((text.count('=') + text.count(':')) * 4 // lines, 4)}", f"mixed={min(mixed, 5)}"]


class Tokens(dict):
    """Distinct tokens' numbers; tokens that features don't tell apart have one. Features are computed once for each number."""

    def __init__(self) -> None:
        super().__init__()
        self.kinds: dict[str, int] = {"": 0}
        self.forms: dict[tuple, int] = {}
        self.own, self.kind, self.lookalike = [], [], []

    def __missing__(self, token: str) -> int:
        kind = kind_of(token)
        form = (signature(token), kind, kind == "mixed" and len(token) >= LOOKALIKE)
        value = self.forms.setdefault(form, len(self.own))
        if value == len(self.own):
            self.own.append([_hashed(x) for x in shape(token)])
            self.kind.append(self.kinds.setdefault(kind, len(self.kinds)))
            self.lookalike.append(form[2])
        if len(token) <= CACHED_LENGTH:
            self[token] = value
        return value

    def numbers(self, text: str) -> np.ndarray:
        if len(self) > CACHED_TOKENS:
            self.clear()
        found = TOKEN.findall(text)
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def neighbours(kinds: np.ndarray) -> np.ndarray:
    """(tokens, len(BESIDE)): the kinds at each distance, 0 beyond either end."""
    n = len(kinds)
    padded = np.concatenate((np.zeros(3, kinds.dtype), kinds, np.zeros(3, kinds.dtype)))
    return np.stack([padded[3 + d : 3 + d + n] for d in BESIDE], axis=1)


def feature_ids(text: str, tokens: Tokens) -> np.ndarray:
    """(tokens, OWN + len(BESIDE) + FILE): hashed features of every token of a text."""
    numbers = tokens.numbers(text)
    table = np.array([[_hashed(f"{d}={k}") for d in BESIDE] for k in tokens.kinds], np.int64)
    kinds = np.array([tokens.kind[k] for k in numbers.tolist()], np.int64)
    beside, own = neighbours(kinds), np.array([tokens.own[k] for k in numbers.tolist()], np.int64).reshape(-1, OWN)
    file = np.array([_hashed(x) for x in file_features(text, int((kinds == tokens.kinds.get("mixed", -1)).sum()))])
    return np.concatenate((own, np.stack([table[beside[:, j], j] for j in range(len(BESIDE))], axis=1), np.broadcast_to(file, (len(numbers), FILE))), axis=1)


def allowed_labels(text: str, tokens: Tokens) -> np.ndarray:
    """(tokens): the labels that a token may have in training, as bits: B or I within a fixed pattern's secret, else O; any for look-alikes."""
    places = [m.span() for m in TOKEN.finditer(text)]
    numbers = tokens.numbers(text)
    out = np.array([7 if tokens.lookalike[k] else 1 << O for k in numbers.tolist()], np.uint8)
    spans, k, last = value_spans(text), 0, None
    for t, (start, end) in enumerate(places):
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        hit = spans[k] if k < len(spans) and spans[k][0] < end else None
        if hit is not None:
            out[t] = 1 << (I if hit == last else B)
        last = hit
    return out


class Field:
    """weights[feature, label] and moves[label, label]; every text begins and ends beside an O, and a secret begins with B."""

    def __init__(self) -> None:
        self.weights, self.moves = np.zeros((FEATURES, 3)), np.zeros((3, 3))
        self.moves[O, I] = NEVER

    def viterbi(self, s: np.ndarray) -> list[int]:
        """The best labels of tokens with scores s (tokens, labels)."""
        n = len(s)
        best, back = self.moves[O] + s[0], np.zeros((n, 3), dtype=int)
        for t in range(1, n):
            paths = best[:, None] + self.moves
            back[t] = paths.argmax(axis=0)
            best = paths.max(axis=0) + s[t]
        path = [int((best + self.moves[:, O]).argmax())]
        for t in range(n - 1, 0, -1):
            path.append(int(back[t, path[-1]]))
        return path[::-1]

    def open_stretches(self, s: np.ndarray) -> list[tuple[int, int]]:
        """The stretches outside which the best path of the whole text is O.

        Labels other than O in a row gain over all O no more than the sum of their best scores against O and of the best
        move at each step. A token is O if every row of tokens that holds it gains nothing by that bound.
        """
        step = max(self.moves[a, b] for a in range(3) for b in range(3) if (a, b) not in ((O, O), (O, I))) - self.moves[O, O]
        total = np.concatenate(([0.0], np.cumsum(np.maximum(s[:, B], s[:, I]) - s[:, O] + step)))
        gain = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
        open_ = np.concatenate(([0], (gain + step > -1e-9).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(open_))
        return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))

    def decode(self, s: np.ndarray) -> list[tuple[int, int]]:
        """The secrets of a text as (first token, end), from the best path over its whole token sequence."""
        out: list[tuple[int, int]] = []
        for a, b in self.open_stretches(s):
            for t, y in enumerate(self.viterbi(s[a:b]), a):
                if y == B:
                    out.append((t, t + 1))
                elif y == I:
                    out[-1] = (out[-1][0], t + 1)
        return out

    def marginals(self, s: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected labels (chunks, tokens, 3) and summed moves of many chunks at once, from scaled forward and backward sums.

        ``s`` has the scores, minus infinity (nearly) where a label isn't allowed; tokens that aren't ``real`` follow the others.
        """
        c, n, _ = s.shape
        e, move = np.exp(s - s.max(axis=2, keepdims=True)), np.exp(self.moves - self.moves.max())
        share = lambda x, axes: x / x.sum(axis=axes, keepdims=True)
        fore, rear = np.empty((c, n, 3)), np.empty((c, n, 3))
        fore[:, 0] = share(move[O] * e[:, 0], 1)
        for t in range(1, n):
            fore[:, t] = np.where(real[:, t, None], share(fore[:, t - 1] @ move * e[:, t], 1), fore[:, t - 1])
        rear[:, -1] = move[:, O]
        for t in range(n - 2, -1, -1):
            rear[:, t] = np.where(real[:, t + 1, None], share((e[:, t + 1] * rear[:, t + 1]) @ move.T, 1), rear[:, t + 1])
        tokens = share(fore * rear, 2) * real[:, :, None]
        both = share(fore[:, :-1, :, None] * move * (e[:, 1:] * rear[:, 1:])[:, :, None], (2, 3))
        moves = (both * real[:, 1:, None, None]).sum(axis=(0, 1))
        moves[O] += tokens[:, 0].sum(axis=0)
        moves[:, O] += share(fore[:, -1] * move[:, O], 1).sum(axis=0)
        return tokens, moves

    def gradient(self, ids: np.ndarray, allowed: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the likelihood of the allowed labels, for tokens and moves: their expectation less that over all labels."""
        s = np.zeros((*ids.shape[:2], 3))
        for k in range(ids.shape[2]):
            s += self.weights[ids[:, :, k]]
        bits = (allowed[:, :, None] >> np.arange(3)) & 1
        kept, kept_moves = self.marginals(np.where(bits == 1, s, NEVER), real)
        free, free_moves = self.marginals(s, real)
        return kept - free, kept_moves - free_moves

    def fit(self, ids: np.ndarray, allowed: np.ndarray, real: np.ndarray, rounds: int = 40, rate: float = 0.4, decay: float = 1e-3) -> Field:
        """Adaptive gradient steps over chunks (features, allowed labels, which tokens are real) at once; none leave it untrained."""
        if not len(ids):
            self.weights[:, O] = 1.0
            return self
        seen, seen_moves, columns = np.full((FEATURES, 3), 1e-6), np.full((3, 3), 1e-6), np.ascontiguousarray(ids[real].T)
        for _ in range(rounds):
            tokens, moves = self.gradient(ids, allowed, real)
            own = tokens[real]
            step = np.stack([sum(np.bincount(column, own[:, y], FEATURES) for column in columns) for y in range(3)], axis=1) / len(ids) - decay * self.weights / 10
            step[MASKED] = 0
            seen += step**2
            self.weights += rate * step / np.sqrt(seen)
            moves = moves / len(ids)
            moves[O, I] = 0
            seen_moves += moves**2
            self.moves += rate * moves / np.sqrt(seen_moves)
        return self


def chunks(text: str, tokens: Tokens, pick: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(whether it holds a labelled secret, features, allowed labels) of at most ``CHUNK`` tokens: around each secret, and one other place."""
    allowed = allowed_labels(text, tokens)
    if not len(allowed):
        return
    ids = feature_ids(text, tokens)

    def part(a: int) -> tuple[np.ndarray, np.ndarray]:
        own = allowed[a : a + CHUNK].copy()
        if own[0] == 1 << I:
            own[0] = 7  # its beginning isn't in the chunk
        return ids[a : a + CHUNK], own

    for t in np.flatnonzero(allowed == 1 << B).tolist():
        yield True, *part(max(0, t - CHUNK // 3))
    other = part(pick % max(1, len(allowed) - CHUNK + 1))
    if not np.isin(other[1], (1 << B, 1 << I)).any():
        yield False, *other


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field trained on chunks of about ``sample_docs`` documents, those with the smallest hashes.

    At most ``POSITIVE_CHUNKS`` chunks with a secret of the fixed patterns and ``OTHER_CHUNKS`` without one meet at the
    driver, each of at most ``CHUNK`` tokens. Unlabelled look-alikes of secrets may have any label. Chunks with a
    secret also count with the words before masked, and with what the patterns themselves look for masked, so that shape and
    context each have to suffice. Nulls and empty texts have no tokens; repeated rows have one hash and come in together; of
    equal hashes those with the least features stand first. An empty table, or one without tokens, gives a field that finds nothing.
    """
    text, one = F.col(f"`{text_col}`"), F.lit(1 << 40)
    share = min(1.0, sample_docs / max(1, docs.count()))
    rows = docs.select(F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text), one).alias("h"), text.alias("t")).filter(F.col("h") <= int(share * (1 << 40)))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for batch in batches:
            for h, t in zip(batch["h"], batch["t"], strict=True):
                found = [(h, k, secret, ids.astype("<u2").tobytes(), allowed.tobytes()) for k, (secret, ids, allowed) in enumerate(chunks(t or "", tokens, int(h)))]
                if found:
                    yield pd.DataFrame(found, columns=["h", "k", "secret", "ids", "allowed"])

    made = rows.mapInPandas(cut_up, "h long, k int, secret boolean, ids binary, allowed binary")
    order = (F.xxhash64("h", "k"), "ids")
    table = made.filter("secret").orderBy(*order).limit(POSITIVE_CHUNKS).union(made.filter("not secret").orderBy(*order).limit(OTHER_CHUNKS)).toArrow().to_pylist()
    width = OWN + len(BESIDE) + FILE
    examples = []
    for row in table:
        ids, allowed = np.frombuffer(row["ids"], "<u2").reshape(-1, width).astype(np.int64), np.frombuffer(row["allowed"], np.uint8)
        examples.append((ids, allowed))
        if row["secret"]:
            inside = (allowed & (1 << O)) == 0
            unnamed, unshaped = ids.copy(), ids.copy()
            unnamed[:, OWN : OWN + 3] = MASKED
            unshaped[inside, OWN - 2 : OWN] = MASKED
            examples += [(unnamed, allowed), (unshaped, allowed)]
    ids, allowed, real = np.zeros((len(examples), CHUNK, width), np.int64), np.full((len(examples), CHUNK), 7, np.uint8), np.zeros((len(examples), CHUNK), bool)
    for k, (x, y) in enumerate(examples):
        ids[k, : len(x)], allowed[k, : len(x)], real[k, : len(x)] = x, y, True
    return Field().fit(ids, allowed, real)


class Tagger:
    """A field applied to texts, with the scores of distinct tokens and kinds kept."""

    def __init__(self, field: Field) -> None:
        self.field, self.tokens = field, Tokens()
        self.own, self.beside, self.kinds, self.known = np.zeros((0, 3)), np.zeros((len(BESIDE), 0, 3)), np.zeros(0, np.int64), 0

    def _learn(self) -> None:
        w, tokens = self.field.weights, self.tokens
        n = len(tokens.own)
        if self.known < n:
            if len(self.own) < n:
                self.own, self.kinds = np.resize(self.own, (2 * n, 3)), np.resize(self.kinds, 2 * n)
            new = np.array(tokens.own[self.known :], np.int64)
            self.own[self.known : n] = w[new].sum(axis=1)
            self.kinds[self.known : n] = tokens.kind[self.known :]
            self.known = n
        if self.beside.shape[1] != len(tokens.kinds):
            self.beside = np.array([[w[_hashed(f"{d}={k}")] for k in tokens.kinds] for d in BESIDE])

    def scores(self, text: str) -> np.ndarray:
        """(tokens, labels) of the whole text."""
        numbers = self.tokens.numbers(text)
        self._learn()
        kinds = self.kinds[numbers]
        s, n, padded = self.own[numbers], len(kinds), np.concatenate((np.zeros(3, np.int64), kinds, np.zeros(3, np.int64)))
        for j, d in enumerate(BESIDE):
            s += self.beside[j][padded[3 + d : 3 + d + n]]
        mixed = int((kinds == self.tokens.kinds.get("mixed", -1)).sum())
        return s + self.field.weights[[_hashed(x) for x in file_features(text, mixed)]].sum(axis=0)

    def spans(self, text: str) -> list[Span]:
        s = self.scores(text)
        found = self.field.decode(s) if len(s) else []
        if not found:
            return []
        places = [m.span() for m in TOKEN.finditer(text)]
        return [(places[a][0], "crf", places[b - 1][1]) for a, b in found]


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``' id and secrets, an array of (kind, start, end) in code points by start, then kind; end is exclusive.

    Kinds are those of the fixed patterns, and crf for every span that the field tags, whether or not a pattern has it too.
    Null and empty texts have no secrets; repeated rows and null ids stay as they are. Other columns are left out.
    """
    weights, moves = field.weights, field.moves

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Field()
        own.weights, own.moves = weights, moves
        tagger = Tagger(own)
        for batch in batches:
            found = [sorted(base_spans(t or "") + tagger.spans(t or ""), key=lambda s: (s[0], KINDS.index(s[1]))) for t in batch["s_text"]]
            yield pd.DataFrame({"s_id": batch["s_id"], "secrets": [[{"kind": k, "start": a, "end": b} for a, k, b in spans] for spans in found]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("s_id"), F.col(f"`{text_col}`").alias("s_text"))
    return rows.mapInPandas(run, f"s_id {kind}, secrets array<struct<kind:string,start:int,end:int>>").withColumnRenamed("s_id", id_col)

"""Substring deduplication with a log-structured fingerprint index.

Every window of 50 words contains 26 runs of 25 words; the least of their hashes is the window's fingerprint. Equal
windows have equal fingerprints, and neighbouring windows mostly share theirs, so that a document has about one
fingerprint in 13 words while no repeated window escapes. The index holds sorted immutable runs of (fingerprint, least and
greatest document); a batch is aggregated to a run of its own, merge-joined with the runs before it to find fingerprints
of more than one document, and added; when there are too many runs they are compacted into one. Runs are kept in a folder
of the caller's, so that later batches are held against them. Windows of repeated
fingerprints are then verified: a 128-bit digest of all their words, and the least document that has it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table_path

WINDOW, RUN = 50, 25
BATCHES, FAN_OUT = 6, 4  # so that a call from nothing compacts once
CACHED_WORDS = 1 << 20
BROADCAST_IDS = 2_000_000  # 16 MB of ids; more are joined by a shuffle
LAST, LAST_TEXT = (1 << 63) - 1, "\U0010ffff" * 4  # stand for a null id, which comes after all others
HOT_ROWS, HOT_SHARE = 1 << 16, 10_000  # a digest of more rows, and of more than such a part of all rows, is hot
BASE = 0x9E3779B97F4A7C15
PART = 15  # hexadecimal digits of a sequence digest that tell texts of one id apart


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Fingerprinter:
    """Fingerprints of the windows of a word sequence, through a rolling polynomial hash modulo 2^64."""

    def __init__(self, window: int, run: int) -> None:
        self.window, self.run, self.words = window, run, _Hashes()
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        inverse = pow(BASE, -1, 1 << 64)
        self.up = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64))))
        self.down = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, inverse, np.uint64))))

    def __call__(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        if n < self.window:
            return np.zeros(0, np.uint64)
        if n > len(self.up):
            self._grow(2 * n)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self.up[:n])))
        g = (total[self.run :] - total[: -self.run]) * self.down[: n - self.run + 1]
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        width, size = self.window - self.run + 1, 1
        while size * 2 <= width:
            g = np.minimum(g[:-size], g[size:])
            size *= 2
        rest = width - size
        return np.minimum(g[: len(g) - rest], g[rest:]) if rest else g


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def sequence_digest(joined: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(joined)


class FingerprintIndex:
    """Sorted runs (print, low, high): the least and greatest document of each fingerprint; and the scans they come from.

    ``path`` is the caller's folder, where a later session finds the runs and scans again; without one the index lives in
    the shared scratch folder. Runs are immutable. Compaction writes the merged run before it deletes the ones it
    replaces: if it is broken off, both are there, which changes no minimum or maximum.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, kind: str = "bigint", fan_out: int = FAN_OUT) -> None:
        self.spark, self.path, self.kind, self.fan_out = spark, path or table_path(spark, "index"), kind, fan_out
        self.runs: dict[str, DataFrame] = {p: self._read(p) for p in self._folders("run-")}

    def _folders(self, prefix: str) -> list[str]:
        """Whole tables of the index, in the order in which they were written."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        names = sorted(f.getPath().getName() for f in files.listStatus(root))
        return [f"{self.path}/{n}" for n in names if n.startswith(prefix) and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]

    def _new(self, prefix: str) -> str:
        return f"{self.path}/{prefix}{time.time_ns():020d}-{uuid.uuid4().hex}"

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"print long, low {self.kind}, high {self.kind}").parquet(path)

    def _run(self, entries: DataFrame, least: str, greatest: str) -> str:
        run = entries.groupBy("print").agg(F.min(least).alias("low"), F.max(greatest).alias("high"))
        path = self._new("run-")
        run.sortWithinPartitions("print").write.parquet(path)
        self.runs[path] = self._read(path)
        return path

    def add(self, batch: DataFrame) -> DataFrame:
        """Index ``batch`` (doc, print) and return its fingerprints (print) that more than one document has by now."""
        older = list(self.runs.values())
        new = self.runs[self._run(batch, "doc", "doc")]
        found = new.filter("low < high").select("print")
        for run in older:
            found = found.union(new.hint("merge").join(run, "print").select("print"))
        found = cut(found.distinct(), "index-found")
        if len(self.runs) > self.fan_out:
            self.compact()
        return found

    def compact(self) -> None:
        """Merge all runs into one."""
        old = dict(self.runs)
        self._run(reduce(DataFrame.union, old.values()), "low", "high")
        for path in old:
            del self.runs[path]
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def scans(self) -> DataFrame | None:
        """(doc, sequence, n_words, prints) of all documents that were indexed, or None."""
        folders = self._folders("scan-")
        return self.spark.read.schema(_scan_schema(self.kind)).parquet(*folders) if folders else None

    def add_scan(self, scan: DataFrame) -> DataFrame:
        path = self._new("scan-")
        scan.write.parquet(path)
        return self.spark.read.schema(_scan_schema(self.kind)).parquet(path)


def _scan_schema(kind: str) -> str:
    return f"doc {kind}, sequence string, n_words long, prints array<long>"


def _scan(docs: DataFrame, window: int, run: int, kind: str) -> DataFrame:
    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prints = Fingerprinter(window, run)
        for batch in batches:
            rows = []
            for text in batch["x_text"]:
                words = split_words(text)
                rows.append((sequence_digest(b" ".join(words)), len(words), np.unique(prints(words)).view(np.int64)))
            yield pd.DataFrame({"doc": batch["x_id"], "sequence": [r[0] for r in rows], "n_words": [r[1] for r in rows], "prints": [r[2] for r in rows]})

    return docs.mapInPandas(scanned, _scan_schema(kind))


def _windows(chosen: DataFrame, window: int, run: int, kind: str) -> DataFrame:
    """Of documents x_id, x_text joined with their sequence and repeated fingerprints: digests of the windows that have these."""

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prints = Fingerprinter(window, run)
        for batch in batches:
            for doc, text, sequence, repeated in zip(batch["x_id"], batch["x_text"], batch["sequence"], batch["repeated"], strict=True):
                words = split_words(text)
                joined = b" ".join(words)
                if sequence_digest(joined) != sequence:
                    continue
                at = np.flatnonzero(np.isin(prints(words), np.asarray(repeated, np.int64).view(np.uint64)))
                ends = np.cumsum([len(w) + 1 for w in words])
                starts = ends - np.array([len(w) + 1 for w in words])
                digest = xxhash.xxh3_128_digest
                made = b"".join([digest(joined[a:b]) for a, b in zip(starts[at].tolist(), (ends[at + window - 1] - 1).tolist(), strict=True)])
                two = np.frombuffer(made, np.int64).reshape(-1, 2)
                yield pd.DataFrame({"h1": two[:, 0], "h2": two[:, 1], "doc": np.full(len(at), doc), "part": np.full(len(at), int(sequence[:PART], 16)), "at": at.astype(np.int32)})

    return chosen.mapInPandas(dealt, f"h1 long, h2 long, doc {kind}, part long, at int")


def _cleaned(rows: DataFrame, fields: list, window: int, names: list[str]) -> DataFrame:
    """Rows with their text's kept words; those joined with the entry of another sequence are left out.

    ``names`` are the columns of id, text, sequence, whether the whole text goes, and the starts of removed windows.
    """
    id_name, text_name, sequence_name, whole_name, at_name = names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep, counts, removed, kept = [], [], [], []
            for text, sequence, whole, at in zip(batch[text_name], batch[sequence_name], batch[whole_name], batch[at_name], strict=True):
                words = split_words(text)
                joined, n = b" ".join(words), len(words)
                keep.append(sequence is None or sequence == sequence_digest(joined))
                cover = np.zeros(n + 1, np.int64)
                if keep[-1] and whole:
                    cover[:] = 1
                elif keep[-1] and len(at):
                    starts = np.asarray(at, np.int64)
                    cover[starts] += 1
                    cover[starts + window] -= 1
                    cover = np.cumsum(cover)
                stay = cover[:n] == 0
                left = int(stay.sum())
                counts.append(n)
                removed.append(n - left)
                kept.append((joined if left == n else b" ".join([words[i] for i in np.flatnonzero(stay)])).decode("utf-8", "surrogatepass"))
            yield batch.drop(columns=names).assign(n_words=counts, n_removed=removed, kept=kept)[keep]

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_words long, n_removed long, kept string"])
    return rows.mapInPandas(run, kinds)


def _ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "x_id") -> DataFrame:
    """``docs`` whose ``key`` is among ``ids`` (x_id, distinct) or not; few ids are broadcast, after a count, more are shuffled."""
    renamed = ids.withColumnRenamed("x_id", key)
    return docs.join(F.broadcast(renamed) if ids.count() <= broadcast_ids(ids) else renamed, key, how)


def broadcast_ids(ids: DataFrame) -> int:
    """How many ids may be broadcast: whole numbers have a fixed width, texts none."""
    return BROADCAST_IDS if ids.schema["x_id"].dataType.typeName() == "long" else 0


def _repeats(windows: DataFrame) -> DataFrame:
    """The rows of ``windows`` whose digest a smaller document has as well.

    A digest with more than one in ``HOT_SHARE`` of all rows is hot: there are at most so many of them, so they are
    broadcast, and their rows needn't meet in one task. All others are joined by their digest.
    """
    least = windows.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most").drop("most")
    least = cut(least, "index-least")
    hot = least.filter(F.col("n") > max(HOT_ROWS, windows.count() // HOT_SHARE)).drop("n")
    if hot.isEmpty():
        return windows.join(least.drop("n"), ["h1", "h2"]).filter("doc > least").drop("least")
    few = F.broadcast(hot)
    met = windows.join(few, ["h1", "h2"])
    others = windows.join(few, ["h1", "h2"], "left_anti").join(least.drop("n"), ["h1", "h2"])
    return met.union(others.select(*met.columns)).filter("doc > least").drop("least")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN, batches: int = BATCHES, index_path: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """``docs`` without its text, with n_words, n_removed and kept (the words that stay, joined by single spaces).

    Removed is each word in a window of ``window`` words whose sequence also starts in a document of smaller id, judged on
    the input. Ids are whole numbers or texts (in order of their code points); a null id comes after all others, equal ids
    don't remove one another's words. Null texts have no words. Texts of equal words are one class, of which the least id
    is indexed: of the others all goes, if they have a window at all. Rows stay, also repeated ones; an empty table
    stays empty. Columns named like an added one are replaced, all others stay whatever they are called.

    With ``index_path`` the index is kept there, and ``history`` holds the documents that earlier calls indexed (same
    columns): the rows of ``docs`` are judged against these, too, whose own results stand. Of the history only texts
    that share a fingerprint with a new one are read. An id that comes again with another text is another document.
    """
    spark = docs.sparkSession
    added = {"n_words", "n_removed", "kept", text_col}
    fields = [f for f in docs.schema.fields if f.name not in added]
    whole_ids = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    kind, last = ("bigint", F.lit(LAST)) if whole_ids else ("string", F.lit(LAST_TEXT))
    order = F.coalesce(F.col(f"`{id_col}`").cast(kind), last)
    named = lambda df: df.select(order.alias("x_id"), F.col(f"`{text_col}`").alias("x_text"))
    texts = named(docs)
    index = FingerprintIndex(spark, index_path, kind)
    known = index.scans()
    scanned = index.add_scan(_scan(texts, window, run, kind))
    everything, sources = (scanned, texts) if known is None else (scanned.union(known), texts if history is None else texts.union(named(history)))
    classes = cut(everything.groupBy("sequence").agg(F.min("doc").alias("doc"), F.first("n_words").alias("n_words"), F.first("prints").alias("prints")), "index-classes")
    fresh_classes = classes if known is None else classes.join(scanned.select("sequence").distinct(), "sequence", "left_semi")

    entries = fresh_classes.select("doc", F.explode("prints").alias("print"))
    if whole_ids:
        ends = fresh_classes.agg(F.min("doc").alias("a"), F.max(F.when(F.col("doc") != LAST, F.col("doc"))).alias("b")).first()
        low, high = ends["a"] or 0, ends["b"] if ends["b"] is not None else 0
        width = max(1, -(-(high - low + 1) // batches))
        batch_of = F.least(F.floor((F.col("doc") - low) / width), F.lit(batches - 1))
    else:
        batch_of = F.pmod(F.xxhash64("doc"), F.lit(batches))
    repeated = cut(reduce(DataFrame.union, [index.add(entries.filter(batch_of == k)) for k in range(batches)]).distinct(), "index-repeated")

    lists = classes.select("doc", "sequence", F.explode("prints").alias("print")).join(repeated, "print")
    lists = cut(lists.groupBy(F.col("doc").alias("x_id"), "sequence").agg(F.collect_list("print").alias("repeated")), "index-lists")
    chosen = _ids(sources, lists.select("x_id").distinct(), "left_semi").join(lists, "x_id")
    windows = cut(_windows(chosen, window, run, kind), "index-windows")
    spans = _repeats(windows).groupBy(F.col("doc").alias("x_id"), "part").agg(F.collect_set("at").alias("at"))

    part = F.conv(F.substring("sequence", 1, PART), 16, 10).cast("long")
    own = lists.select("x_id", "sequence", part.alias("part")).join(spans, ["x_id", "part"]).select("x_id", "sequence", F.lit(False).alias("whole"), "at")
    copies = scanned.filter(F.col("n_words") >= window).select(F.col("doc").alias("x_id"), "sequence").distinct()
    copies = copies.join(classes.select("sequence", F.col("doc").alias("first")), "sequence").filter("x_id > first")
    copies = copies.select("x_id", "sequence", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("at"))
    entries = cut(own.unionByName(copies), "index-entries")
    touched = entries.select("x_id").distinct()

    names = fresh([f.name for f in fields] + list(added), "x_id", "x_text", "x_sequence", "x_whole", "x_at")
    x_id, x_text, x_sequence, x_whole, x_at = names
    rows = docs.select(*[F.col(f"`{f.name}`") for f in fields], order.alias(x_id), F.col(f"`{text_col}`").alias(x_text))
    plain = _ids(rows, touched, "left_anti", x_id).withColumns({x_sequence: F.lit(None).cast("string"), x_whole: F.lit(False), x_at: F.array().cast("array<int>")})
    others = scanned.select(F.col("doc").alias("x_id"), "sequence").join(touched, "x_id", "left_semi").distinct()
    others = others.join(entries.select("x_id", "sequence"), ["x_id", "sequence"], "left_anti").select("x_id", "sequence", F.lit(False).alias("whole"), F.array().cast("array<int>").alias("at"))
    marked = _ids(rows, touched, "left_semi", x_id).join(entries.unionByName(others).toDF(x_id, x_sequence, x_whole, x_at), x_id)
    columns = [*[F.col(f"`{f.name}`") for f in fields], *names]
    return _cleaned(plain.select(*columns).unionByName(marked.select(*columns)), fields, window, names)

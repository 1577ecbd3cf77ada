"""Keyed tables on bucketed, versioned Parquet: replace and ignore upserts that can be repeated.

A table's rows are dealt to buckets by a hash of their key. A load writes its rows once, as one more layer of the buckets
that they fall in, and publishes a version that names the layers of every bucket; no other row is read or written. Readers
merge: of a key's rows that of the newest layer counts. A bucket with too many layers is compacted, on its own. A version
is a file that only one writer can make (:mod:`.versions`); a writer that comes second looks at the version that came
first and publishes on top of it, so that no load is lost. A failed job leaves the version before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.schemas import AWARDS_LANDING, ENTITIES, KEYS, SNAPSHOTS, TABLES, aligned
from ..sources.landing import read_or_empty
from ..sources.scratch import collected, frugal, remove, written
from .versions import VersionLog

BUCKETS, MOST_LAYERS = 32, 4
TASK_ROWS = 250_000  # about as many rows of a load meet in one task
FILE_TASK_ROWS = 1_000_000  # rows that a task writes to all buckets at least, as each makes a file a bucket; a tenth where cores would be idle
REPEATED = 1_000_000  # digests of keys that a load may repeat, to be broadcast


def newest_per_key(rows: DataFrame, keys: list[str], newest: str | None, within: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: the greatest ``newest`` (null least), then the greatest of the other columns in their order.

    Columns of ``within`` follow from the key; rows that are partitioned by them aren't shuffled again, and stay sorted by them.
    """
    others = [c for c in rows.columns if c not in keys and c != newest and c not in within]
    order = [F.col(c).desc_nulls_last() for c in ([newest] if newest else []) + others]
    return ranked_per_key(rows.filter(" and ".join(f"{k} is not null" for k in keys)), [*within, *keys], *(order or [F.lit(0)]))


def upsert_replace(existing: DataFrame, incoming: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """Existing rows, replaced whole by incoming rows of the same key."""
    new = newest_per_key(incoming, keys, newest)
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new).select(*existing.columns)


def append_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and incoming rows of new keys; existing ones win."""
    new = newest_per_key(incoming, keys, None).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def ranked_per_key(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row per key in an order of the caller's."""
    ranked = rows.withColumn("store_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("store_rank = 1").drop("store_rank")


class Store:
    """The tables awards, entities and entity_snapshots under a folder.

    ``buckets`` holds for tables that this store creates; a table keeps the number that it was created with.
    """

    NEWEST = {"awards": "pulled_at", "entities": "last_pulled_at", "entity_snapshots": None}
    IGNORES = {"entity_snapshots"}  # existing rows win

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, most_layers: int = MOST_LAYERS) -> None:
        self.spark, self.root, self.buckets, self.most_layers = spark, root.rstrip("/"), buckets, most_layers

    def init(self) -> str:
        """Create the tables that aren't there yet; the folder is returned."""
        for table in TABLES:
            log = self._log(table)
            if not log.numbers():
                log.publish(1, {"buckets": self.buckets, "rows": 0, "layers": {}, "batches": {}})
        return self.root

    def _log(self, table: str) -> VersionLog:
        return VersionLog(self.spark, f"{self.root}/{table}/_versions")

    def version(self, table: str) -> tuple[int, dict]:
        """Number and content of the newest version. Content: number of buckets, rows, layers of each bucket (name and number of the version that brought it, oldest first), last batch of each stream."""
        return self._log(table).newest() or (0, {"buckets": self.buckets, "rows": 0, "layers": {}, "batches": {}})

    def _layers(self, table: str, layers: dict[str, list], columns: list[str] | None = None) -> DataFrame:
        """The rows of the named layers with ``bucket`` and ``brought``, the number of the version that brought a layer."""
        base = f"{self.root}/{table}"
        schema = TABLES[table]
        columns = columns or schema.names
        paths = [f"{base}/layer={name}/bucket={bucket}" for bucket, held in sorted(layers.items()) for name, _ in held]
        if not paths:
            return self.spark.createDataFrame([], schema).select(*columns, F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("brought"))
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*columns, "layer", F.col("bucket").cast("int").alias("bucket"))
        names = sorted({(name, number) for held in layers.values() for name, number in held})
        if len({number for _, number in names}) == 1:
            return rows.drop("layer").withColumn("brought", F.lit(names[0][1]).cast("long"))
        numbers = self.spark.createDataFrame(names, "layer string, brought long")  # at most most_layers + 1 to a bucket
        return rows.join(F.broadcast(numbers), "layer").drop("layer")

    def _merged(self, table: str, layers: dict[str, list], columns: list[str] | None = None) -> DataFrame:
        """The current rows of the named layers, with their bucket. Only buckets of several layers are merged, by the keys of all layers but the first."""
        keys, wanted = KEYS[table], columns or TABLES[table].names
        single = {b: held for b, held in layers.items() if len(held) == 1 or table in self.IGNORES}  # ignored keys were never written
        several = {b: held for b, held in layers.items() if b not in single}
        out = self._layers(table, single, wanted).drop("brought")
        if not several:
            return out
        rows = self._layers(table, several, list(dict.fromkeys([*keys, *wanted])))
        later = self._layers(table, {b: held[1:] for b, held in several.items()}, keys)
        top = later.groupBy("bucket", *keys).agg(F.max("brought").alias("top"))
        held = rows.join(top, ["bucket", *keys], "left").filter("top is null or brought = top")
        return out.unionByName(held.select(*wanted, "bucket"))

    def read(self, table: str) -> DataFrame:
        """The newest version, or an empty table."""
        return self._merged(table, self.version(table)[1]["layers"]).drop("bucket")

    def lookup(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of the given keys (as many as a load has): only their buckets are read."""
        layers, n = (self.version(table)[1][k] for k in ("layers", "buckets"))
        wanted = keys.select(*KEYS[table], self._bucket(table, n).alias("bucket")).distinct()
        touched = {str(r["bucket"]) for r in wanted.select("bucket").distinct().collect()}
        return self._merged(table, {b: held for b, held in layers.items() if b in touched}).join(wanted, [*KEYS[table], "bucket"], "left_semi").drop("bucket")

    @staticmethod
    def _bucket(table: str, n: int) -> Column:
        return F.pmod(F.xxhash64(*KEYS[table]), F.lit(n)).cast("int")

    def _dealt(self, table: str, rows: DataFrame, n: int, total: int) -> DataFrame:
        """Rows with their bucket, each bucket dealt to as many tasks as ``total`` rows in ``n`` buckets need; rows of one key meet in one (``store_part``)."""
        parts = max(1, -(-total // (n * TASK_ROWS)))
        part = F.col("bucket") * parts + F.pmod(F.xxhash64(F.lit("part"), *KEYS[table]), F.lit(parts)).cast("int")
        return rows.withColumn("bucket", self._bucket(table, n)).withColumn("store_part", part).repartitionById(n * parts, "store_part")

    def _write(self, table: str, rows: DataFrame) -> tuple[str, dict[str, int]]:
        """Write rows (with their bucket) as a layer; its name, and how many rows of it each bucket has."""
        name = uuid.uuid4().hex
        path = f"{self.root}/{table}/layer={name}"
        rows.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
        counts = self.spark.read.schema("bucket int").parquet(path).groupBy("bucket").count().collect()  # one row a bucket
        return name, {str(r["bucket"]): r["count"] for r in counts}

    def _newest(self, table: str, rows: DataFrame, n: int) -> DataFrame:
        """The newest row of each key, with its bucket.

        Whole rows are moved only where their key may come again: of all rows a digest of the key is (equal keys have equal
        ones), and those whose digest is single stay in the tasks that read them. Where more than a tenth of the rows have keys
        that come again, or these are more than ``REPEATED``, all rows are dealt by bucket.
        """
        keys, newest = KEYS[table], self.NEWEST[table]
        rows = rows.filter(" and ".join(f"{k} is not null" for k in keys)).withColumn("store_digest", F.xxhash64(F.lit("load"), *keys))
        counts = rows.groupBy("store_digest").count()
        several = F.col("count") > 1
        total, moved, repeated = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("count", F.when(several, F.col("count")))], F.count_if(several)).first()
        if moved > total // 10 or repeated > REPEATED:
            return newest_per_key(self._dealt(table, rows.drop("store_digest"), n, total), keys, newest, within=("bucket", "store_part")).drop("store_part")
        single, tasks = rows, max(1, total // FILE_TASK_ROWS, min(self.spark.sparkContext.defaultParallelism, total * 10 // FILE_TASK_ROWS))
        if repeated:
            again = written(counts.filter(several).select("store_digest"), "repeated-keys")
            single = rows.join(F.broadcast(again), "store_digest", "left_anti")
            single = single.unionByName(newest_per_key(rows.join(F.broadcast(again), "store_digest", "left_semi"), keys, newest, within=("store_digest",)))
        return single.drop("store_digest").withColumn("bucket", self._bucket(table, n)).coalesce(tasks)

    def load(self, table: str, incoming: DataFrame, source: str | None = None, batch: int = 0) -> int:
        """Upsert rows (snapshots are appended where new); how many rows the table has more than before.

        The rows are read twice, for digests of their keys and to be written, and have to be the same then; they are written once,
        whatever others publish meanwhile; only for snapshots, where existing rows win, they are
        written again if others came first. With ``source``, a batch whose number isn't above the last one that was
        published for it changes nothing: it has been loaded before.
        """
        with frugal(self.spark), frugal(incoming.sparkSession), collected() as held:  # a stream's batches have a session of their own
            try:
                return self._load(table, incoming, source, batch)
            finally:
                remove(self.spark, *held)

    def _load(self, table: str, incoming: DataFrame, source: str | None, batch: int) -> int:
        log, keys = self._log(table), KEYS[table]
        number, content = self.version(table)
        if source is not None and content["batches"].get(source, -1) >= batch:
            return 0

        def dealt(rows: DataFrame) -> DataFrame:
            return self._newest(table, rows, content["buckets"])

        rows = aligned(incoming, TABLES[table])
        layer = counts = None
        while True:
            here = {b: content["layers"][b] for b in (counts or content["layers"]) if b in content["layers"]}
            existing = self._merged(table, here, keys)
            if table in self.IGNORES:
                layer, counts = self._write(table, dealt(rows.join(existing, keys, "left_anti")))
                gained = sum(counts.values())
            else:
                if layer is None:
                    layer, counts = self._write(table, dealt(rows))
                    existing = self._merged(table, {b: content["layers"][b] for b in counts if b in content["layers"]}, keys)
                held = {b for b in counts if b in content["layers"]}  # all rows of the other buckets are new
                mine = self._layers(table, {b: [(layer, 0)] for b in held}, keys).drop("brought")
                gained = sum(n for b, n in counts.items() if b not in held) + (mine.join(existing, [*keys, "bucket"], "left_anti").count() if held else 0)
            if not counts and source is None:
                return 0
            layers = content["layers"] | {b: [*content["layers"].get(b, []), (layer, number + 1)] for b in counts}
            batches = content["batches"] | ({source: batch} if source is not None else {})
            if log.publish(number + 1, content | {"rows": content["rows"] + gained, "layers": layers, "batches": batches}):
                self.compact(table)
                return gained
            number, content = self.version(table)
            if source is not None and content["batches"].get(source, -1) >= batch:
                return 0

    def compact(self, table: str) -> int:
        """Merge the layers of each bucket that has more than ``most_layers``; how many buckets that were."""
        log = self._log(table)
        number, content = self.version(table)
        full = {b: held for b, held in content["layers"].items() if len(held) > self.most_layers}
        if not full:
            return 0
        layer, _ = self._write(table, self._dealt(table, self._merged(table, full), content["buckets"], content["rows"]).drop("store_part"))
        while True:
            same = {b for b, held in full.items() if content["layers"].get(b, [])[: len(held)] == held}  # or another has compacted it
            layers = content["layers"] | {b: [(layer, full[b][-1][1]), *content["layers"][b][len(full[b]) :]] for b in same}
            if not same or log.publish(number + 1, content | {"layers": layers}):
                return len(same)
            number, content = self.version(table)

    def changes(self, table: str, number: int, columns: list[str] | None = None) -> DataFrame:
        """(keys, before, after) of the rows that version ``number`` brought: the rows as structs, whole or of ``columns``, before null where the key is new.

        Only the layers of that load, and of the version before the buckets that it fell in, are read. A compaction, and
        the version that creates a table, bring nothing. Both versions must still be there.
        """
        log, keys, columns = self._log(table), KEYS[table], columns or TABLES[table].names
        wanted = list(dict.fromkeys([*keys, *columns]))
        now, old = log.read(number)["layers"], (log.read(number - 1)["layers"] if number > 1 else {})
        known = {name for held in old.values() for name, _ in held}
        brought = {b: new for b, held in now.items() if (new := [x for x in held if x[1] == number and x[0] not in known])}
        new, held = ({b: x for b, x in brought.items() if (b in old) is there} for there in (False, True))
        row = F.struct(*columns)
        # a bucket that the version before hadn't has no predecessors to look for
        only = self._layers(table, new, wanted).select(*keys, F.when(F.lit(False), row).alias("before"), row.alias("after"))
        if not held:
            return only
        after = self._layers(table, held, wanted).select(*keys, "bucket", row.alias("after"))
        before = self._merged(table, {b: old[b] for b in held}, wanted).select(*keys, "bucket", row.alias("before"))
        both = after.join(before, [*keys, "bucket"], "left").select(*keys, "before", "after")
        return both.unionByName(only) if new else both

    def vacuum(self, table: str, keep: int = 2) -> int:
        """Forget all but the newest ``keep`` versions, which readers may still use, and delete what only those had; how many versions went.

        Layers that no version has named yet are left alone: another writer may be about to.
        """
        log = self._log(table)
        numbers = log.numbers()
        old, new = numbers[:-keep] if keep >= 1 else [], numbers[-keep:]
        named = lambda these: {(n, b) for v in these for b, held in log.read(v)["layers"].items() for n, _ in held}
        for name, bucket in sorted(named(old) - named(new)):
            log.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(log.folder.getParent(), f"layer={name}/bucket={bucket}"), True)
        for number in old:
            log.forget(number)
        return len(old)

    def load_all(self, landing: str) -> dict[str, int]:
        """Load what has landed in ``landing``; a missing folder or file loads nothing."""
        self.init()
        base = landing.rstrip("/")
        found = {
            "awards": read_or_empty(self.spark, f"{base}/awards_*.parquet", AWARDS_LANDING),
            "entities": read_or_empty(self.spark, f"{base}/entities.parquet", ENTITIES),
            "entity_snapshots": read_or_empty(self.spark, f"{base}/entity_snapshots_*.parquet", SNAPSHOTS),
        }
        return {table: 0 if rows.isEmpty() else self.load(table, rows) for table, rows in found.items()}

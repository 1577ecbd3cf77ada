"""Tables between two stages, in the folder that the cluster shares."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session with local executors only (tests) gets a folder of its own; a cluster raises an error,
    as its executors couldn't read one another's local files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints/awardlens"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: What holds within :func:`frugal`: files of a shuffle go as the execution that made them ends, not when the driver's garbage is
#: collected; a task keeps so many files of a partitioned table open before it sorts (and spills) rows instead.
FRUGAL = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "64"}
_frugal: dict[int, tuple[int, dict[str, str]]] = {}
_lock = threading.Lock()


@contextmanager
def frugal(spark: SparkSession) -> Iterator[None]:
    """What is executed within leaves no shuffle files and spills no partitioned writes; the session's settings return after the last of all threads."""
    session = spark._jsparkSession.hashCode()
    with _lock:
        inside, before = _frugal.get(session) or (0, {k: spark.conf.get(k) for k in FRUGAL})
        _frugal[session] = inside + 1, before
        for k, v in FRUGAL.items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _lock:
            inside, before = _frugal.pop(session)
            if inside > 1:
                _frugal[session] = inside - 1, before
            else:
                for k, v in before.items():
                    spark.conf.set(k, v)


_collected: ContextVar[list[str] | None] = ContextVar("collected", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (held := _collected.get()) is not None:
        held.append(path)
    return path


@contextmanager
def collected() -> Iterator[list[str]]:
    """The scratch paths that are made within the block, to be removed once no plan reads them."""
    held: list[str] = []
    token = _collected.set(held)
    try:
        yield held
    finally:
        _collected.reset(token)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later plan reads."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows survives lost executors and doesn't compute it again."""
    path = scratch_path(df.sparkSession, name)
    with frugal(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

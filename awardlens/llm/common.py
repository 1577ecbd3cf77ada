"""Helpers shared by the corpus operators: shared scratch tables, names that cannot clash, tokenising in bytes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import collected, remove
from ..sources.scratch import scratch_path as table_path
from ..sources.scratch import written as cut

__all__ = ["LOWER", "SPACE", "UPPER", "WORD", "ascii_lower", "collected", "cut", "fresh", "read", "remove", "sql_lower", "table_path", "word_count"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each lengthened by underscores until no column of ``taken`` is called so in any case."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay. Pure ASCII text takes the fast path, with the same result."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def word_count(text: Column) -> Column:
    """How many words a text has. Splitting between them is much faster than counting matches; only the ends can be empty."""
    return F.when(text.isNotNull(), F.size(F.array_remove(F.split(text, SPACE), ""))).otherwise(0).cast("long")


def sql_lower(text: str) -> str:
    """DuckDB SQL that lower-cases A-Z only."""
    return f"translate({text}, '{UPPER}', '{LOWER}')"

"""Connected components of an edge table by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, table_path


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its neighbours (large: the greater ones; small: the lesser ones and itself) to the least of them."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u and v, no nulls): root is the least node it can reach.

    Rounds go on until the edges no longer change; they are then stars around the roots. Minima are aggregated before
    they are joined back, so that a node with very many neighbours is no single task's work. Loops and repeated edges
    are allowed; a node with a loop only is its own root. An empty table gives an empty result.
    """
    spark = edges.sparkSession
    loops = edges.filter("u = v").select(F.col("u").alias("node"))

    def stored(df: DataFrame) -> tuple[DataFrame, str]:
        path = table_path(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    def state_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, path = stored(edges.filter("u <> v").select("u", "v"))
    before = state_of(now)
    for _ in range(most_rounds if before[0] else 0):
        older, (now, path) = path, stored(_stars(_stars(now, True), False))
        state = state_of(now)
        remove(spark, older)
        if state == before:
            break
        before = state
    else:
        if before[0]:  # no edges need no round
            raise RuntimeError("the components didn't settle")
    linked = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return linked.union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).union(loops.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))

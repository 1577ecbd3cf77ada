"""Query op12: toxicity of the whole documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .toxicity import toxicity, train

#: Documents of this remainder are held out.
FOLDS, HELD = 5, 0


def _held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD


def op12_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, train(docs, read(spark, sf_dir, "labels"), ~_held_out()))
    return found.select("doc_id", _held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "toxic_windows")


QUERIES = {"op12_compression_toxicity": op12_compression_toxicity}
ORACLES: dict[str, str] = {}

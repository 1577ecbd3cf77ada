"""Query op10: every document's score by the classifier trained on weak labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .quality import THRESHOLD, score, train


def op10_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    _, scorer, _ = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, scorer).select("doc_id", F.round("bad_score", 6).alias("bad_score"), (F.col("bad_score") < THRESHOLD).alias("keep"))


QUERIES = {"op10_weak_labels": op10_weak_labels}
ORACLES: dict[str, str] = {}

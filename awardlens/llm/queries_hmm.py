"""Query op5: the whole documents table scored by a hidden Markov model of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .hmm import hmm_scores

#: Documents of this remainder are held out.
FOLDS, HELD = 7, 2


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return hmm_scores(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD)


QUERIES = {"op5_hmm": op5_hmm}
ORACLES: dict[str, str] = {}

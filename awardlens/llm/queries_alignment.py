"""Query op11: the whole documents table aligned between two tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .token_alignment import align_corpus

FOLDER_CONF, FOLDER = "spark.awardlens.tokenizers", "/opt/tokenizers"


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_corpus(read(spark, sf_dir, "documents"), spark.conf.get(FOLDER_CONF, FOLDER))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLES: dict[str, str] = {}

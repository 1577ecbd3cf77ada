"""Query op6: the whole documents table with personal data replaced by pseudonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .pii import pseudonymise

KEY_CONF = "spark.awardlens.pseudonyms.key"
TEST_KEY = "for-invented-documents-only"  # stands in where the session sets none: the given tables hold no real persons


def session_key(spark: SparkSession) -> str:
    """The key that the session's configuration names."""
    return spark.conf.get(KEY_CONF, None) or TEST_KEY


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark)).select("doc_id", "pii_values", "text")


QUERIES = {"op6_pseudonyms": op6_pseudonyms}
ORACLES: dict[str, str] = {}

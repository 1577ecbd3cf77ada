"""The corpus pipeline: five stages, each an operator of the llm subpackage, from raw documents to a weighted mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from awardlens.llm.common import cut, fresh, read, word_count
from awardlens.llm.decontamination import decontaminate
from awardlens.llm.mixing import pareto_mix
from awardlens.llm.pii import pseudonymise
from awardlens.llm.quality import accepted
from awardlens.llm.queries_pii import session_key
from awardlens.llm.simhash import without_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return accepted(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 and more."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to pseudonyms; n_chars follows the text."""
    out = pseudonymise(docs, session_key(spark)).drop("pii_values")
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with their sizes, copies and words taken."""
    (size,) = fresh(docs.columns, "size")
    out = pareto_mix(docs.withColumn(size, word_count(F.col("text"))), size_col=size).filter("copies > 0")
    return out if size == "size" else out.drop(size)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("mix", mix)]
ORACLE_SQL = None  # the classifier and the shingle groups can't be expressed in SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{name}")
    return docs

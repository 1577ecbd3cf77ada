"""Query op1: the whole documents table through progressive JPEG files, each with its RGB tensor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .progressive_jpeg import decode_media, encode_texts


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = encode_texts(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = decode_media(files)
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),  # right() would count characters
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "height",
        "width",
        "rgb",
    )


QUERIES = {"op1_progressive_jpeg": op1_progressive_jpeg}
ORACLES: dict[str, str] = {}

"""Query op4: the whole pages table archived and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .warc import read_archives, write_archives


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(read(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc_dictionary": op4_warc_dictionary}
ORACLES = {
    "op4_warc_dictionary": """
WITH p AS (SELECT page_id, COALESCE(html, '') AS h, sha1(COALESCE(html, '')) AS d FROM pages),
m AS (SELECT *, MAX(page_id) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((CAST('0x' || substr(d, ((i // 4) * 5 + 1)::INT, 5) AS BIGINT) >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to FROM m"""
}

"""Query op7: benchmark passages in the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, sql_lower
from .decontamination import TERM, WINDOW, phrase_matches


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_matches(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("d_words").cast("long").alias("n_words"),
        F.size("d_hits").cast("long").alias("n_hit"),
        F.size("d_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.transform("d_items", lambda i: i.cast("string")))), 256).alias("items_sha256"),
        (F.size("d_hits") > 0).alias("contaminated"),
    )


#: {docs} and {bench} are relations; d has r (a row number) and doc_id, matched the hit word positions.
MATCH_SQL = f"""
d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(regexp_extract_all({sql_lower("text")}, '{TERM}'), []) AS w FROM {{docs}}),
items AS (SELECT DISTINCT item_id, regexp_extract_all({sql_lower("text")}, '{TERM}') AS w FROM {{bench}} WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, LEAST(len(w), {WINDOW}) AS l FROM items WHERE len(w) > 0),
lens AS (SELECT DISTINCT l FROM sized),
iw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + l - 1), ' ') AS s FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM sized)),
dw AS (SELECT r, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS s FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens)),
hit AS (SELECT r, l, i, item_id FROM dw JOIN iw USING (s)),
places AS (SELECT r, COUNT(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, COUNT(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit) GROUP BY r),
matched AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, COALESCE(p.n, 0)::BIGINT AS n_hit, COALESCE(m.n, 0)::BIGINT AS n_items, sha256(COALESCE(m.ids, '')) AS items_sha256, COALESCE(p.n, 0) > 0 AS contaminated
  FROM d LEFT JOIN places p ON d.r = p.r LEFT JOIN named m ON d.r = m.r)
"""

QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES = {"op7_decontamination": f"WITH {MATCH_SQL.format(docs='documents', bench='benchmark')} SELECT * EXCLUDE (r) FROM matched"}

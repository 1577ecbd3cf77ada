"""Query op8: passages of 50 words that repeat in the whole documents table, removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, read
from .substring_index import WINDOW, remove_repeats


def op8_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_substring_index": op8_substring_index}
ORACLES = {
    "op8_substring_index": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
firsts AS (SELECT s, MIN(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM win JOIN firsts USING (s) WHERE doc_id > least),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
stay AS (SELECT r, COUNT(*) AS n, string_agg(x, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - COALESCE(n, 0))::BIGINT AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN stay USING (r)"""
}

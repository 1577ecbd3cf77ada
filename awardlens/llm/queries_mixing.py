"""Query op3: the whole documents table mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import WORD, cut, read, word_count
from .mixing import BUCKET_ROWS, CAP, FILLS, SEED, pareto_mix


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", word_count(docs["text"]).alias("size")), "mix-sizes")
    return pareto_mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def _fill(k: int) -> str:
    fits = "CASE WHEN more = 0 AND size <= gap THEN size END" if k else "size"
    half = "/ 2" if k == FILLS - 1 else ""
    o = "PARTITION BY rk ORDER BY q, size, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    new = f"SELECT *, COALESCE(COALESCE(SUM(fits) OVER ({o}), 0) + fits {half} <= gap, FALSE)::INT AS new FROM (SELECT *, {fits} AS fits FROM fill{k})"
    return f"fill{k + 1} AS (SELECT * REPLACE (gap - SUM(new * size) OVER (PARTITION BY rk) AS gap, more + new AS more) FROM (SELECT * EXCLUDE (fits) FROM ({new}))),".replace("SELECT * REPLACE", "SELECT * EXCLUDE (new) REPLACE")


#: sized has doc_id, source and size.
MIX_SQL = """
stats AS (SELECT source, SUM(size)::DOUBLE AS s, ROW_NUMBER() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1 AS rk FROM sized GROUP BY source),
shares AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM stats),
sums AS (SELECT *, SUM(s) OVER () AS tot, SUM(w) OVER () AS ws,
    COALESCE(SUM({cap} * s) OVER o, 0) AS cb, COALESCE(SUM(w) OVER o, 0) AS wb
  FROM shares WINDOW o AS (ORDER BY {cap} * s / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fulls AS (SELECT *, ({cap} * s * (ws - wb) < w * (tot - cb)) AS f FROM sums),
targets AS (SELECT source, s, rk, CASE WHEN f THEN {cap} * s
    ELSE w * (tot - SUM(CASE WHEN f THEN {cap} * s ELSE 0 END) OVER ()) / (ws - SUM(CASE WHEN f THEN w ELSE 0 END) OVER ()) END AS target FROM fulls),
planned AS (SELECT d.doc_id, d.size, t.s, t.rk, t.target,
    CASE WHEN t.s > 0 THEN FLOOR(LEAST(t.target / t.s, {cap}))::BIGINT ELSE 0 END AS whole,
    (CAST('0x' || substr(md5('{seed}:' || COALESCE(d.doc_id::VARCHAR, 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
ranked AS (SELECT *, LEAST(GREATEST(LEAST(target / s, {cap}) - whole, 1e-12), 1 - 1e-12) AS p, COUNT(*) OVER (PARTITION BY rk) AS n FROM planned),
odds AS (SELECT *, CASE WHEN whole < {cap} THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM ranked),
dealt AS (SELECT *, CASE WHEN q IS NULL THEN -1 ELSE FLOOR((FLOOR(n / {bucket}) + 1) * (q / (1 + q)))::BIGINT END AS b FROM odds),
sums2 AS (SELECT rk, b, SUM(CASE WHEN b >= 0 THEN size ELSE 0 END) AS inb, SUM(whole * size) AS sure, MIN(target) AS t FROM dealt GROUP BY rk, b),
running AS (SELECT *, COALESCE(SUM(inb) OVER (PARTITION BY rk ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, t - SUM(sure) OVER (PARTITION BY rk) AS need FROM sums2),
cuts AS (SELECT rk, MAX(b) FILTER (base <= need AND b >= 0) AS cb, MAX(base) FILTER (base <= need AND b >= 0) AS base, MIN(need) AS need FROM running GROUP BY rk),
fill0 AS (SELECT d.*, c.need - c.base AS gap, 0 AS more FROM dealt d JOIN cuts c ON d.rk = c.rk AND d.b = c.cb),
{fills}
mixed AS (SELECT d.doc_id, d.size, d.s::BIGINT AS source_size, d.target, ((whole + CASE WHEN d.b >= 0 AND d.b < c.cb THEN 1 ELSE 0 END) * size)::BIGINT AS taken
  FROM dealt d JOIN cuts c ON d.rk = c.rk WHERE d.b IS DISTINCT FROM c.cb
  UNION ALL SELECT doc_id, size, s::BIGINT, target, ((whole + more) * size)::BIGINT FROM fill{last})
""".format(cap=CAP, seed=SEED, bucket=BUCKET_ROWS, last=FILLS, fills="\n".join(_fill(k) for k in range(FILLS)))

QUERIES = {"op3_pareto_mix": op3_pareto_mix}
ORACLES = {"op3_pareto_mix": f"WITH sized AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),{MIX_SQL} SELECT * FROM mixed"}

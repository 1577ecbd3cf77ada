"""The isolation forest replayed in SQL, level by level: the same samples, features and cuts follow from the same digests."""

from __future__ import annotations

import math

from ..operators.isolation import CONTAMINATION, FEATURES, GRID, NANO, SAMPLE, SEED, TREES

_LIMIT = math.ceil(math.log2(SAMPLE))
_EULER = 0.5772156649015329


def _correction(n: str) -> str:
    return f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + {_EULER}::DOUBLE) - 2 * ({n} - 1)::DOUBLE / {n} WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _level(k: int) -> str:
    ends = ", ".join(f"MIN({c}) AS lo_{c}, MAX({c}) AS hi_{c}" for c in FEATURES)
    lows, highs = (", ".join(f"{end}_{c}" for c in FEATURES) for end in ("lo", "hi"))
    values = ", ".join(FEATURES)
    stop = "TRUE" if k == _LIMIT else "n < 2 OR len(open) = 0"
    return f"""
ends{k} AS MATERIALIZED (SELECT tree, node, COUNT(*) AS n, {ends} FROM level{k} JOIN points USING (uei) WHERE sampled GROUP BY tree, node),
open{k} AS MATERIALIZED (SELECT tree, node, n, [{lows}] AS lows, [{highs}] AS highs, list_filter(range(1, {len(FEATURES) + 1}), lambda i: [{highs}][i] > [{lows}][i]) AS open, md5('{SEED}:' || tree || ':' || node) AS digest FROM ends{k}),
picked{k} AS MATERIALIZED (SELECT *, open[(CAST('0x' || substr(digest, 1, 8) AS BIGINT) % GREATEST(len(open), 1))::INT + 1] AS f, {stop} AS leaf FROM open{k}),
cuts{k} AS MATERIALIZED (SELECT tree, node, n, leaf, f, lows[f] + (highs[f] - lows[f]) * (CAST('0x' || substr(digest, 9, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE) AS cut FROM picked{k}),
leaves{k} AS MATERIALIZED (SELECT uei, ({k * NANO}::BIGINT + FLOOR(({_correction("n")}) * {NANO} + 0.5))::HUGEINT AS depth FROM level{k} JOIN cuts{k} USING (tree, node) WHERE leaf)""" + (
        "" if k == _LIMIT else f""",
level{k + 1} AS MATERIALIZED (SELECT tree, uei, sampled, node * 2 + CASE WHEN [{values}][f] <= cut THEN 0 ELSE 1 END AS node FROM level{k} JOIN cuts{k} USING (tree, node) JOIN points USING (uei) WHERE NOT leaf)"""
    )


_POINT = ", ".join(f"CASE WHEN MAX({c}) OVER () > MIN({c}) OVER () THEN FLOOR(({c} - MIN({c}) OVER ()) / (MAX({c}) OVER () - MIN({c}) OVER ()) * {GRID} + 0.5) ELSE 0 END::DOUBLE AS {c}" for c in FEATURES)

#: From full_features: forest_rows has uei, raw, score and the features of all recipients under the edge (tables of 20 recipients and more).
FOREST_SQL = f"""points AS MATERIALIZED (SELECT uei, {_POINT} FROM full_features),
dealt AS (SELECT t AS tree, uei, substr(md5(uei || ':{SEED}:' || (t // 4)), (1 + 8 * (t % 4))::INT, 8) AS h FROM points, (SELECT unnest(range({TREES})) AS t)),
level0 AS MATERIALIZED (SELECT tree, uei, ROW_NUMBER() OVER (PARTITION BY tree ORDER BY h, uei) <= {SAMPLE} AS sampled, 1 AS node FROM dealt),{",".join(_level(k) for k in range(_LIMIT + 1))},
depths AS ({" UNION ALL ".join(f"SELECT * FROM leaves{k}" for k in range(_LIMIT + 1))}),
sized AS (SELECT LEAST({SAMPLE}, COUNT(*)) AS n FROM points),
raws AS MATERIALIZED (SELECT uei, ROUND(-pow(2.0::DOUBLE, -(SUM(depth)::DOUBLE / {NANO} / {TREES}) / (SELECT {_correction("n")} FROM sized)), 9) AS raw FROM depths GROUP BY uei),
edge AS (SELECT quantile_cont(raw, {CONTAMINATION}) AS edge, MIN(raw) AS least, MAX(raw) AS most FROM raws),
forest_rows AS (SELECT uei, raw, ROUND(CASE WHEN most > least THEN (most - raw) / (most - least) ELSE 0 END, 6) AS score, full_features.* EXCLUDE (uei) FROM raws JOIN full_features USING (uei), edge WHERE raw < edge)"""

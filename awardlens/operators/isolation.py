"""Multivariate isolation: recipients that few random cuts set apart from the others.

Trees are grown in parallel on hashed samples of bounded size; the forest, whose size doesn't depend on the input, then
scores every recipient in Arrow batches. Samples, features and cuts follow from MD5 digests of recipient, tree and node,
points lie on a grid of whole numbers and depths are whole billionths, so that any engine can replay the forest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import FULL_AND_OPEN, is_modification, json_details, share_of
from ..functions.schemas import RESULT
from ..sources.scratch import written
from .quantiles import exact_quantile
from .results import positive_awards, result

FEATURES = ["log_total_dollars", "award_count", "unique_agencies_count", "naics_diversity", "competition_ratio", "modification_frequency", "entity_age_days"]
CONTAMINATION, TREES, SAMPLE, SEED = 0.05, 100, 256, 42
GRID, NANO = 1_000_000_000, 1_000_000_000  # steps of a scaled feature; units of a depth
Forest = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def recipient_features(awards: DataFrame, entities: DataFrame, as_of: str) -> DataFrame:
    """(uei and the seven features); entity_age_days is null without a registration. Awards are aggregated before the join."""
    grouped = positive_awards(awards).groupBy(F.col("recipient_uei").alias("uei")).agg(
        F.log10(F.greatest(F.sum("total_obligation"), F.lit(1.0))).alias("log_total_dollars"),
        F.count(F.lit(1)).cast("double").alias("award_count"),
        F.count_distinct("awarding_agency").cast("double").alias("unique_agencies_count"),
        F.count_distinct("naics_code").cast("double").alias("naics_diversity"),
        share_of(F.upper("competition_type").like(FULL_AND_OPEN)).alias("competition_ratio"),
        share_of(is_modification("modification_number")).alias("modification_frequency"),
    )
    age = F.datediff(F.lit(as_of).cast("date"), F.col("registration_date")).cast("double")
    return grouped.join(entities.select("uei", "registration_date"), "uei", "left").withColumn("entity_age_days", age).drop("registration_date")


def imputed(features: DataFrame) -> DataFrame:
    """Missing ages become the median of those present, or 0."""
    median = features.agg(F.coalesce(F.median("entity_age_days"), F.lit(0.0)).alias("median_age"))
    return features.crossJoin(F.broadcast(median)).withColumn("entity_age_days", F.coalesce("entity_age_days", "median_age")).drop("median_age")


def scaled(features: DataFrame) -> DataFrame:
    """Features brought to 0 .. 1 by their least and greatest values; a constant one becomes 0."""
    ends = features.agg(*[f(c).alias(f"{k}_{c}") for c in FEATURES for k, f in (("least", F.min), ("most", F.max))])
    joined = features.crossJoin(F.broadcast(ends))
    span = lambda c: F.col(f"most_{c}") - F.col(f"least_{c}")
    return joined.select("uei", *[F.when(span(c) > 0, (F.col(c) - F.col(f"least_{c}")) / span(c)).otherwise(0.0).alias(c) for c in FEATURES])


def path_correction(n: np.ndarray) -> np.ndarray:
    """The mean depth at which a search for an absent key ends in a binary tree of n keys."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, tree: int, seed: int, limit: int) -> list[tuple[int, float, int, int, int]]:
    """Rows (feature or -1, cut, left, right, depth with correction) of one tree; cuts lie within the node's range.

    Node 1 is the root, 2 k and 2 k + 1 are the halves of node k; the digest of a node's number picks its feature and cut.
    """
    rows: list[tuple[int, float, int, int, int]] = [(-1, 0.0, 0, 0, 0)]
    waiting = [(0, 1, points, 0)]
    while waiting:
        at, node, part, depth = waiting.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth >= limit or len(part) < 2 or not len(open_):
            rows[at] = (-1, 0.0, 0, 0, depth * NANO + math.floor(float(path_correction(np.array(len(part)))) * NANO + 0.5))
            continue
        digest = hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()
        f = int(open_[int(digest[:8], 16) % len(open_)])
        cut = float(low[f] + (high[f] - low[f]) * (int(digest[8:21], 16) / 2.0**52))
        side = part[:, f] <= cut
        left, right = len(rows), len(rows) + 1
        rows += [(-1, 0.0, 0, 0, 0)] * 2
        rows[at] = (f, cut, left, right, 0)
        waiting += [(left, 2 * node, part[side], depth + 1), (right, 2 * node + 1, part[~side], depth + 1)]
    return rows


def _gridded(points: pd.DataFrame) -> np.ndarray:
    return np.floor(points[FEATURES].to_numpy(float) * GRID + 0.5)


def forest(points: DataFrame, n: int, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """Trees over samples chosen by digests of recipient and tree (one for four trees): rows are kept first and multiplied after."""
    size = min(sample, n)
    share = 1.0 if n <= size else min(1.0, (size + 6 * math.sqrt(size)) / n)
    most = f"{min(math.ceil(share * (1 << 32)), (1 << 32) - 1):08x}"
    digests = F.transform(F.sequence(F.lit(0), F.lit((trees - 1) // 4)), lambda g: F.md5(F.concat("uei", F.lit(f":{seed}:"), g.cast("string"))))
    each = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.substr(F.get("digests", F.floor(t / 4).cast("int")), 1 + 8 * (t % 4), F.lit(8)).alias("h")))
    chosen = points.withColumn("digests", digests).withColumn("chosen", F.explode(F.filter(each, lambda x: x["h"] <= most))).select("uei", *FEATURES, "chosen.*")
    kept = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy("h", "uei"))).filter(F.col("rank") <= size)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        t = int(group["tree"].iloc[0])
        rows = _grow(_gridded(group), t, seed, max(1, math.ceil(math.log2(max(size, 2)))))
        return pd.DataFrame([(t, k, *row) for k, row in enumerate(rows)], columns=["tree", "node", "feature", "cut", "left", "right", "depth"])

    table = kept.groupBy("tree").applyInPandas(build, "tree long, node long, feature long, cut double, left long, right long, depth long").toPandas().sort_values(["tree", "node"])
    return [tuple(g[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth")) for _, g in table.groupby("tree")]


def anomaly_scores(points: DataFrame, n: int, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(uei, raw): minus 2^(-mean depth / expected depth) to nine places; higher is more normal."""
    grown, scale = forest(points, n, trees, sample, seed), max(float(path_correction(np.array(min(sample, n)))), 1e-9)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _gridded(batch)
            total, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            for feature, cut, left, right, depth in grown:
                at = np.zeros(len(x), int)
                while (going := feature[at] >= 0).any():
                    r, node = rows[going], at[going]
                    at[going] = np.where(x[r, feature[node]] <= cut[node], left[node], right[node])
                total += depth[at]
            yield pd.DataFrame({"uei": batch["uei"], "raw": np.round(-np.exp2(-(total / NANO / max(len(grown), 1)) / scale), 9)})

    return points.mapInPandas(run, "uei string, raw double")


def detect_isolation_outlier(awards: DataFrame, entities: DataFrame, as_of: str, contamination: float = CONTAMINATION, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Recipients below the score that a share of ``contamination`` lies under, scored 0 to 1 over the whole population.

    Under 20 recipients the share is one recipient's at least. One recipient, or none, gives an empty result. Awards without
    a recipient or a positive amount are passed over, repeated ones count each; other columns have no effect. Features and
    scores are written once each; the edge is found from bucket counts.
    """
    spark = awards.sparkSession
    features = written(imputed(written(recipient_features(awards, entities, as_of), "isolation-ages")), "isolation-features")
    n = features.count()
    if n < 2:
        return spark.createDataFrame([], RESULT)
    share = contamination if n >= 20 else max(1 / n, contamination)
    raw = written(anomaly_scores(written(scaled(features), "isolation-points"), n, trees, sample, seed), "isolation-raw")
    edge = exact_quantile(raw, "raw", share)
    ends = raw.agg(F.min("raw").alias("least"), F.max("raw").alias("most")).first()
    span = ends["most"] - ends["least"]
    score = (F.lit(ends["most"]) - F.col("raw")) / F.lit(span) if span > 0 else F.lit(0.0)
    rows = raw.filter(F.col("raw") < edge).withColumn("score", score).join(features, "uei")
    details = json_details(feature_vector=F.struct(*FEATURES), raw_anomaly_score=F.col("raw"), contamination_param=F.lit(share))
    return result(rows, "isolation", details)

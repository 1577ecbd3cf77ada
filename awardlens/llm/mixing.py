"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone.

A document's expected copies are its source's target over its source's size, scaled by an optional weight. Whole copies are
certain; of the fraction that is left, a fixed-size sample is drawn: documents are ranked by the odds of a hashed uniform
number over the odds of their inclusion probability, and the first ones that fill the source's remaining words are taken.
The gap that the first too long one leaves is filled with the next in rank that fit.

The cut of a source is found from sums over buckets of the rank, so that no task has to sort a whole source; rows are
ranked only within the bucket in which the cut falls, and there by parts of about ``BUCKET_ROWS`` rows, whose sums come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: The weights of the sources in code-point order, repeating, and the most copies of a document.
CYCLE = (5, 2, 1)
CAP = 3
SEED = "mix-1"
BUCKET_ROWS = 2000
BROADCAST_ROWS = 500_000  # numbers of documents in the cuts' buckets; more are joined by a shuffle
#: Times that what is left of a source's words is filled with the next documents that fit; the last may end on either side.
FILLS = 4


def ranked_sources(stats: DataFrame) -> DataFrame:
    """``stats`` (m_source and more) with m_rank, from 0 in code-point order, null last. Ranges are numbered on their own, then offset."""
    order = F.col("m_source").asc_nulls_last()
    ranged = cut(stats.repartitionByRange(order).withColumn("m_range", F.spark_partition_id()), "mix-ranges")
    earlier = Window.orderBy("m_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = ranged.groupBy("m_range").agg(F.count(F.lit(1)).alias("m_n")).select("m_range", F.coalesce(F.sum("m_n").over(earlier), F.lit(0)).alias("m_offset"))
    own = ranged.withColumn("m_own", F.row_number().over(Window.partitionBy("m_range").orderBy(order)))
    return own.join(offsets, "m_range").withColumn("m_rank", F.col("m_offset") + F.col("m_own") - 1).drop("m_range", "m_own", "m_offset")


def source_targets(sized: DataFrame, source: str, size: str, cycle: tuple[int, ...] = CYCLE, cap: int = CAP) -> DataFrame:
    """One row per source: its rows and size, and its target.

    Targets share the sum of all sizes by weight; one that is above ``cap`` times its source's size stops there and the
    excess goes to the others by weight, until none is above. Each round is one sum over the sources; what is free for a unit of
    weight only grows, so a source that has stopped stays so. The null source comes last; an empty table has no rows.
    """
    stats = sized.groupBy(F.col(source).alias("m_source")).agg(F.sum(size).alias("m_size"), F.count(F.lit(1)).alias("m_rows"), F.sum(F.col(size) * F.col("m_weight")).alias("m_weighted"))
    share = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (F.col("m_rank") % len(cycle) + 1).cast("int"))
    ranked = cut(ranked_sources(stats).withColumns({"m_share": share, "m_most": (cap * F.col("m_size")).cast("double")}), "mix-ranked")
    total = float(ranked.agg(F.coalesce(F.sum("m_size"), F.lit(0))).first()[0])
    full, stopped = F.lit(False), 0
    while True:
        sums = ranked.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, cap * F.col("m_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("m_share"))), F.lit(0.0))).first()
        free, shares = total - sums[1], sums[2]
        full = F.col("m_most") * F.lit(shares) < F.col("m_share") * F.lit(free)
        now = ranked.filter(full).count() if shares else stopped
        if now == stopped:
            break
        stopped = now
    target = F.when(full, F.col("m_most")).otherwise(F.col("m_share") * F.lit(free) / F.lit(shares)) if shares else F.col("m_most")
    return ranked.select("m_source", "m_rank", "m_size", "m_rows", "m_weighted", target.alias("m_target"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number above 0 and below 1 from the MD5 of seed and key: the same on every run and in any SQL engine."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def pareto_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weight_col: str | None = None, cycle: tuple[int, ...] = CYCLE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` with columns source_size, target, copies and taken added; all rows stay, also those with no copy.

    ``size_col`` counts words; null or negative counts as 0. Rows of size 0 take nothing. A null source is a source of
    its own. Null ids share one random number and are ranked by size; repeated rows are ranked one after another, so
    each may be taken on its own. Where a document's expected copies are whole, nothing is sampled. Weights below 0 or null count as 0, which takes nothing. Columns of ``docs`` keep their names, except that
    columns named like an added one are replaced. Empty tables give empty results.
    """
    keep = [c for c in docs.columns if c not in {"source_size", "target", "copies", "taken"}]
    weight = F.greatest(F.coalesce(F.col(f"`{weight_col}`").cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    words = F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)), F.lit(0))
    # the caller's columns travel in one struct, so that none can clash with those used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("m_row"), F.col(f"`{id_col}`").alias("m_id"), F.col(f"`{source_col}`").alias("m_of"), words.alias("m_words"), weight.alias("m_weight"))
    stats = cut(source_targets(rows, "m_of", "m_words", cycle, cap), "mix-sources")

    per_word = F.when(F.col("m_weighted") > 0, F.col("m_target") / F.col("m_weighted")).otherwise(F.lit(0.0))
    wanted = F.least(F.col("m_weight") * per_word, F.lit(float(cap)))
    planned = rows.join(stats, F.col("m_of").eqNullSafe(F.col("m_source")), "inner").withColumn("m_wanted", wanted).withColumn("m_whole", F.floor("m_wanted").cast("long"))
    fraction = F.col("m_wanted") - F.col("m_whole")
    part = F.least(F.greatest(fraction, F.lit(1e-12)), F.lit(1 - 1e-12))
    u = uniform(F.col("m_id"), seed)
    planned = planned.withColumn("m_part", F.when((F.col("m_whole") < cap) & (F.col("m_weight") > 0) & (fraction > 0), part))
    planned = planned.withColumn("m_q", (u / (1 - u)) / (F.col("m_part") / (1 - F.col("m_part"))))
    buckets = F.floor(F.col("m_rows") / BUCKET_ROWS) + 1
    planned = planned.withColumn("m_bucket", F.when(F.col("m_q").isNotNull(), F.floor(buckets * (F.col("m_q") / (1 + F.col("m_q"))))).otherwise(F.lit(-1)).cast("long"))

    sums = planned.groupBy("m_rank", "m_bucket").agg(F.sum(F.when(F.col("m_bucket") >= 0, F.col("m_words")).otherwise(0)).alias("m_in"), F.sum(F.col("m_whole") * F.col("m_words")).alias("m_sure"), F.first("m_target").alias("m_t"), F.sum("m_part").alias("m_parts"), F.count("m_part").alias("m_drawn"))
    source = Window.partitionBy("m_rank")
    sums = sums.withColumns({"m_before": F.coalesce(F.sum("m_in").over(source.orderBy("m_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "m_need": F.col("m_t") - F.sum("m_sure").over(source)})
    crossing = (F.col("m_before") <= F.col("m_need")) & (F.col("m_bucket") >= 0)
    cuts = cut(sums.groupBy("m_rank").agg(F.max(F.when(crossing, F.col("m_bucket"))).alias("m_cut"), F.max_by("m_before", F.when(crossing, F.col("m_bucket"))).alias("m_base"), F.first("m_need").alias("m_left"), (F.sum("m_parts") / F.sum("m_drawn")).alias("m_mean")), "mix-cuts")

    ready = planned.join(cuts, "m_rank", "inner")
    inside = ready.filter(F.col("m_bucket") == F.col("m_cut"))
    # by the source's mean odds the ranks of all its documents spread evenly over the parts
    even = F.col("m_q") * F.col("m_mean") / (1 - F.col("m_mean"))
    # the rows of that bucket are written and numbered, so that only their numbers and sizes move from here on
    bucket = cut(inside.withColumn("m_no", F.monotonically_increasing_id()), "mix-bucket")
    inside = bucket.select("m_no", "m_rank", "m_rows", "m_id", "m_words", "m_q", "m_left", "m_base", "m_mean")
    inside = inside.withColumns({"m_gap": F.col("m_left") - F.col("m_base"), "m_more": F.lit(0).cast("long"), "m_piece": F.floor(buckets * (even / (1 + even)))})
    pieces = Window.partitionBy("m_rank").orderBy("m_piece").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("m_rank", "m_piece").orderBy("m_q", "m_words", F.col("m_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    for k in range(FILLS):
        fits = F.when((F.col("m_more") == 0) & ((F.col("m_words") <= F.col("m_gap")) if k else F.lit(True)), F.col("m_words"))
        inside = inside.withColumn("m_fits", fits)
        before = inside.groupBy("m_rank", "m_piece").agg(F.sum("m_fits").alias("m_sum")).withColumn("m_ahead", F.coalesce(F.sum("m_sum").over(pieces), F.lit(0))).drop("m_sum")
        ahead = F.col("m_ahead") + F.coalesce(F.sum("m_fits").over(order), F.lit(0))
        closer = ahead + F.col("m_fits") / (2 if k == FILLS - 1 else 1) <= F.col("m_gap")
        inside = inside.join(before, ["m_rank", "m_piece"]).withColumn("m_new", F.coalesce(closer, F.lit(False)).cast("long"))
        inside = cut(inside.drop("m_ahead", "m_fits"), "mix-inside")
        used = inside.groupBy("m_rank").agg(F.sum(F.col("m_new") * F.col("m_words")).alias("m_used"))
        inside = inside.join(used, "m_rank").withColumns({"m_gap": F.col("m_gap") - F.col("m_used"), "m_more": F.col("m_more") + F.col("m_new")}).drop("m_used", "m_new")
    state = inside.select("m_no", "m_more")
    inside = bucket.join(F.broadcast(state) if state.count() <= BROADCAST_ROWS else state, "m_no").drop("m_no")
    outside = ready.filter(~F.coalesce(F.col("m_bucket") == F.col("m_cut"), F.lit(False))).withColumn("m_more", (F.coalesce(F.col("m_bucket") < F.col("m_cut"), F.lit(False)) & (F.col("m_bucket") >= 0)).cast("long"))
    out = outside.unionByName(inside)
    copies = F.col("m_whole") + F.col("m_more")
    return out.select("m_row.*", F.col("m_size").alias("source_size"), F.col("m_target").alias("target"), copies.alias("copies"), (copies * F.col("m_words")).alias("taken"))

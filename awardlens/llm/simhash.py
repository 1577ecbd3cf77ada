"""SimHash near-duplicates: fingerprints, vantage-point shards for exact Hamming links, and groups of similar documents.

Links: distinct fingerprints are dealt to the leaves of a vantage-point tree, which is grown on a bounded sample. A
fingerprint's home is one leaf; it also visits leaves beyond a ball's boundary that it is within the radius of, one way
only, as a pair needs to meet once. Within a leaf a further vantage-point tree prunes branches by triangle bounds. Leaves
give a forest of their links, not all pairs, so that large groups of near copies stay small.

Similar documents (share of common word shingles 0.8 and more): all documents' fingerprints are first dealt to vantage-point
shards as above; what these link is verified on whole shingle sets. At a similarity of 0.8 fingerprints differ in 10 of 64
bits and more, and a tree prunes nothing at such a radius, as unrelated ones lie 32 apart, give or take 4. What the
fingerprints left apart therefore meets in shards of equal minimum-hash bands as well. In each shard vantage points, whose
fingerprints are nearest to those of the most members, are compared with all members on whole shingle sets; of the
members that aren't connected by then, those that share one of their rarest shingles are compared, save those that sizes or
the triangle inequality rule out. Documents that share a band are thus linked whenever they are similar; those that share
none (0.2 % at 0.8, fewer above) are compared if their fingerprints are linked, or both are left over in shards and share a rare shingle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collected, cut, fresh, remove
from .components import components

SEED = 42
RADIUS = 2
SAMPLE = 16384
LEAF = 4096
LEAST_SAMPLE = 16  # sampled fingerprints to a leaf

#: The near-duplicate groups' parameters: shingle words, similarity, bands and their minima, rounds of vantage points.
WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 6
ROUNDS = 3  # of vantage points in each shard, before the members that are left are compared with each other
BLOCK = 1024  # members of a shingle that one task compares with all others
CENTRED = 8  # members from which a shard's centre is taken
BROADCAST_PAIRS = 250_000  # pairs of digests to compare, under 32 MB; more are joined by a shuffle
BROADCAST_ROWS = 1_000_000  # ids and digests of rows to drop or to compare, under 64 MB; more are joined by a shuffle


def shingle_hashes(text: str | None, words: int) -> tuple[np.ndarray, bytes]:
    """XXH64 (seed 42) of each shingle of the lower-cased (A-Z) words, and these words joined by single spaces.

    Of fewer words than a shingle has, the whole sequence is one; no words give no hashes.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if parts else [], np.uint64), joined
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[: -words].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64), joined


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed long; 0 for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): every row's fingerprint as a signed long. Null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"s_id": batch["s_id"], "fp": [fingerprint(shingle_hashes(t, words)[0]) for t in batch["s_text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("s_id"), F.col(text_col).alias("s_text")).mapInPandas(run, f"s_id {kind}, fp long").withColumnRenamed("s_id", id_col)


class Tree:
    """A vantage-point tree over fingerprints: inside of a node are those within its ball's radius."""

    def __init__(self, points: np.ndarray, leaves: int, rng: np.random.Generator) -> None:
        self.points, self.radii, self.children = [], [], []
        self.leaves = 0
        self.root = self._grow(points, leaves, rng)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, points: np.ndarray, leaves: int, rng: np.random.Generator) -> int:
        if leaves < 2 or len(points) < 2 * LEAST_SAMPLE:
            return self._leaf()
        best = None
        for v in rng.choice(points, min(8, len(points)), replace=False):
            d = np.bitwise_count(points ^ v)
            radius = int(np.median(d))
            share = (d <= radius).mean()
            if 0 < share < 1:
                cost = ((d > radius - RADIUS) & (d <= radius)).mean() + abs(share - 0.5) / 2
                best = min(best or (2.0, 0, 0), (cost, int(v), radius))
        if best is None:
            return self._leaf()
        _, v, radius = best
        node = len(self.points)
        self.points.append(np.uint64(v))
        self.radii.append(radius)
        self.children.append((0, 0))
        inside = np.bitwise_count(points ^ np.uint64(v)) <= radius
        share = inside.mean()
        near = min(max(1, round(leaves * share)), leaves - 1)
        self.children[node] = (self._grow(points[inside], near, rng), self._grow(points[~inside], leaves - near, rng))
        return node

    def route(self, points: np.ndarray, at_home: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, indexes of points, whether it is their home). Points at home visit beyond a boundary from inside only; visitors go wherever they are near."""
        waiting = [(self.root, np.arange(len(points)), at_home)]
        while waiting:
            node, at, home = waiting.pop()
            if not len(at):
                continue
            if node < 0:
                yield -node, at, home
                continue
            d, edge = np.bitwise_count(points[at] ^ self.points[node]).astype(np.int16), self.radii[node]
            inside = d <= edge
            to_inside = np.where(home, inside, d - radius <= edge)
            to_outside = np.where(home, ~inside | (d + radius > edge), d + radius > edge)
            left, right = self.children[node]
            waiting.append((left, at[to_inside], home[to_inside]))
            waiting.append((right, at[to_outside], (home & ~inside)[to_outside]))


def _near(points: np.ndarray, at: np.ndarray, queries: np.ndarray, radius: int, rng: np.random.Generator) -> Iterator[tuple[int, np.ndarray]]:
    """(query, points within the radius), by indexes: a vantage-point tree over ``at`` is walked by all queries at once."""
    if not len(at) or not len(queries):
        return
    if len(at) > 256:
        v = points[rng.choice(at)]
        d, q = np.bitwise_count(points[at] ^ v).astype(np.int16), np.bitwise_count(points[queries] ^ v).astype(np.int16)
        edge = int(np.median(d))
        inside = d <= edge
        if 0 < inside.sum() < len(at):
            yield from _near(points, at[inside], queries[q - radius <= edge], radius, rng)
            yield from _near(points, at[~inside], queries[q + radius > edge], radius, rng)
            return
    step = max(1, (1 << 20) // len(at))
    for i in range(0, len(queries), step):
        rows = queries[i : i + step]
        close = np.bitwise_count(points[at][None] ^ points[rows][:, None]) <= radius
        for k in np.flatnonzero(close.sum(axis=1) > 0):
            yield rows[k], at[close[k]]


def forest(points: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Per point the least index of those it is linked with, directly or through others: home with home, visitor with home."""
    label = np.arange(len(points))
    for q, found in _near(points, np.flatnonzero(home), np.arange(len(points)), radius, np.random.default_rng(5)):
        own = label[found]
        if (own == label[q]).all():
            continue
        roots = np.unique(np.append(own, label[q]))
        label[np.isin(label, roots)] = roots[0]
    return label


def hamming_links(fps: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """Edges (u, v) between fingerprints (column fp, distinct) such that all within the radius of each other are connected.

    A tree has at most ``sample`` / 16 leaves. Leaves that are home to more than four times ``leaf`` are split again, each by
    a tree on a sample of its own members, until none is, or its members can't be told apart any further.
    """
    total = fps.count()
    seen = np.array([r["fp"] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64)
    dealt = _dealt(fps.select(F.lit(0).cast("long").alias("leaf"), "fp", F.lit(True).alias("home")), {0: _tree(seen, total, leaf, np.random.default_rng(3))}, radius)
    before: dict[int, int] = {}
    while total > leaf:
        dealt = cut(dealt, "simhash-dealt")
        sizes = {r["leaf"]: r["n"] for r in dealt.filter("home").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 4 * leaf).collect()}
        sizes = {k: n for k, n in sizes.items() if before.get(k) != n}
        if not sizes:
            break
        dealt = _dealt(dealt, _trees(dealt, sizes, sample, leaf), radius)
        before = sizes

    def link(group: pd.DataFrame) -> pd.DataFrame:
        points = group["fp"].to_numpy(np.int64)
        label = forest(points.view(np.uint64), group["home"].to_numpy(), radius)
        tied = label != np.arange(len(points))
        return pd.DataFrame({"u": points[tied], "v": points[label[tied]]})

    return dealt.groupBy("leaf").applyInPandas(link, "u long, v long")


def _tree(seen: np.ndarray, total: int, leaf: int, rng: np.random.Generator) -> Tree:
    return Tree(seen, min(-(-total // leaf), max(1, len(seen) // LEAST_SAMPLE)), rng)


def _trees(dealt: DataFrame, sizes: dict[int, int], sample: int, leaf: int) -> dict[int, Tree]:
    """A tree for each leaf of ``sizes`` (leaf, rows), on about ``sample`` of its members, thinned by hash. At most 12 KB each come back."""
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, sample / n) * (1 << 40)))])
    thinned = dealt.filter("home").filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) <= F.try_element_at(share, F.col("leaf")))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group["leaf"].iloc[0])
        made = _tree(np.sort(group["fp"].to_numpy(np.int64).view(np.uint64)), sizes[k], leaf, np.random.default_rng((3, k & 0x7FFFFFFF)))
        return pd.DataFrame({"leaf": [k], "tree": [pickle.dumps(made)]})

    return {r["leaf"]: pickle.loads(r["tree"]) for r in thinned.groupBy("leaf").applyInPandas(grow, "leaf long, tree binary").collect()}


def _dealt(rows: DataFrame, trees: dict[int, Tree], radius: int) -> DataFrame:
    """Rows (leaf, fp, home) of leaves that have a tree dealt to that tree's leaves, whose numbers are hashes of both; others stay."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for old, group in batch.groupby("leaf"):
                tree = trees.get(int(old))
                if tree is None:
                    yield group
                    continue
                points = group["fp"].to_numpy(np.int64).view(np.uint64)
                for k, at, home in tree.route(points, group["home"].to_numpy(bool), radius):
                    number = xxhash.xxh64_intdigest(f"{old}:{k}") - (1 << 63) if tree.leaves > 1 else old
                    yield pd.DataFrame({"leaf": np.full(len(at), number, np.int64), "fp": points[at].view(np.int64), "home": home})

    return rows.mapInPandas(deal, "leaf long, fp long, home boolean")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) per row: the least id reachable over links of ``radius`` or fewer bits, the row's own included.

    Rows of equal fingerprints (all null and wordless texts among them) are one class. Null ids are passed over in minima;
    a component of null ids only has a null component. Repeated rows stay. Other columns are left out.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words), "simhash-rows")
    classes = cut(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-classes")
    roots = cut(components(hamming_links(classes, radius)), "simhash-roots")
    joined = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(joined.select("fp", "root").join(least, "root").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select(id_col, "fp", "component_id")


def minima(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation minimum hashes: the least hash of each bin; empty bins borrow from the next filled one."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    bin_of = (mixed % np.uint64(bins)).astype(np.int64)
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, bin_of, mixed)
    filled = np.zeros(bins, bool)
    filled[bin_of] = True
    if not filled.all():
        places = np.flatnonzero(filled)
        chosen = places[np.searchsorted(places, np.arange(bins)) % len(places)]
        steps = (chosen - np.arange(bins)) % bins
        out = out[chosen] + steps.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return out


def _signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["s_text"]:
                hashes, joined = shingle_hashes(text, words)
                bins = minima(hashes, bands * rows).reshape(bands, rows) if len(hashes) else np.zeros((0, rows), np.uint64)
                keys = [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(bins)]
                out.append((xxhash.xxh3_128_hexdigest(joined), keys, fingerprint(hashes)))
            yield pd.DataFrame({"s_id": batch["s_id"], "s_hash": batch["s_hash"], "sequence": [r[0] for r in out], "bands": [r[1] for r in out], "fp": [r[2] for r in out]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("s_id"), F.md5(text_col).alias("s_hash"), F.col(text_col).alias("s_text")).mapInPandas(run, f"s_id {kind}, s_hash string, sequence string, bands array<long>, fp long")


def _shards(classes: DataFrame) -> DataFrame:
    """(node, shard): the classes of every shard of two members or more; a shard's members have one band in common."""
    dealt = classes.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("shard"))
    shared = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return dealt.join(shared.select("shard"), "shard")


def _fingerprint_pairs(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): pairs of classes by which all of equal or near fingerprints are connected, found in vantage-point shards; one pair a class."""
    points = cut(classes.groupBy("fp").agg(F.min("node").alias("point")), "simhash-prints")
    same = classes.join(points, "fp").filter("node <> point").select(F.col("node").alias("u"), F.col("point").alias("v"))
    ties = hamming_links(points.select("fp"), radius)
    named = lambda c: points.select(F.col("fp").alias(c), F.col("point").alias(f"{c}_node"))
    near = ties.join(named("u"), "u").join(named("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    return same.union(near)


def _held(sets: DataFrame, few: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``sets`` whose node is one of ``few`` (written before): the others aren't shuffled."""
    return sets.join(F.broadcast(few) if few.count() <= most else few, "node", "left_semi")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, common, whole): sizes of the intersection and the union of both classes' shingle sets.

    Few pairs come to the sets; of the second classes' sets only those that are asked for are shuffled.
    """
    pairs = cut(pairs, "simhash-pairs")
    own = F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs
    points = cut(pairs.select(F.col("v").alias("node")).distinct(), "simhash-asked")
    first = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")).join(own, "u")
    both = first.join(_held(sets, points, BROADCAST_PAIRS).select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.select("u", "v", common.alias("common"), (F.size("a") + F.size("b") - common).alias("whole"))


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``members`` with their root; those that ``roots`` hasn't are their own."""
    if roots is None:
        return members.withColumn("root", F.col("node"))
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _grown(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """(node, root), written: the least node that each can reach over the links ``found`` (u, v) and those before, of nodes that aren't their own.

    ``roots`` is this table before ``found``. Only links between its components are followed, so that earlier ones aren't gone over again.
    """
    if roots is not None:
        for c in ("u", "v"):
            found = found.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(c, F.coalesce(f"{c}_root", c)).select("u", "v")
    pairs = found.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    moved = cut(components(pairs).filter("node <> root"), "simhash-moved")
    if roots is None:
        return moved
    later = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("later")), "root", "left")
    return cut(later.select("node", F.coalesce("later", "root").alias("root")).unionByName(moved), "simhash-roots")


def _ranked(sets: DataFrame) -> DataFrame:
    """(node, n, shared, rare): the size of a set, how many of its shingles another of ``sets`` has too, and these, the rarest first."""
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    lists = each.join(often, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("s"))
    rare = F.transform("s", lambda x: x["shingle"])
    return lists.join(sets.select("node", F.size("shingles").alias("n")), "node").select("node", "n", F.size("s").alias("shared"), rare.alias("rare"))


def _centred(shards: DataFrame, prints: DataFrame | None) -> DataFrame:
    """(node, shard, size, far): by how many bits a member's fingerprint differs from its shard's centre, the bits that most members have.

    Of a group of edited copies the original is nearest to the centre. Small shards have none, nor have shards without ``prints`` (node, fp).
    """
    sizes = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
    if prints is None:
        return shards.join(sizes, "shard").select("node", "shard", "size", F.lit(0).alias("far"))
    large = shards.join(sizes.filter(F.col("size") >= CENTRED), "shard").join(prints.select("node", "fp"), "node")
    counts = large.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftright("fp", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)])
    centre = F.lit(0).cast("long")
    for b in range(64):
        centre = centre.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("n"), F.lit((1 << b) - (1 << 64) * (b == 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    far = large.join(counts.select("shard", centre.alias("centre")), "shard").select("shard", "node", F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))).alias("far"))
    return shards.join(sizes, "shard").join(far, ["shard", "node"], "left").select("node", "shard", "size", F.coalesce("far", F.lit(0)).alias("far"))


def _links(shards: DataFrame, sets: DataFrame, similarity: float, rounds: int = ROUNDS, near: DataFrame | None = None, prints: DataFrame | None = None) -> DataFrame:
    """(u, v): each class that is linked and the least class that it is connected with over verified links; all linked pairs that share a shard are connected.

    The pairs of ``near``, whose fingerprints (``prints``) are linked, come first. Then each class meets one vantage point only,
    the most central member of its largest shard that it isn't connected with: copies share most of their
    shards, and one of these connects them. In each round after that a shard has a vantage point, the most central of the
    members that aren't connected with an earlier one, and all members that aren't connected with it are compared with it on
    their whole sets. Of the members that are left unconnected, those that share one of their rarest shingles are compared in the end (see :func:`_rest`), but for pairs
    that the triangle inequality rules out: the share of unequal shingles is a metric, so that linked members lie about
    equally far from a vantage point.
    """
    linked = F.col("common") >= F.lit(similarity) * F.col("whole")
    apart = 1 - similarity + 1e-9
    members = cut(_centred(shards, prints), "simhash-members")
    largest = members.groupBy("node").agg(F.max_by(F.struct("shard", "far"), F.struct("size", "shard")).alias("m")).select("node", "m.*")
    members, roots, used, gaps = members.drop("size"), None, None, None
    if near is not None:
        roots = _grown(None, _compared(near, sets).filter(linked).select("u", "v"))
    rooted = largest.withColumn("root", F.col("node")) if roots is None else cut(_rooted(largest, roots), "simhash-rooted")
    for k in range(rounds + 1):
        if used is None:
            rooted = rooted.withColumn("met", F.lit(False))
        else:
            known = rooted.join(used, ["shard", "node"], "left_semi").select("shard", "root").distinct().withColumn("met", F.lit(True))
            rooted = rooted.join(known, ["shard", "root"], "left").withColumn("met", F.coalesce("met", F.lit(False)))
        first = F.struct("far", F.xxhash64("node").alias("h"), "node")
        points = rooted.filter(~F.col("met")).groupBy("shard").agg(F.min_by(F.struct(F.col("node").alias("v"), F.col("root").alias("v_root")), first).alias("p")).select("shard", "p.*")
        points = cut(points, "simhash-points")
        met = cut(rooted.join(points, "shard").filter(F.col("root") != F.col("v_root")).select("shard", F.col("node").alias("u"), "v"), "simhash-met")
        seen = cut(_compared(met.select("u", "v").distinct(), sets), "simhash-seen")
        roots = _grown(roots, seen.filter(linked).select("u", "v"))
        gap = met.join(seen, ["u", "v"]).select(F.col("u").alias("node"), F.xxhash64("shard", F.lit(k)).alias("point"), (1 - F.col("common") / F.col("whole")).alias("d"))
        gaps = gap if gaps is None else gaps.union(gap)
        point = points.select("shard", F.col("v").alias("node"))
        if k:  # the first meeting was of a shard's part only
            used = point if used is None else used.union(point)
        rooted = cut(_rooted(members, roots), "simhash-rooted")
    # shards in which all members are connected are done
    open_ = rooted.groupBy("shard").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("shard")
    left = cut(rooted.join(open_, "shard").select("node", "root").distinct(), "simhash-left")
    ranked = cut(_ranked(_held(sets, cut(left.select("node").distinct(), "simhash-open"))), "simhash-ranked")
    rest = _rest(left, ranked, similarity)
    far = cut(gaps.join(left.select("node"), "node", "left_semi").groupBy("node").agg(F.map_from_entries(F.collect_set(F.struct("point", "d"))).alias("gaps")), "simhash-gaps")
    both = rest.join(far.select(F.col("node").alias("u"), F.col("gaps").alias("a")), "u", "left").join(far.select(F.col("node").alias("v"), F.col("gaps").alias("b")), "v", "left")
    ruled_out = F.exists(F.map_keys("a"), lambda point: F.abs(F.col("a")[point] - F.try_element_at("b", point)) > apart)
    rest = cut(both.filter(~F.coalesce(ruled_out, F.lit(False))).select("u", "v"), "simhash-rest")
    return _grown(roots, _compared(rest, sets).filter(linked).select("u", "v")).select(F.col("node").alias("u"), F.col("root").alias("v"))


def _rest(left: DataFrame, ranked: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the pairs of ``left`` (node, root) of unequal roots that may be similar, each once.

    In one order of all shingles, the rarest first, similar sets have one in common among the first of each: of n shingles the
    first n - similarity * n + 1. Documents that share a template only have these among what is their own. Shingles of one
    document come first in that order and are never joined. At the first shingle that two sets have in common, what they share
    is no more than what either has left of those that it shares with any other, which bounds their similarity from above;
    where they meet at a later one the bound may fail, but they have met before. The members of a shingle meet in blocks of
    ``BLOCK``, so that a frequent one is no single task's work.
    """
    rows = left.join(ranked, "node")
    first = F.col("n") - F.ceil(F.col("n") * F.lit(similarity - 1e-9)) + 1 - (F.col("n") - F.col("shared"))
    met = rows.select("node", "root", "n", "shared", F.posexplode(F.slice("rare", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("place", "shingle"))
    met = cut(met.select("node", "root", "n", (F.col("shared") - F.col("place")).alias("shared"), "shingle"), "simhash-rare")
    blocks = met.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("shingle", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    met = met.join(blocks, "shingle")
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("root", "n", "shared")]
    a = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("shingle", "block", F.col("node").alias("u"), *side("u"))
    b = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("shingle", "block", F.col("node").alias("v"), *side("v"))
    both, sizes = F.least("u_shared", "v_shared"), F.col("u_n") + F.col("v_n")
    may = (F.col("u") < F.col("v")) & (F.col("u_root") != F.col("v_root")) & (F.least("u_n", "v_n") >= F.lit(similarity) * F.greatest("u_n", "v_n"))
    may &= both >= F.lit(similarity - 1e-9) * (sizes - both)
    return a.join(b, ["shingle", "block"]).filter(may).select("u", "v").distinct()


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "shingles": [np.unique(shingle_hashes(t, words)[0]).view(np.int64) for t in batch["s_text"]]})

    return docs.select("node", "s_text").mapInPandas(run, "node string, shingles array<long>")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, text_md5, group_key, group_id) per row: documents linked by a similarity of their shingle sets share the least id.

    Texts with equal lower-cased word sequences are one class (null and wordless texts make one). Null ids are passed over
    in minima. Repeated rows stay. Other columns are left out.
    """
    signed = cut(_signatures(docs, id_col, text_col, words, BANDS, ROWS), "simhash-signatures")
    classes = cut(signed.groupBy(F.col("sequence").alias("node")).agg(F.min("s_id").alias("least"), F.min(F.struct(F.col("s_id").isNull().alias("n"), F.col("s_id").alias("i"), F.col("s_hash").alias("h"))).alias("one"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "simhash-classes")
    shards = cut(_shards(classes), "simhash-shards")
    near = cut(_fingerprint_pairs(classes), "simhash-near")
    asked = shards.select("node").union(near.select("u")).union(near.select("v")).distinct()
    wanted = cut(asked.join(classes.select("node", F.col("one.i").alias("w_id"), F.col("one.h").alias("w_hash")), "node"), "simhash-wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    # one text of each class: ids may be null or repeated with other texts, so the text's digest is compared as well
    match = (F.md5("s_text") == wanted["w_hash"]) & F.col("s_id").eqNullSafe(wanted["w_id"])
    texts = docs.select(F.col(id_col).alias("s_id"), F.col(text_col).alias("s_text")).join(few, match).select("node", "s_text")
    sets = _shingle_sets(texts, words)
    sets = cut(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "simhash-sets")
    roots = _links(shards, sets, similarity, near=near, prints=classes).select(F.col("u").alias("node"), F.col("v").alias("root"))
    joined = classes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("group_id"))
    named = cut(joined.join(least, "root").select(F.col("node").alias("sequence"), F.col("root").alias("group_key"), "group_id"), "simhash-groups")
    return signed.select(F.col("s_id").alias(id_col), F.col("s_hash").alias("text_md5"), "sequence").join(named, "sequence").select(id_col, "text_md5", "group_key", "group_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does: that of least id (nulls last), then of least text digest.

    Of rows that repeat both id and text one stays. All columns are kept.
    """
    with collected() as held:
        groups = cut(near_duplicate_groups(docs, id_col, text_col, words, similarity).withColumn("text_md5", F.coalesce("text_md5", F.lit(""))), "simhash-members")
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("text_md5").alias("t"))
    first = groups.groupBy("group_key").agg(F.min(order).alias("first"))
    twice = groups.groupBy("group_key", id_col, "text_md5").agg(F.count(F.lit(1)).alias("n"))
    gone = twice.join(first, "group_key").filter(~(F.col(id_col).eqNullSafe(F.col("first.i")) & (F.col("text_md5") == F.col("first.t"))))
    gone = cut(gone.select(F.col(id_col).alias("g_id"), F.col("text_md5").alias("g_md5")), "simhash-gone")
    all_once = twice.filter("n > 1").isEmpty()
    remove(docs.sparkSession, *held)
    match = F.col(id_col).eqNullSafe(gone["g_id"]) & (F.coalesce(F.md5(text_col), F.lit("")) == gone["g_md5"])
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, match, "left_anti")
    if all_once:
        return out
    (once,) = fresh(docs.columns, "g_row")
    kept = out.withColumn(once, F.struct(F.col(id_col), F.coalesce(F.md5(text_col), F.lit(""))))
    return kept.dropDuplicates([once]).drop(once)

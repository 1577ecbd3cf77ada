"""Benchmark decontamination through a positional inverted index, in DataFrame operations alone.

The index is a stored table of postings, one per word of the corpus: the term, the word after it, document and position.
Each task writes the postings of its own documents as a segment sorted by term, so that building it moves no data, and a
stored index serves any number of test sets. Every window of a test item (its consecutive words) is looked up from its
rarest term on: that term's postings, where the next word agrees too, are adjusted by the term's offset in the item to
a diagonal (document position minus item position) and intersected with the postings of the window's next rarest terms.
What is left is compared word by word with its document, which gives exact phrase matches. Proximity matches, all words
of a window near one another in any order, come from the positions of all its terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, collected, cut, fresh, remove, table_path

#: What counts as a word of a lower-cased text, and what lies between words.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
LISTS = 3  # posting lists that are intersected before words are compared
BROADCAST_ROWS = 500_000  # anchors, candidates and document keys of fixed width, about 50 MB; more are joined by a shuffle
BROADCAST_BYTES = 32 << 20  # hit lists
#: The columns of a stored index: hashes of term and next word, document id and hash of its text, and the position.
POSTING = ("term", "next", "p_id", "p_hash", "p_pos")
DOCUMENT = ("p_id", "p_hash")


def terms(text: Column) -> Column:
    """The words of a text. Splitting between them is much faster than extracting each; only the ends can be empty."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _hashed_terms(text: Column) -> Column:
    return F.transform(terms(text), lambda w: F.xxhash64(w))


def _of_terms(rows: DataFrame, few: DataFrame) -> DataFrame:
    """The rows whose term is one of ``few`` (written before); all rows if these are too many to broadcast."""
    return rows.join(F.broadcast(few), "term", "left_semi") if few.count() <= BROADCAST_ROWS else rows


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """The positional index of ``docs``, stored under ``path`` (a new folder of the shared one by default) and read back.

    A null or wordless text has no postings; null ids are allowed, as a document is known by its id and a hash of its text.
    Rows that repeat both repeat their postings, which changes no match. An empty table gives an empty index. The
    stored table can be read again by ``spark.read.parquet`` and handed to :func:`phrase_matches`. With ``only`` (term,
    written before) it is for one look-up of these terms; it then lacks other terms' postings, unless the wanted ones are very many.
    """
    path = path or table_path(docs.sparkSession, "decon-index")
    hashed = _hashed_terms(F.col("p_text"))
    rows = docs.select(F.col(f"`{id_col}`").alias("p_id"), F.col(f"`{text_col}`").alias("p_text"))
    rows = rows.select("p_id", F.xxhash64("p_text").alias("p_hash"), hashed.alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("term"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("next"))
    postings = rows.select("p_id", "p_hash", F.posexplode(pairs).alias("p_pos", "x")).select("x.term", "x.next", *DOCUMENT, "p_pos")
    postings = postings if only is None else _of_terms(postings, only)
    postings.sortWithinPartitions("term").write.parquet(path)
    return docs.sparkSession.read.schema(postings.schema).parquet(path)


def document_lengths(index: DataFrame) -> DataFrame:
    """(p_id, p_hash, p_words): the words of every document that has any; the last one has no next word."""
    return index.filter("next is null").select(*DOCUMENT, (F.col("p_pos") + 1).alias("p_words")).distinct()


def test_items(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """b_item (60 bits of a digest of id and words), item_id, words and their number, one row per distinct item with words."""
    items = bench.select(F.col(f"`{item_col}`").alias("item_id"), terms(F.col(f"`{text_col}`")).alias("b_words")).filter(F.size("b_words") > 0)
    digest = F.md5(F.concat_ws(" ", F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.array_join("b_words", " ")))
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return items.withColumns({"b_item": key, "b_size": F.size("b_words")}).dropDuplicates(["b_item"])


def windows(items: DataFrame, words: DataFrame, window: int) -> DataFrame:
    """(b_item, start, near) of the windows that may occur: near has (n, term, a_pos, next) of each word, the rarest first.

    ``words`` has a row with its term for each word of the corpus, as an index does; words that no item has may be missing. Frequencies are those of the whole corpus, summed within tasks before they meet. A window with a word that the corpus
    lacks is left out.
    """
    flat = items.select("b_item", "b_size", F.posexplode(F.transform("b_words", lambda w: F.xxhash64(w))).alias("a_pos", "term"))
    wanted = flat.select("term").distinct()
    frequencies = words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(wanted, "term")
    flat = flat.join(frequencies, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ordered = Window.partitionBy("b_item").orderBy("a_pos")
    flat = flat.withColumn("next", F.lead("term").over(ordered))
    near = F.sort_array(F.collect_list(F.struct("n", "term", "a_pos", "next")).over(ordered.rowsBetween(0, window - 1)))
    starts = flat.withColumn("near", near).filter(F.col("a_pos") <= F.greatest(F.col("b_size") - window, F.lit(0)))
    return starts.filter(F.col("near")[0]["n"] > 0).select("b_item", F.col("a_pos").alias("start"), "near")


def _met(index: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Postings joined with rows of fixed width that were written; the index doesn't move if they are few."""
    return index.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on)


def anchors_of(items: DataFrame, words: DataFrame, window: int, lists: int = LISTS) -> DataFrame:
    """(b_item, term, a_pos, a_next, others), written: the ``lists`` rarest terms of each window, whose postings are to be intersected.

    The first list is that of the rarest word but the window's last, so that the word after it belongs to the window, too.
    """
    found = windows(items, words, window).withColumn("last", F.col("start") + F.size("near") - 1)
    found = found.withColumn("first", F.filter("near", lambda x: (x["a_pos"] < F.col("last")) | (F.size("near") == 1))[0])
    others = F.filter("near", lambda x: (x["a_pos"] < F.col("first.a_pos")) | (x["a_pos"] > F.col("first.a_pos") + 1))
    others = F.transform(F.slice(others, 1, lists - 1), lambda x: F.struct(x["term"].alias("term"), x["a_pos"].alias("a_pos")))
    anchors = found.select("b_item", "first.term", "first.a_pos", F.when(F.size("near") > 1, F.col("first.next")).alias("a_next"), others.alias("others"))
    return cut(anchors.distinct(), "decon-anchors")


def candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(p_id, p_hash, b_item, diagonal): where the postings of a window's rarest terms (:func:`anchors_of`) meet at the right distances."""
    key = [*DOCUMENT, "b_item", "diagonal", "others"]
    rarest = _met(index, anchors, ["term"]).filter(F.col("a_next").isNull() | (F.col("next") == F.col("a_next")))
    rarest = rarest.withColumn("diagonal", F.col("p_pos") - F.col("a_pos")).select(*key).distinct()
    rarest = cut(rarest.withColumn("candidate", F.monotonically_increasing_id()), "decon-rarest")
    asked = rarest.select("candidate", *DOCUMENT, "diagonal", F.explode("others").alias("o")).select("candidate", *DOCUMENT, F.col("o.term").alias("term"), (F.col("diagonal") + F.col("o.a_pos")).alias("p_pos"))
    met = _at_places(index, cut(asked, "decon-asked")).groupBy("candidate").agg(F.count(F.lit(1)).alias("k"))
    found = rarest.join(met, "candidate", "left").filter(F.coalesce("k", F.lit(0)) == F.size("others"))
    return found.select(*key[:-1]).distinct()


def _at_places(index: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``asked`` (term, p_id, p_hash, p_pos and more, written before) that have a posting, each once."""
    few = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    there = index.select(F.col("term").alias("i_term"), F.col("p_id").alias("i_id"), F.col("p_hash").alias("i_hash"), F.col("p_pos").alias("i_pos"))
    same = (there["i_term"] == asked["term"]) & (there["i_pos"] == asked["p_pos"]) & (there["i_hash"] == asked["p_hash"]) & there["i_id"].eqNullSafe(asked["p_id"])
    return there.join(few, same).select(*asked.columns).distinct()


def _matching(rows: DataFrame, id_col: str, hash_col: str, other: DataFrame) -> Column:
    return rows[hash_col].eqNullSafe(other["p_hash"]) & rows[f"`{id_col}`"].eqNullSafe(other["p_id"])


def phrase_hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW, index: DataFrame | None = None) -> DataFrame:
    """(p_id, p_hash, d_items, d_hits) of the documents in which a window of an item occurs.

    Documents are known by their id and the hash of their text. d_items are the distinct items that occur, d_hits the hit
    word positions from 0. ``index`` is that of ``docs``, if it is stored already; without it the items' words are counted in
    the texts, and an index is made of those terms only whose postings are looked up. Only texts of candidates are compared.
    """
    items = cut(test_items(bench, item_col, bench_text_col), "decon-items")
    if index is not None:
        anchors = anchors_of(items, index, window)
    else:
        own = cut(items.select(F.explode(F.transform("b_words", lambda w: F.xxhash64(w))).alias("term")).distinct(), "decon-wanted")
        words = docs.select(F.explode(_hashed_terms(F.col(f"`{text_col}`"))).alias("term"))
        anchors = anchors_of(items, _of_terms(words, own), window)
        looked_up = anchors.select("term").union(anchors.select(F.explode("others.term")))
        index = build_index(docs, id_col, text_col, only=cut(looked_up.distinct(), "decon-terms"))
    found = candidates(index, anchors).groupBy(*DOCUMENT, "b_item").agg(F.collect_list("diagonal").alias("diagonals"))
    found = cut(found.join(items.select("b_item", "item_id", "b_words"), "b_item").drop("b_item"), "decon-candidates")
    keys = cut(found.select(*DOCUMENT).distinct(), "decon-keys")
    few = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    texts = docs.select(F.col(f"`{id_col}`").alias("t_id"), F.col(f"`{text_col}`").alias("t_text")).withColumn("t_hash", F.xxhash64("t_text"))
    texts = texts.join(few, _matching(texts, "t_id", "t_hash", keys)).select(*DOCUMENT, "t_text").dropDuplicates([*DOCUMENT])
    listed = found.groupBy(*DOCUMENT).agg(F.collect_list(F.struct("item_id", F.col("b_words").alias("words"), "diagonals")).alias("found"))
    texts = texts.withColumnsRenamed({"p_id": "t_id", "p_hash": "t_hash"})
    rows = texts.join(listed, _matching(texts, "t_id", "t_hash", listed)).select(*DOCUMENT, "t_text", "found")
    # the generator keeps the optimiser from repeating the split for every word that is compared
    rows = rows.withColumn("words", F.explode(F.array(terms(F.col("t_text")))))

    def hits(c: Column) -> Column:
        n = F.size(c["words"])
        length = F.least(n, F.lit(window))

        def on(diagonal: Column) -> Column:
            same = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(diagonal + i >= 0, F.get(F.col("words"), diagonal + i) == F.get(c["words"], i)))
            starts = F.filter(F.sequence(F.lit(0), n - length), lambda j: F.forall(F.slice(same, j + 1, length), lambda x: F.coalesce(x, F.lit(False))))
            return F.flatten(F.transform(starts, lambda j: F.sequence(diagonal + j, diagonal + j + length - 1)))

        return F.array_distinct(F.flatten(F.transform(c["diagonals"], on)))

    checked = F.filter(F.transform("found", lambda c: F.struct(c["item_id"].alias("item_id"), hits(c).alias("at"))), lambda c: F.size(c["at"]) > 0)
    rows = rows.select(*DOCUMENT, checked.alias("checked")).filter(F.size("checked") > 0)
    return rows.select(*DOCUMENT, F.array_distinct(F.transform("checked", lambda c: c["item_id"])).alias("d_items"), F.array_distinct(F.flatten(F.transform("checked", lambda c: c["at"]))).alias("d_hits"))


def phrase_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW, index: DataFrame | None = None) -> DataFrame:
    """``docs`` with d_words (number of words), d_items (the distinct items that occur) and d_hits (hit word positions, from 0).

    A window is ``window`` consecutive words of an item, or all of a shorter item. All rows of ``docs`` stay, repeated rows
    too. Null or wordless texts have no words and no hits; null or wordless items never occur; items equal in id and words
    count once; a null item id is listed as null. Null document ids are allowed, as documents are known by id and
    a hash of their text. Columns of ``docs`` named like an added one are replaced, all others stay whatever they are
    called. Empty tables on either side give no hits.
    """
    index = build_index(docs, id_col, text_col) if index is None else index
    hits = cut(phrase_hits(docs, bench, id_col, text_col, item_col, bench_text_col, window, index), "decon-hits")
    keep = [c for c in docs.columns if c not in {"d_words", "d_items", "d_hits"}]
    digest, *names = fresh([*keep, "d_words", "d_items", "d_hits"], "d_hash", "h_id", "h_hash", "l_id", "l_hash", "l_words")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64(f"`{text_col}`").alias(digest))
    size = hits.agg(F.coalesce(F.sum(F.lit(64) + 4 * F.size("d_hits") + 64 * F.size("d_items")), F.lit(0))).first()[0]
    same = lambda i, h: F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & F.col(digest).eqNullSafe(F.col(h))
    hits = hits.select(F.col("p_id").alias(names[0]), F.col("p_hash").alias(names[1]), "d_items", "d_hits")
    rows = rows.join(F.broadcast(hits) if size <= BROADCAST_BYTES else hits, same(*names[:2]), "left")
    lengths = document_lengths(index).toDF(*names[2:])
    rows = rows.join(lengths, same(*names[2:4]), "left")
    kind = hits.schema["d_items"].dataType.simpleString()
    return rows.select(
        *[F.col(f"`{c}`") for c in keep],
        F.coalesce(names[4], F.lit(0)).alias("d_words"),
        F.coalesce("d_items", F.array().cast(kind)).alias("d_items"),
        F.coalesce("d_hits", F.array().cast("array<int>")).alias("d_hits"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents in which a window of a test item occurs; see :func:`phrase_matches`."""
    with collected() as held:
        hits = phrase_hits(docs, bench, id_col, text_col, **options).select(*DOCUMENT)
    gone = cut(hits, "decon-gone")
    remove(docs.sparkSession, *held)
    (digest,) = fresh([*docs.columns, *DOCUMENT], "d_hash")
    rows = docs.withColumn(digest, F.xxhash64(f"`{text_col}`"))
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, _matching(rows, id_col, digest, gone), "left_anti").drop(digest)


def proximity_matches(index: DataFrame, bench: DataFrame, item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW, within: int = 2 * WINDOW) -> DataFrame:
    """(p_id, p_hash, item_id, b_item, start, at): where all words of an item's window stand among ``within`` consecutive words.

    The words may come in any order, with others between them; a word that the window repeats needs to be there once.
    ``start`` is the window's place in the item, ``at`` the least document position of such a stretch that begins with a
    word of the window. Postings of the window's rarest word come first; those of its other words are only looked up in the
    same documents and within reach of it. Null and wordless items never occur; empty tables give no rows.
    """
    items = cut(test_items(bench, item_col, bench_text_col), "decon-items")
    found = windows(items, index, window).withColumn("all", F.array_distinct(F.transform("near", lambda x: x["term"])))
    anchors = cut(found.select("b_item", "start", F.col("near")[0]["term"].alias("term"), "all").distinct(), "decon-anchors")
    rarest = _met(index, anchors, ["term"]).select(*DOCUMENT, "b_item", "start", "all", F.col("p_pos").alias("centre"))
    asked = cut(rarest.withColumn("term", F.explode("all")).distinct(), "decon-asked")
    few = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    there = index.select(F.col("term").alias("i_term"), F.col("p_id").alias("i_id"), F.col("p_hash").alias("i_hash"), F.col("p_pos").alias("i_pos"))
    same = (there["i_term"] == asked["term"]) & (there["i_hash"] == asked["p_hash"]) & there["i_id"].eqNullSafe(asked["p_id"]) & (F.abs(there["i_pos"] - asked["centre"]) < within)
    key = [*DOCUMENT, "b_item", "start", "centre"]
    near = there.join(few, same).groupBy(*key).agg(F.first("all").alias("all"), F.sort_array(F.collect_set(F.struct("i_pos", "i_term"))).alias("found"))
    full = lambda p: F.size(F.array_distinct(F.transform(F.filter("found", lambda x: (x["i_pos"] >= p) & (x["i_pos"] < p + within)), lambda x: x["i_term"]))) == F.size("all")
    at = F.transform(F.filter("found", lambda x: (x["i_pos"] <= F.col("centre")) & full(x["i_pos"])), lambda x: x["i_pos"])
    out = near.select(*DOCUMENT, "b_item", "start", F.array_min(at).alias("at")).filter(F.col("at").isNotNull())
    out = out.groupBy(*DOCUMENT, "b_item", "start").agg(F.min("at").alias("at"))
    return out.join(items.select("b_item", "item_id"), "b_item").select(*DOCUMENT, "item_id", "b_item", "start", "at")

"""Benchmark decontamination over a distributed positional inverted index [native].

1. Test terms: the words of the benchmark items, with their counts over all
   training documents (partial sums before the shuffle).
2. For each window of ``window`` item words, its rarest terms are its anchors. A
   window with a term that no document has cannot occur and is dropped.
3. Postings (document, position) of the anchor terms are stored. A posting of a
   term at item position p means alignment ``position - p``; intersecting the
   offset-adjusted lists leaves alignments on which two anchors agree.
4. The words along each alignment are compared: runs of a whole window are exact
   phrase matches.
5. Proximity matches need no equal window. An item is near where all but
   one of a window's words (all in windows of one or two) stand in the document, each
   shifted against the others by at most a slop. Such a window keeps all but one of
   its anchors, here the four rarest words of each window among those that do occur:
   where these align within the slop, the words around are counted. No near item is
   lost.

Nulls: a null text has no words. Items and documents without words match
nothing. An item shorter than the window is one window. Items are distinct
(id, text) pairs, so repeated items count once; repeated documents each get
their row. Null ids are ids like others, but a null item id is not listed. Of
equally rare terms the first in the item is the anchor. An empty table of
documents gives an empty result, one of items contaminates nothing. Very long
texts are read whole. Of the documents only the id and text columns are read;
further columns, whatever their names, change nothing, and
:func:`drop_contaminated` returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_BYTES, fits, small, stored, word_array

WINDOW = 10
ANCHORS = 2
SLOP = 12
NEAR_ANCHORS = 4
#: Parts into which the rows of one item or word are dealt where items or words don't fit a broadcast.
SALT = 32


def _items(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(ikey, item_id, iwords, w): distinct items with words; w is the window's length."""
    plain = items.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).distinct()
    split = plain.select("item_id", word_array(F.col("t")).alias("iwords")).filter(F.size("iwords") > 0)
    keyed = split.select(F.monotonically_increasing_id().alias("ikey"), "item_id", "iwords", F.least(F.lit(window), F.size("iwords")).alias("w"))
    return stored(keyed, "items")


def _tokens(docs: DataFrame, *cols: str) -> DataFrame:
    return docs.select(*cols, F.posexplode("words").alias("pos", "term"))


def _with_terms(rows: DataFrame, terms: DataFrame, how: str) -> DataFrame:
    """``rows`` (with ``pos``) joined with stored ``terms`` on term; where these don't fit a broadcast a frequent word is dealt to SALT tasks."""
    if fits(terms):
        return rows.join(F.broadcast(terms), "term", how)
    salted = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod("pos", F.lit(SALT))).join(salted, ["term", "_salt"], how).drop("_salt")


def _rated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(ikey, w, r): the item's words as (n, ipos, term), n the count over all documents."""
    terms = stored(items.select("ikey", F.posexplode("iwords").alias("ipos", "term")), "terms")
    vocabulary = stored(terms.select("term").distinct(), "vocabulary")
    words = docs.select(F.explode("words").alias("term"))
    # Where the vocabulary isn't broadcast, words are counted first, so that a frequent one moves one row a task.
    known = words.join(F.broadcast(vocabulary), "term", "left_semi") if fits(vocabulary) else words
    counts = known.groupBy("term").agg(F.count("*").alias("n"))
    rated = terms.join(counts, "term", "left").groupBy("ikey").agg(
        F.array_sort(F.collect_list(F.struct("ipos", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "term"))).alias("a")
    )
    by_count = F.transform("a", lambda x: F.struct(x["n"].alias("n"), x["ipos"].alias("ipos"), x["term"].alias("term")))
    return rated.join(items.select("ikey", "w"), "ikey").select("ikey", "w", by_count.alias("r"))


def _with_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``rows`` joined with ``items`` on ikey, however many rows one item has.

    Items proven to fit are broadcast. Larger ones meet in a shuffle, each in SALT
    copies, so that the rows of one item are dealt to as many tasks.
    """
    words = [c for c in items.columns if c == "iwords"]
    size = F.lit(64) + (F.aggregate(words[0], F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w) + 16) if words else 0)
    if (items.agg(F.sum(size)).first()[0] or 0) <= MAX_BROADCAST_BYTES:
        return rows.join(F.broadcast(items), "ikey")
    salted = items.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("id", "th"), F.lit(SALT)).cast("int")).join(salted, ["ikey", "_salt"]).drop("_salt")


def _chosen(rated: DataFrame, rarest: Column) -> DataFrame:
    chosen = rated.select("ikey", F.explode(F.array_distinct(F.flatten(rarest))).alias("x"))
    return stored(chosen.select(F.col("x.term").alias("term"), "ikey", F.col("x.ipos").alias("ipos")), "anchors")


def _windows() -> Column:
    return F.transform(F.sequence(F.lit(0), F.size("r") - F.col("w")), lambda s: F.slice("r", s + 1, F.col("w")))


def _other(w: Column) -> Column:
    """How many words of a near window may be missing."""
    return F.when(w < 3, 0).otherwise(1)


def anchors(docs: DataFrame, items: DataFrame, per_window: int) -> DataFrame:
    """(term, ikey, ipos): the rarest terms of each window that may occur."""
    rarest = F.transform(_windows(), lambda x: F.slice(F.array_sort(x), 1, per_window))
    return _chosen(_rated(docs, items), F.filter(rarest, lambda x: x[0]["n"] > 0))


def near_anchors(docs: DataFrame, items: DataFrame, per_window: int) -> DataFrame:
    """(term, ikey, ipos): of each window that may be near, the rarest terms that some document has."""
    present = F.transform(_windows(), lambda x: F.filter(x, lambda y: y["n"] > 0))
    present = F.filter(present, lambda x: F.size(x) >= F.col("w") - _other(F.col("w")))
    return _chosen(_rated(docs, items), F.transform(present, lambda x: F.slice(F.array_sort(x), 1, per_window)))


def index_postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, term, pos) of the given terms, stored: the positional index."""
    return stored(_with_terms(_tokens(docs, "id", "th"), stored(terms.select("term").distinct(), "keys"), "left_semi"), "postings")


def alignments(postings: DataFrame, anchor: DataFrame) -> DataFrame:
    """(id, th, ikey, diag, ipos): each posting moved back by its place in the item."""
    hit = _with_terms(postings, anchor, "inner")
    return hit.select("id", "th", "ikey", (F.col("pos") - F.col("ipos")).alias("diag"), "ipos")


def exact_phrases(docs: DataFrame, items: DataFrame, aligned: DataFrame, per_window: int) -> DataFrame:
    """(id, th, item_id, covered): document positions inside occurrences of the item's windows."""
    kept = aligned.groupBy("id", "th", "ikey", "diag").agg(F.count("*").alias("n"))
    kept = _with_items(kept, items.select("ikey", "w", F.size("iwords").alias("len")))
    kept = kept.filter(F.col("n") >= F.least(F.lit(per_window), F.col("w")))
    by_doc = kept.groupBy("id", "th").agg(F.collect_set(F.struct("ikey", "diag", "len")).alias("c"))
    by_doc = stored(by_doc, "candidates")
    same = docs["id"].eqNullSafe(by_doc["id"]) & (docs["th"] == by_doc["th"])
    # The words along each alignment; what lies outside the document is null.
    along = F.transform(
        "c",
        lambda x: F.struct(
            x["ikey"].alias("ikey"),
            x["diag"].alias("diag"),
            F.slice("words", F.greatest(x["diag"] + 1, F.lit(1)), F.greatest(x["len"] + F.least(x["diag"], F.lit(0)), F.lit(0))).alias("dwords"),
        ),
    )
    pairs = docs.join(by_doc, same).select(docs["id"], docs["th"], F.explode(along).alias("x")).select("id", "th", "x.*").distinct()
    pairs = _with_items(pairs, items)
    skip = F.greatest(-F.col("diag"), F.lit(0))
    equal = F.transform("dwords", lambda d, i: d.eqNullSafe(F.get("iwords", i + skip)))
    pairs = pairs.withColumn("eq", equal).filter(F.size("eq") >= F.col("w"))
    runs = F.filter(F.sequence(F.lit(0), F.size("eq") - F.col("w")), lambda s: ~F.exists(F.slice("eq", s + 1, F.col("w")), lambda x: ~x))
    pairs = pairs.withColumn("runs", runs).filter(F.size("runs") > 0)
    first = F.greatest(F.col("diag"), F.lit(0))
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda s: F.sequence(first + s, first + s + F.col("w") - 1))))
    return pairs.select("id", "th", "item_id", covered.alias("covered"))


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), word_array(F.col(text_col)).alias("words"))


def near_candidates(docs: DataFrame, items: DataFrame, slop: int) -> DataFrame:
    """(id, th, c), stored: per document the (ikey, base, len) where anchors of one window align within ``slop``.

    The words of a near window stand on alignments from ``base`` to ``base + 3 * slop``.
    """
    anchor = near_anchors(docs, items, NEAR_ANCHORS)
    aligned = alignments(index_postings(docs, anchor), anchor)

    # Alignments that agree within the slop meet in the cell of the least of them.
    width = slop + 1
    cell = F.floor(F.col("diag") / width)
    need = F.least(F.lit(NEAR_ANCHORS), F.col("w")) - _other(F.col("w"))
    # Most documents have too few anchors of an item anywhere: one row an anchor shows that, before any goes to two cells.
    met = aligned.groupBy("id", "th", "ikey").agg(F.collect_list(F.struct("diag", "ipos")).alias("xs"))
    met = _with_items(met, items.select("ikey", "w", F.size("iwords").alias("len"))).withColumn("need", need)
    met = met.filter(F.size(F.array_distinct(F.transform("xs", lambda x: x["ipos"]))) >= F.col("need"))
    placed = met.select("id", "th", "ikey", "w", "len", "need", F.explode(F.array_distinct("xs")).alias("x")).withColumn("diag", F.col("x.diag"))
    hits = placed.select("id", "th", "ikey", "w", "len", "need", "x", F.explode(F.array(cell - 1, cell)).alias("cell"))
    hits = hits.groupBy("id", "th", "ikey", "cell").agg(F.collect_set("x").alias("h"), F.first("w").alias("w"), F.first("len").alias("len"), F.first("need").alias("need"))
    hits = hits.filter(F.size("h") >= F.col("need"))
    lows = F.filter(F.array_distinct(F.transform("h", lambda x: x["diag"])), lambda d: F.floor(d / width) == F.col("cell"))
    bands = F.transform(lows, lambda d: F.array_sort(F.array_distinct(F.transform(F.filter("h", lambda x: (x["diag"] >= d) & (x["diag"] <= d + slop)), lambda x: x["ipos"]))))

    def close(places: Column) -> Column:
        """Whether some of the lists of places hold enough of one window."""
        return F.exists(
            F.filter(places, lambda b: F.size(b) >= F.col("need")),
            lambda b: F.exists(F.sequence(F.lit(0), F.size(b) - F.col("need")), lambda k: F.get(b, k + F.col("need") - 1) - F.get(b, k) < F.col("w")),
        )

    every = F.array(F.array_sort(F.array_distinct(F.transform("h", lambda x: x["ipos"]))))
    found = hits.filter(close(every) & close(bands)).select("id", "th", F.struct("ikey", (F.col("cell") * width - slop).cast("int").alias("base"), "len").alias("x"))
    return stored(found.groupBy("id", "th").agg(F.collect_set("x").alias("c")), "near_candidates")


def near_items(docs: DataFrame, items: DataFrame, slop: int) -> DataFrame:
    """(id, th, item_id, n, covered): n words of one window of the item, enough of them, stand within ``slop`` of one alignment.

    ``covered`` are the document's places inside windows that stand there whole: an
    exact phrase is near as well, with all its words on one alignment.
    """
    by_doc = near_candidates(docs, items, slop)
    size = by_doc.agg(F.sum(F.lit(64) + 16 * F.size("c"))).first()[0] or 0
    by_doc = F.broadcast(by_doc) if size <= MAX_BROADCAST_BYTES else by_doc  # else the texts are dealt by document
    same = docs["id"].eqNullSafe(by_doc["id"]) & (docs["th"] == by_doc["th"])
    around = F.transform(
        "c",
        lambda x: F.struct(
            x["ikey"].alias("ikey"),
            x["base"].alias("base"),
            F.slice("words", F.greatest(x["base"] + 1, F.lit(1)), F.greatest(x["len"] + 3 * slop + F.least(x["base"], F.lit(0)), F.lit(0))).alias("dwords"),
        ),
    )
    pairs = docs.join(by_doc, same).select(docs["id"], docs["th"], F.explode(around).alias("x")).select("id", "th", "x.*").distinct()
    pairs = _with_items(pairs, items)

    # For each word of the item the shifts, from base on, at which the document has it.
    skip = F.least(F.col("base"), F.lit(0))
    shifts = F.transform("iwords", lambda x, p: F.filter(F.sequence(F.lit(0), F.lit(3 * slop)), lambda k: F.get("dwords", p + skip + k) == x))
    starts = F.sequence(F.lit(0), F.size("iwords") - F.col("w"))

    def most(met: Column) -> Column:
        """The largest number of words of one window that are met."""
        # In an array of its own, so that it isn't worked out again for each start.
        counts = F.transform(F.array(met), lambda m: F.transform(starts, lambda s: F.size(F.filter(F.slice(m, s + 1, F.col("w")), lambda x: x))))
        return F.array_max(F.get(counts, F.lit(0)))

    enough = F.col("w") - _other(F.col("w"))
    pairs = pairs.withColumn("at", shifts).filter(most(F.transform("at", lambda a: F.size(a) > 0)) >= enough)
    lows = F.filter(F.array_distinct(F.flatten("at")), lambda k: k <= 2 * slop)
    best = F.array_max(F.transform(lows, lambda g: most(F.transform("at", lambda a: F.exists(a, lambda k: (k >= g) & (k <= g + slop))))))
    near = pairs.withColumn("n", best).filter(F.col("n") >= enough)
    # Alignments on which all words of a window stand, and the places of these words.
    whole = F.transform(
        F.array_distinct(F.flatten("at")),
        lambda k: F.transform(
            F.filter(starts, lambda s: F.forall(F.slice("at", s + 1, F.col("w")), lambda a: F.array_contains(a, k))),
            lambda s: F.sequence(F.col("base") + k + s, F.col("base") + k + s + F.col("w") - 1),
        ),
    )
    covered = F.array_distinct(F.flatten(F.flatten(whole)))
    return near.select("id", "th", "item_id", "n", covered.alias("covered"))


def proximity_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """(id, item_id, n_near): documents that have n_near words of a window of the item, all but a few, within ``slop`` of one alignment."""
    near = near_items(_prepared(docs, id_col, text_col), _items(items, item_col, "text", window), slop).drop("covered")
    return near.groupBy(F.col("id").alias(id_col), "item_id").agg(F.max("n").alias("n_near"))


def near_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document what :func:`report` gives and n_near (most words of one window), n_near_items, their digest, near: both from one index."""
    prepared = _prepared(docs, "doc_id", "text")
    found = near_items(prepared, _items(items, "item_id", "text", WINDOW), SLOP)
    whole = F.size("covered") > 0
    per_doc = found.groupBy("id", "th").agg(
        F.max("n").alias("n"), F.collect_set("item_id").alias("near_items"), F.collect_set(F.when(whole, F.col("item_id"))).alias("items"),
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).cast("long").alias("n_hit"),
    )
    per_doc = stored(per_doc, "near")
    base = prepared.select("id", "th", F.size("words").cast("long").alias("n_words"))
    same = base["id"].eqNullSafe(per_doc["id"]) & (base["th"] == per_doc["th"])
    zero = F.lit(0).cast("long")
    listed = lambda c: F.sha2(F.coalesce(F.concat_ws(",", F.array_sort(F.transform(c, lambda x: x.cast("string")))), F.lit("")), 256)
    n_hit = F.coalesce("n_hit", zero)
    return base.join(per_doc, same, "left").select(
        base["id"].alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items").cast("long"), zero).alias("n_items"), listed("items").alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce(F.col("n").cast("long"), zero).alias("n_near"), F.coalesce(F.size("near_items").cast("long"), zero).alias("n_near_items"), listed("near_items").alias("near_items_sha256"), F.col("n").isNotNull().alias("near"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Per document: id, th, n_words, hits (covered positions) and items (their ids)."""
    prepared = _prepared(docs, id_col, text_col)
    kept = _items(items, item_col, "text", window)
    anchor = anchors(prepared, kept, ANCHORS)
    aligned = alignments(index_postings(prepared, anchor), anchor)
    found = exact_phrases(prepared, kept, aligned, ANCHORS)
    per_doc = found.groupBy("id", "th").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).cast("long").alias("n_hit"), F.collect_set("item_id").alias("items")
    )
    per_doc = stored(per_doc, "hits")
    base = prepared.select("id", "th", F.size("words").cast("long").alias("n_words"))
    same = base["id"].eqNullSafe(per_doc["id"]) & (base["th"] == per_doc["th"])
    return base.join(per_doc, same, "left").select(
        base["id"].alias(id_col), base["th"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast(per_doc.schema["items"].dataType)).alias("items")
    )


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest of :func:`decontaminate`."""
    listed: Column = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return decontaminate(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs."""
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    i, t = (docs.columns.index(c) for c in ("doc_id", "text"))
    bad = decontaminate(plain, items, f"_c{i}", f"_c{t}").filter("n_hit > 0").select(F.col(f"_c{i}").alias("_id"), F.col("th").alias("_th"))
    same = plain[f"_c{i}"].eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(plain[f"_c{t}"], F.lit(""))) == F.col("_th"))
    bad = stored(bad.distinct(), "contaminated")
    return plain.join(small(bad, bad.count(), 48), same, "left_anti").toDF(*docs.columns)

"""Similarity join on word shingles with Bayesian pruning of MinHash comparisons.

Two texts are linked if the Jaccard similarity of their sets of five-word
shingles is at least 0.8. Texts with the same words are one class; links are
between classes, and copies are never paired with each other.

1. Each text gets 216 MinHash values. Bands of six values are bucket keys: two
   texts at 0.8 share none of 36 with probability 2e-5, more similar ones less.
2. Classes that share a bucket are candidates; of buckets with equal members one
   is kept. A bucket is compared in blocks, so that no task holds more than two.
   A pair belongs to the first bucket that it shares.
3. Pairs are compared a few MinHash values at a time. With ``m`` of ``n`` equal,
   the similarity has the posterior Beta(m + 1, n - m + 1); a pair whose chance
   of reaching the threshold is below ``tolerance`` is dropped. Classes with no
   pair left leave their block.
4. The pairs left are verified exactly on their shingles, in the same blocks: no
   other pairs, even if links connect them. Tasks return counts of links and what
   they connect, never pairs.

Nulls: texts without words are linked to nothing. Texts of fewer than five words
have one shingle, all their words. A null id comes after all others. Repeated
rows (same id and text) share their result. Of equal texts, and of a group, the
smallest id stands for all. An empty table gives an empty one. Very long texts
are read whole; a block holds fewer of them. Only the id and text columns are
read by :func:`join_similar`; further columns, whatever their names, change
nothing, and :func:`keep_one` returns them as they are.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach_groups, released, slices, small, stored

WORDS, SIMILARITY = 5, 0.8
BAND, BANDS = 6, 36
HASHES = BAND * BANDS
STEP = 24
TOLERANCE = 1e-6
BLOCK = 2048
#: Shingles of a block's texts, on average, beyond which blocks are smaller.
HEAVY = 1000
#: Parts into which each group is split before nodes are connected.
SPLIT = 64
LAST = (1 << 63) - 1
#: Every ASCII byte that is in no word becomes a space.
SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_rng = np.random.default_rng(12)
MULTIPLY = _rng.integers(0, 1 << 31, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.integers(0, 1 << 32, HASHES).astype(np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * A
    x = (x ^ (x >> np.uint64(29))) * B
    return x ^ (x >> np.uint64(32))


def word_list(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().translate(SPACED).split()


def shingles(words: list[bytes]) -> np.ndarray:
    """The set of shingles as sorted 64-bit names."""
    names = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = mixed(total * A + names[k : len(names) - width + 1 + k])
    return np.unique(total)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) MinHash values of non-empty sets."""
    flat = np.concatenate(sets)
    x = (mixed(flat) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((HASHES, len(sets)), np.uint32)
    for k in range(HASHES):
        np.minimum.reduceat(MULTIPLY[k] * x + ADD[k], starts, out=out[k])
    return out.T.copy()


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), 1))
    cut = values.reshape(len(values), BANDS, BAND).astype(np.uint64)
    for k in range(BAND):
        keys = mixed(keys * A + cut[:, :, k])
    return keys


def signature(values: np.ndarray) -> np.ndarray:
    """One byte of each value."""
    x = values * np.uint32(0x9E3779B1)
    return ((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(24)).astype(np.uint8)


def beta_above(a: int, b: int, t: float) -> float:
    """P(X > t) for X ~ Beta(a, b) with whole a and b: a binomial sum."""
    n = a + b - 1
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(t) + (n - j) * math.log(1 - t)) for j in range(a))


def least_matches(tolerance: float = TOLERANCE, t: float = SIMILARITY) -> list[tuple[int, int]]:
    """(n, fewest equal of n values with which a pair stays) for each step."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        out.append((n, next(m for m in range(n + 1) if beta_above(m + 1, n - m + 1, t) >= tolerance)))
    return out


def _describe(batches: Iterator[pa.RecordBatch], group: int = 256) -> Iterator[pa.RecordBatch]:
    """(id, th, cls, n, sig, keys) of each text; cls is null where there are no words."""
    for batch in batches:
        for part in slices(batch, 2, group):
            words = [word_list(t) for t in part.column(2).to_pylist()]
            rows = [i for i, w in enumerate(words) if w]
            sets = [shingles(words[i]) for i in rows]
            cls: list[int | None] = [None] * len(words)
            n, sig, keys = [0] * len(words), [None] * len(words), [None] * len(words)
            if rows:
                values = minhashes(sets)
                for i, s, g, k in zip(rows, sets, signature(values), band_keys(values).view(np.int64).tolist(), strict=True):
                    cls[i] = xxhash.xxh3_64_intdigest(b" ".join(words[i])) - (1 << 63)
                    n[i], sig[i], keys[i] = len(s), g.tobytes(), k
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(cls, pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "th", "cls", "n", "sig", "keys"]
            )


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, sh) for (cls, text); the shingles are sorted as signed numbers."""
    for part in (p for b in batches for p in slices(b, 1)):
        sets = [shingles(word_list(t)) for t in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.sort(s.view(np.int64)) for s in sets], pa.list_(pa.int64()))], names=["cls", "sh"])


def survivors(sig: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, least: list[tuple[int, int]], rows: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that pass the size bound and all posterior checks, some rows of ``left`` at a time."""
    for k in range(0, len(left), rows):
        part = left[k : k + rows]
        a, b = np.nonzero((size[part][:, None] >= SIMILARITY * size[right]) & (size[right] >= SIMILARITY * size[part][:, None]))
        if same:  # each pair once
            keep = a + k < b
            a, b = a[keep], b[keep]
        a, b = part[a], right[b]
        equal = np.zeros(len(a), np.int32)
        done = 0
        for n, need in least:
            equal += np.count_nonzero(sig[a, done:n] == sig[b, done:n], axis=1)
            keep = equal >= need
            a, b, equal, done = a[keep], b[keep], equal[keep], n
        if len(a):
            yield a, b


class Sets:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def _segments(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(order, left, right, same) of each block pair in a table with grp, i, j, blk."""
    grp, i, j, blk = (t[c].to_numpy() for c in ("grp", "i", "j", "blk"))
    order = np.lexsort((blk, j, i, grp))
    g, i, j, blk = grp[order], i[order], j[order], blk[order]
    ends = np.flatnonzero(np.r_[(g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True]) + 1 if len(g) else []
    start = 0
    for end in ends:
        places = np.arange(start, end)
        same = i[start] == j[start]
        yield order, places if same else places[blk[start:end] == i[start]], places if same else places[blk[start:end] == j[start]], bool(same)
        start = end


def _pairs(t: pa.Table, least: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of pairs that survive in their block pair, for pairs of the first bucket they share."""
    size, kept, band = (t[c].to_numpy().astype(np.int64) for c in ("n", "kept", "band"))
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
    cut, bits = sig.reshape(-1, BANDS, BAND), np.arange(BANDS)
    for order, left, right, same in _segments(t):
        left, right = order[left], order[right]
        own = band[(left if len(left) else right)[0]]
        for a, b in survivors(sig, size, left, right, same, least):
            shared = ((kept[a] & kept[b])[:, None] >> bits & 1).astype(bool) & (cut[a] == cut[b]).all(2)
            keep = shared.argmax(1) == own
            if keep.any():
                yield a[keep], b[keep]


def _prune(t: pa.Table, least: list[tuple[int, int]]) -> pa.Table:
    """The rows of ``t`` that still have a pair in their block pair."""
    alive = np.zeros(t.num_rows, bool)
    for a, b in _pairs(t, least):
        alive[a] = alive[b] = True
    return t.select(PLACE).filter(pa.array(alive))


def _verify(t: pa.Table, least: list[tuple[int, int]]) -> pa.Table:
    """(grp, i, j, root, cls, links): the exact links of each class in a block pair, and what they connect."""
    cls, size = t["cls"].to_numpy(), t["n"].to_numpy().astype(np.int64)
    sets = [np.asarray(x.values) for x in t["sh"]]
    joined, links = Sets(t.num_rows), np.zeros(t.num_rows, np.int64)
    for a, b in _pairs(t, least):
        a, b = verified(a, b, sets, size)
        joined.join(a, b)
        np.add.at(links, a, 1)
        np.add.at(links, b, 1)
    found = np.flatnonzero(links)
    roots = np.array([joined.find(int(x)) for x in found], dtype=np.int64)
    return t.select(["grp", "i", "j", "cls"]).take(pa.array(found)).append_column("root", pa.array(cls[roots])).append_column("links", pa.array(links[found]))


def verified(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose Jaccard similarity is at least 4/5, counted exactly."""
    keep = np.zeros(len(a), bool)
    ends = np.flatnonzero(np.r_[a[1:] != a[:-1], True]) + 1
    start = 0
    for end in ends:
        own = sets[a[start]]
        others = b[start:end]
        flat = np.concatenate([sets[x] for x in others])
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(np.r_[0, size[others][:-1]]))
        keep[start:end] = 9 * both >= 4 * (len(own) + size[others])
        start = end
    return a[keep], b[keep]


#: Where a class is compared: bucket, its band, blocks of the bucket, the class's block, and the pair of blocks.
PLACE = ["grp", "band", "nb", "blk", "i", "j", "cls"]


def weight(n: str = "n") -> Column:
    """What a class weighs in a block, in classes of ordinary length."""
    return F.greatest(F.lit(1.0), F.col(n) / HEAVY)


def blocks(members: DataFrame) -> DataFrame:
    """PLACE of each class of a bucket (grp, band, size, cls): rows for all block pairs that it is in; ``size`` is in weights."""
    rows = members.withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64(F.lit(5), "cls"), F.col("nb")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.select("grp", "band", "nb", "blk", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "cls")


def in_tasks(rows: DataFrame, total: float) -> DataFrame:
    """``rows`` with the task that compares them: small buckets share one, a pair of blocks has its own."""
    few = max(1, int(total) // (2 * BLOCK))
    return rows.withColumn("task", F.when(F.col("nb") == 1, F.pmod(F.xxhash64("grp"), F.lit(few))).otherwise(F.xxhash64("grp", "i", "j")))


def prune(rows: DataFrame, tolerance: float) -> DataFrame:
    least = least_matches(tolerance)
    return rows.groupBy("task").applyInArrow(lambda t: _prune(t, least), "grp long, band int, nb int, blk int, i int, j int, cls long")


def verify(rows: DataFrame, tolerance: float) -> DataFrame:
    least = least_matches(tolerance)
    return rows.groupBy("task").applyInArrow(lambda t: _verify(t, least), "grp long, i int, j int, cls long, root long, links long")


def components(members: DataFrame) -> DataFrame:
    """(node, label): the smallest node reached from each through shared groups (grp, node).

    Every group is first split into parts, and the smallest nodes of its parts
    form one more, so that no part grows as the group does. Labels then go from
    nodes to parts and back; from the second round on a label that has itself a
    smaller label gives way to that, which halves long chains. Every round is
    stored. Labels only fall, so rounds go on until none changes.
    """
    part = F.pmod(F.xxhash64("node"), F.lit(SPLIT)).cast("int")
    split = members.select("grp", "node", part.alias("part"))
    tops = split.groupBy("grp", "part").agg(F.min("node").alias("node")).select("grp", "node", F.lit(-1).alias("part"))
    rows = split.unionByName(tops).withColumn("label", F.col("node"))
    by_part, by_node = Window.partitionBy("grp", "part"), Window.partitionBy("node")
    for turn in itertools.count():
        rows = rows.withColumn("old", F.col("label"))
        for _ in range(2):
            rows = rows.withColumn("label", F.min("label").over(by_part)).withColumn("label", F.min("label").over(by_node))
        rows = stored(rows, "labels")
        if rows.filter("label != old").isEmpty():
            break
        rows = rows.drop("old")
        if turn:
            onward = stored(rows.filter("label != node").join(rows.select(F.col("label").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("label"), F.col("label").alias("next")).distinct(), "onward")
            rows = rows.join(small(onward, onward.count(), 48), "label", "left").select("grp", "node", "part", F.coalesce("next", "label").alias("label"))
    return rows.groupBy("node").agg(F.min("label").alias("label"))


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """Per document (id, th): class_id, copy_of, n_links and n_copies.

    ``class_id`` is the smallest id among the documents connected by links or
    equal words, ``copy_of`` the smallest with the same words, ``n_links`` the
    number of other classes linked to the document's.
    """
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.coalesce(F.col(id_col), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    rows = stored(plain.mapInArrow(released(_describe), "id long, th long, cls long, n int, sig binary, keys array<long>"), "minhash")
    total = rows.count()
    named = rows.filter("cls is not null")
    reps = stored(named.groupBy("cls").agg(F.min(F.struct("id", "th")).alias("rep"), F.count("*").alias("n_copies")), "classes")
    known = stored(named.select("cls", "n", "sig", "keys").dropDuplicates(["cls"]), "signatures")

    # Buckets that several classes share, one of those with equal members.
    banded = known.select(F.posexplode("keys").alias("band", "grp"), "cls", "n")
    one, two = F.xxhash64("cls"), F.xxhash64(F.lit(1), "cls")
    shared = banded.groupBy("grp").agg(F.min("band").alias("band"), F.count("*").alias("members"), F.sum(weight()).alias("size"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y")).filter("members > 1")
    first = F.min(F.struct("grp", "band", "size")).alias("b")
    shared = stored(shared.groupBy("members", "x", "y").agg(first).select("b.grp", F.col("b.band").alias("of"), "b.size", "members"), "buckets")
    members = stored(attach_groups(banded, shared, "grp", "members", total * BANDS).select("grp", F.col("of").alias("band"), "size", "cls"), "members")
    bits = F.bit_or(F.expr("shiftleft(1L, band)")).alias("kept")
    described = stored(known.select("cls", "n", "sig").join(members.groupBy("cls").agg(bits), "cls"), "described")
    spread = stored(blocks(members), "spread")
    left = stored(prune(in_tasks(spread.join(described, "cls"), spread.count()), tolerance), "left")

    # The pairs left are verified on the shingles, read from one text of each class.
    wanted = stored(left.select("cls").distinct().join(reps, "cls").select("cls", F.col("rep.id").alias("id"), F.col("rep.th").alias("th")), "wanted")
    n_wanted = wanted.count()
    texts = plain.join(small(wanted, n_wanted, 48), ["id", "th"])
    sets = texts.select("cls", "text").mapInArrow(_shingle_rows, "cls long, sh array<long>").dropDuplicates(["cls"])
    full = left.join(described.join(sets, "cls"), "cls")
    heavy = left.join(described.select("cls", "n"), "cls").agg(F.coalesce(F.sum(weight()), F.lit(0.0))).first()[0]
    linked = stored(verify(in_tasks(full, heavy), tolerance), "linked")
    clusters = components(linked.select(F.xxhash64("grp", "i", "j", "root").alias("grp"), F.col("cls").alias("node")).distinct()).select(F.col("label").alias("cluster"), F.col("node").alias("cls"))
    clusters = stored(clusters.join(linked.groupBy("cls").agg(F.sum("links").alias("n_links")), "cls").join(reps.select("cls", F.col("rep.id").alias("own")), "cls"), "clusters")

    heads = clusters.groupBy("cluster").agg(F.min("own").alias("class_id"), F.count("*").alias("size"))
    grouped = attach_groups(clusters.select("cls", "n_links", "cluster"), heads, "cluster", "size", n_wanted).select("cls", "n_links", "class_id")
    of_class = reps.select("cls", F.col("rep.id").alias("copy_of"), "n_copies").join(grouped, "cls", "left").filter("n_copies > 1 or class_id is not null")
    found = attach_groups(rows.select("id", "th", "cls"), of_class, "cls", "n_copies", total, "left")
    own = F.coalesce("copy_of", "id")
    zero, single = (F.lit(k).cast("long") for k in (0, 1))
    return found.select("id", "th", F.coalesce("class_id", own).alias("class_id"), own.alias("copy_of"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_copies", single).alias("n_copies"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links): one row for each document."""
    plain = join_similar(docs)
    return plain.select(*[F.when(F.col(c) != LAST, F.col(c)).alias(name) for c, name in (("id", "doc_id"), ("class_id", "class_id"), ("copy_of", "copy_of"))], "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with only the document of smallest id of each group."""
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    i, t = (f"_c{docs.columns.index(c)}" for c in (id_col, text_col))
    gone = stored(join_similar(plain, i, t).filter("id != class_id").select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct(), "near")
    same = (F.coalesce(plain[i], F.lit(LAST)) == F.col("_id")) & (F.xxhash64(F.coalesce(plain[t], F.lit(""))) == F.col("_th"))
    return plain.join(small(gone, gone.count(), 48), same, "left_anti").toDF(*docs.columns)

"""Long repeated passages across documents, by recompression.

Words get 64-bit names. Rounds then recompress every text: tokens of runs are
named as run symbols and stay apart; of the others, a symbol with a "left" coin
followed by one with a "right" coin is named as a pair. Names and coins follow
from content alone, so that all tasks name alike without a dictionary to share.

Each symbol keeps its context: the words that settle, whatever surrounds them,
that it exists. A pair needs the contexts of both halves; a symbol that stays
alone that of the neighbour which could have taken it. Equal passages therefore
hold the same symbols wherever their contexts lie inside. A symbol whose context
has at most ten words lies, context and all, in each of the eleven windows of 20
words that start up to ten words before it; of the symbols that start so, a window
takes one of the highest round, there the one with the smallest name. Two equal
windows take the same. A symbol of round 0, a word with its neighbours, always is
there, so no window is without one.

1. First exchange: symbols that some window has taken, by name. A name in two
   different texts, or twice in one, reveals a repeat. Repeats within a batch are
   settled before, so a name that a third of all texts have moves one row a batch.
2. Second exchange: windows that took a repeated symbol are verified by a name of
   96 bits (names of 1, 2, 4, 8, 16 and 20 words, each a pair of shorter ones). Of
   equal windows all but the first are removed; again a batch settles its own
   repeats first.
3. Each text is cut down to the words that no removed window covers.

Copies of a whole text are found by their hash and skip the first two steps.

Nulls: a null text has no words. A null id comes after all others. Repeated rows
(same id and text) are one document and get the same result. A text of fewer
than 20 words has no window. Of equal windows that of the smallest id, there the
earliest, stays. An empty table gives an empty one. Very long texts are read whole.
Only the id and text columns are read; further columns, whatever their names,
change nothing and aren't returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach_groups, slices, stored

SPAN = 20
#: Places of a window at which the context of its symbol may start, and so the context's longest.
CHOICE = 11
CONTEXT = SPAN - CHOICE + 1
ROUNDS = 3
#: Bytes of text whose names are held at once.
SLICE = 8 << 20
LAST = (1 << 63) - 1
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of each pair of names."""
    x = (left * A) ^ ((right + C) * B)
    x ^= x >> np.uint64(29)
    x *= A
    x ^= x >> np.uint64(32)
    return x


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def recompress(names: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, start and end of their contexts) of each round from 0 on, runs in round 0 only.

    ``first`` marks the first word of each text; what lies at a text's border has
    a context beyond it.
    """
    n = len(names)
    place = np.arange(n, dtype=np.int32)
    same = np.zeros(n, dtype=bool)  # equal to the word before
    same[1:] = (names[1:] == names[:-1]) & ~first[1:]
    again = np.zeros(n, dtype=bool)  # equal to the word behind
    again[:-1] = same[1:]
    run = same | again
    # An equal word behind settles a run; else both neighbours are needed.
    lo, hi = np.where(again, place, place - 1), place + 2
    sym, joined = np.where(run, pair(names, np.array([B])), names), ~first
    yield sym, lo, hi
    for r in range(rounds):
        right = (pair(sym, np.array([r + 1], np.uint64)) & np.uint64(1)).astype(bool)
        merge = np.zeros(len(sym), dtype=bool)  # of a symbol with the one before
        merge[1:] = joined[1:] & right[1:] & ~right[:-1] & ~run[1:] & ~run[:-1]
        alone = ~run & ~merge
        alone[:-1] &= ~merge[1:]
        sym, low, high = sym.copy(), lo.copy(), hi.copy()
        x = np.flatnonzero(alone & right)  # the one before didn't take it
        y = np.maximum(x - 1, 0)
        low[x], high[x] = np.where(x > 0, np.minimum(lo[x], lo[y]), -1), np.maximum(hi[x], hi[y])
        x = np.flatnonzero(alone & ~right)  # it didn't take the one behind
        y = np.minimum(x + 1, len(sym) - 1)
        low[x], high[x] = np.minimum(lo[x], lo[y]), np.where(x + 1 < len(sym), np.maximum(hi[x], hi[y]), n + 1)
        x = np.flatnonzero(merge) - 1
        low[x], high[x], sym[x] = np.minimum(lo[x], lo[x + 1]), np.maximum(hi[x], hi[x + 1]), pair(sym[x], sym[x + 1])
        keep = ~merge
        sym, run, joined, lo, hi = sym[keep], run[keep], joined[keep], low[keep], high[keep]
        yield sym[~run], lo[~run], hi[~run]


def spread(x: np.ndarray, width: int, best, back: bool) -> np.ndarray:
    """The best of ``width`` places from each place on (or up to it), by doubling."""
    def shifted(y: np.ndarray, by: int) -> np.ndarray:
        out = y.copy()
        if back:
            out[by:] = best(y[by:], y[:-by])
        else:
            out[:-by] = best(y[:-by], y[by:])
        return out

    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        if step >= len(x):
            break
        out = shifted(out, step)
        done += step
    return out


def taken(names: np.ndarray, first: np.ndarray, left: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """By place: the name of the best symbol whose context starts there, and of the one that a window from there takes.

    ``left`` counts the words from each place to its text's end. Names of higher
    rounds are smaller, and contain the words of the context.
    """
    n = len(names)
    key = np.full(n, NEVER)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n + 1, A))
        undo = np.cumprod(np.full(n + 1, np.uint64(pow(int(A), -1, 1 << 64))))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(names * power[:n])])
        for r, (sym, lo, hi) in enumerate(recompress(names, first, rounds)):
            fits = (hi - lo <= CONTEXT) & (lo >= 0) & (hi <= n)
            fits[fits] = (hi - lo)[fits] <= left[lo[fits]]
            sym, lo, hi = sym[fits], lo[fits], hi[fits]
            words = (sums[hi] - sums[lo]) * undo[lo]
            key[lo] = (pair(sym, words) >> np.uint64(3)) | np.uint64((rounds - r) << 61)
    return key, spread(key, CHOICE, np.minimum, back=False)


def anchors(names: np.ndarray, first: np.ndarray, left: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(places, names) of the symbols that windows take."""
    if len(names) < SPAN:
        return np.zeros(0, int), np.zeros(0, np.uint64)
    key, least = taken(names, first, left, rounds)
    of_windows = np.where(left >= SPAN, least, np.uint64(0))
    chosen = np.flatnonzero((key != NEVER) & (spread(of_windows, CHOICE, np.maximum, back=True) == key))
    return chosen, key[chosen]


def windows(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two names of the window of 20 words from each place on."""
    out = []
    for seed in (np.uint64(0), C):
        x = names ^ seed
        for w in (1, 2, 4, 8):
            x = pair(x[:-w], x[w:])
        out.append(pair(x[:-4], pair(pair(names[16:-3], names[17:-2]), pair(names[18:-1], names[19:])) ^ seed))
    return out[0], out[1]


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of some texts: names, first, left, row and place within the text."""
    words = [t.encode("utf-8", "replace").split() for t in texts]
    size = np.array([len(w) for w in words], dtype=np.int64)
    names = np.concatenate([word_names(w) for w in words]) if len(words) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(words)), size)
    start = np.cumsum(size) - size
    at = np.arange(len(names)) - start[row]
    return names, at == 0, size[row] - at, row, at


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(row: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """For each of ``n`` rows the list of its places; ``row`` is sorted."""
    offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(at.astype(np.int32)))


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, th, pos) of an anchor whose name is new in the batch, or (th, done) with the repeated ones."""
    for batch in (p for b in batches for p in slices(b, 1, most=SLICE)):
        by_text = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        th = np.array(list(by_text), dtype=np.int64)
        names, first, left, row, at = _flat(list(by_text.values()))
        chosen, key = anchors(names, first, left)
        order = np.argsort(key, kind="stable")
        chosen, key = chosen[order], key[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        again = ~new
        again[:-1] |= ~new[1:]
        done = np.sort(chosen[again])
        order = np.argsort(chosen[new])  # in the order of the texts, which shuffle files compress well
        c, key = chosen[new][order], key[new][order]
        yield pa.RecordBatch.from_arrays([_signed(key), pa.array(th[row[c]]), pa.array(at[c].astype(np.int32)), pa.nulls(len(c), pa.list_(pa.int32()))], names=["key", "th", "pos", "done"])
        has = np.unique(row[done])
        settled = _lists(np.searchsorted(has, row[done]), at[done], len(has))
        yield pa.RecordBatch.from_arrays([pa.array(th[has]), pa.array(th[has]), pa.nulls(len(has), pa.int32()), settled], names=["key", "th", "pos", "done"])


def _find_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, h2, id, th, pos) of the first of equal windows in the batch, or (id, th, done) with the later ones."""
    for batch in (p for b in batches for p in slices(b, 2, most=SLICE)):
        ids, th = (batch.column(k).to_numpy() for k in (0, 1))
        names, first, left, row, at = _flat(batch.column(2).to_pylist())
        repeated = np.zeros(len(names), dtype=bool)
        begin = np.searchsorted(row, np.arange(batch.num_rows))
        for r, places in enumerate(batch.column(3)):
            repeated[np.asarray(places.values) + begin[r]] = True
        if len(names) >= SPAN:  # windows that took a repeated symbol
            key, least = taken(names, first, left)
            w = np.flatnonzero((spread(np.where(repeated, key, NEVER), CHOICE, np.minimum, back=False) == least) & (left >= SPAN))
        else:
            w = np.zeros(0, int)
        one, two = windows(names) if len(w) else (np.zeros(0, np.uint64),) * 2
        h, h2, wid = one[w], two[w].astype(np.uint32).view(np.int32), ids[row[w]]
        order = np.lexsort((at[w], wid, h2, h))
        w, h, h2, wid = w[order], h[order], h2[order], wid[order]
        new = np.ones(len(w), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        equal = (wid == wid[lead]) & (at[w] == at[w[lead]])  # the first itself, or a repeated row of it
        order = np.argsort(w[new])
        c, h, h2 = w[new][order], h[new][order], h2[new][order]
        yield pa.RecordBatch.from_arrays([_signed(h), pa.array(h2), pa.array(ids[row[c]]), pa.array(th[row[c]]), pa.array(at[c].astype(np.int32)), pa.nulls(len(c), pa.list_(pa.int32()))], names=["h", "h2", "id", "th", "pos", "done"])
        later = np.sort(w[~equal])
        has = np.unique(row[later])
        settled = _lists(np.searchsorted(has, row[later]), at[later], len(has))
        yield pa.RecordBatch.from_arrays([pa.array(th[has]), pa.nulls(len(has), pa.int32()), pa.array(ids[has]), pa.array(th[has]), pa.nulls(len(has), pa.int32()), settled], names=["h", "h2", "id", "th", "pos", "done"])


def keep_words(text: str, starts: np.ndarray, whole: bool) -> tuple[int, int, str]:
    """(n_words, n_removed, kept text) of one document."""
    words = text.encode("utf-8", "replace").split()
    if len(words) < SPAN or not (whole or len(starts)):
        return len(words), 0, b" ".join(words).decode()
    if whole:
        return len(words), len(words), ""
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.unique(starts)
    cover[starts] += 1
    cover[starts + SPAN] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone, strict=True) if not g]).decode()


def removed_windows(docs: DataFrame) -> DataFrame:
    """(th, id, starts, whole) of the documents (id, th, text) with something to remove."""
    narrow = stored(docs.select("id", "th", F.md5("text").alias("md5")), "texts")
    groups = narrow.groupBy("md5", "th").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    many = groups.filter("n > 1").select("md5", "first_id", "n")
    copies = attach_groups(narrow.select("md5", "th", "id"), many, "md5", "n", narrow.count()).filter("id > first_id").select("th", "id").distinct()

    found = docs.select("th", "text").mapInArrow(_find_anchors, "key long, th long, pos int, done array<int>")
    per_key = Window.partitionBy("key")
    place = F.struct("th", "pos")
    found = found.withColumn("lo", F.min(place).over(per_key)).withColumn("hi", F.max(place).over(per_key))
    repeated = found.filter("done is not null or lo != hi").select("th", F.coalesce("done", F.array("pos")).alias("p"))
    per_text = repeated.groupBy("th").agg(F.array_distinct(F.flatten(F.collect_set("p"))).alias("places"))
    first = groups.select("th", F.col("first_id").alias("id"))
    wanted = per_text.join(first, "th")

    rows = docs.join(wanted, ["th", "id"]).select("id", "th", "text", "places")
    seen = rows.mapInArrow(_find_windows, "h long, h2 int, id long, th long, pos int, done array<int>")
    later = F.rank().over(Window.partitionBy("h", "h2").orderBy("id", "pos"))
    gone = seen.withColumn("nth", later).filter("done is not null or nth > 1")
    starts = gone.groupBy("th", "id").agg(F.concat(F.collect_list("pos"), F.flatten(F.collect_list("done"))).alias("starts"))
    whole = copies.select("th", "id", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("whole"))
    return starts.withColumn("whole", F.lit(False)).unionByName(whole)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256), with ``keep_text`` also the kept text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.coalesce(F.col(id_col), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    gone = removed_windows(plain)
    # The same exchange of the texts serves this join and the one inside.
    rows = plain.join(gone, ["th", "id"], "left").select(F.when(F.col("id") != LAST, F.col("id")).alias("own"), "text", "starts", F.coalesce("whole", F.lit(False)).alias("whole"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        for batch in batches:
            kept = [keep_words(t.as_py(), np.asarray(s.values).astype(np.int64) if s.is_valid else none, w.as_py()) for t, s, w in zip(*batch.columns[1:], strict=True)]
            cols = [batch.column(0), pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64()), pa.array([hashlib.sha256(k[2].encode()).hexdigest() for k in kept], pa.string())]
            names = [id_col, "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                cols, names = [*cols, pa.array([k[2] for k in kept], pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)

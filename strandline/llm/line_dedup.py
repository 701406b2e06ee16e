"""Lines repeated over many documents, by range partitions and a secondary sort.

A line's key is the line without white space at its ends and with A-Z lowered. Keys
of at least ``least_chars`` code points that at least ``least_docs`` documents hold
lose all their lines but those of the largest document.

Hashes of keys, with document and position and without text, are dealt by ranges of
(hash, document downwards, position) and sorted, so the first occurrence in a stream
of them names the document that keeps its lines; a hash that a third of all lines
have is spread over many ranges. Inside a range a stream holds the rows of at most
``least_docs - 2`` documents of one hash before it is settled. A hash that may go on
beyond its range is open: the range tells how many documents of it it saw, a row
for its first and last hash. These sums, two a range, are put together; what
was open is settled by them. The result is a bitmap of kept lines a document,
compressed, for the documents that lose any; texts meet them at the end, by
broadcast if the bitmaps are small, measured, else in one join.

Ids are integers. Nulls: a null text is one empty line; a null id is the smallest
document, and all rows without id are one document. Repeated rows (same id) are one
document too and keep or lose the same lines. Empty and short lines are never
dropped. Very long texts are split whole. An empty table gives an empty result.
Keys are told apart by 128 bits of hash. Further columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_BYTES, ascii_lower, released, stored

SPACE = " \t\n\x0b\x0c\r"
#: Stands for a null id.
NO_ID = -(1 << 63)
#: Kinds of rows that a range's stream gives.
DROPPED, OPEN, SUM = 0, 1, 2
SEEN = "kind byte, h long, g long, doc long, t long, pos int, n_lines int, at int, docs long, last long"
FIELDS = [x.split()[0] for x in SEEN.split(", ")]
ARROW = pa.schema([("kind", pa.int8()), *[(c, pa.int64()) for c in ("h", "g", "doc", "t")], ("pos", pa.int32()), ("n_lines", pa.int32()), ("at", pa.int32()), ("docs", pa.int64()), ("last", pa.int64())])


def _identity(id_col: Column, text: Column) -> list[Column]:
    """A row's document and the hash of its text, so that texts under one id have bitmaps of their own."""
    return [F.coalesce(id_col.cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t")]


def long_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(h, g, doc, t, pos, n_lines) of each line whose key is long enough."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(*_identity(F.col(id_col), F.col(text_col)), F.split(text, "\n").alias("lines"))
    # A line shorter than the least key can't have one; the others are trimmed.
    each = split.select("doc", "t", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line")).filter(F.char_length("line") >= least_chars)
    keyed = each.select("doc", "t", "n_lines", "pos", ascii_lower(F.btrim(F.col("line"), F.lit(SPACE))).alias("key")).filter(F.char_length("key") >= least_chars)
    return keyed.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit("second"), "key").alias("g"), "doc", "t", "pos", "n_lines")


class _Open:
    """The hash that a stream is in: its documents so far, and rows not yet settled."""

    def __init__(self, key: tuple[int, int], doc: int, first: bool):
        self.key, self.first_doc, self.last_doc, self.from_before = key, doc, None, first
        self.docs, self.waiting = 0, []

    def take(self, rows: dict[str, np.ndarray], least: int) -> list[tuple[int, dict[str, np.ndarray]]]:
        """More rows of the hash; what they settle."""
        doc = rows["doc"]
        fresh = np.concatenate([[self.last_doc is None or doc[0] != self.last_doc], doc[1:] != doc[:-1]])
        rank = self.docs + np.cumsum(fresh)
        self.docs, self.last_doc = int(rank[-1]), int(doc[-1])
        if self.from_before:
            return [(OPEN, rows)]
        late = rank > 1
        if late.any():
            self.waiting.append({c: v[late] for c, v in rows.items()})
        return self._settled() if self.docs >= least else []

    def _settled(self, kind: int = DROPPED) -> list[tuple[int, dict[str, np.ndarray]]]:
        out, self.waiting = [(kind, w) for w in self.waiting], []
        return out

    def close(self, at: int, beyond: bool) -> list[tuple[int, dict[str, np.ndarray]]]:
        """The end of the hash, or of the range in it."""
        if not (self.from_before or beyond):
            return []
        own = {"h": self.key[0], "g": self.key[1], "doc": self.first_doc, "at": at, "docs": self.docs, "last": self.last_doc}
        return [*self._settled(OPEN), (SUM, {c: np.array([v]) for c, v in own.items()})]


def _batch(parts: list[tuple[int, dict[str, np.ndarray]]]) -> pa.RecordBatch:
    sizes = [len(rows["h"]) for _, rows in parts]
    columns = [np.repeat([kind for kind, _ in parts], sizes)]
    columns += [np.concatenate([rows.get(c, np.zeros(n, np.int64)) for (_, rows), n in zip(parts, sizes, strict=True)]) for c in FIELDS[1:]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def stream_ranges(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What sorted ranges tell: lines to drop, open lines and sums of open hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
            h, g, doc = rows["h"], rows["g"], rows["doc"]
            starts = np.concatenate([[0], np.flatnonzero((h[1:] != h[:-1]) | (g[1:] != g[:-1])) + 1])
            part = lambda a, b, rows=rows: {c: v[a:b] for c, v in rows.items()}
            out, begin = [], 0
            if state and state.key == (h[0], g[0]):
                end = starts[1] if len(starts) > 1 else len(h)
                out += state.take(part(0, end), least)
                begin = 1
            if begin < len(starts):
                if state:
                    out += state.close(at, False)
                elif len(starts) > 1:  # the first hash of the range
                    state = _Open((int(h[0]), int(g[0])), int(doc[0]), True)
                    out += [*state.take(part(0, starts[1]), least), *state.close(at, False)]
                    begin = 1
                whole = slice(starts[begin], starts[-1])
                if whole.start < whole.stop:  # hashes that begin and end in this batch
                    inside = starts[begin:-1] - whole.start
                    fresh = np.concatenate([[True], doc[whole][1:] != doc[whole][:-1]])
                    fresh[inside] = True
                    nth = np.cumsum(fresh)
                    group = np.repeat(np.arange(len(inside)), np.diff(np.append(inside, whole.stop - whole.start)))
                    before = nth[inside] - 1
                    docs = np.append(before[1:], nth[-1]) - before
                    gone = (docs[group] >= least) & (nth - before[group] > 1)
                    if gone.any():
                        out.append((DROPPED, {c: v[whole][gone] for c, v in rows.items()}))
                last = starts[-1]
                state = _Open((int(h[last]), int(g[last])), int(doc[last]), state is None)
                out += state.take(part(last, len(h)), least)
            if out:
                yield _batch(out)
        if state and (out := state.close(at, True)):
            yield _batch(out)

    return run


def _spanning(seen: DataFrame, least: int) -> DataFrame:
    """(oh, og, keeper) of the hashes whose ranges together saw enough documents; two rows a range go to the driver."""
    told: dict[tuple[int, int], list[int]] = {}
    for r in sorted(seen.filter(F.col("kind") == SUM).select("h", "g", "doc", "at", "docs", "last").collect(), key=lambda r: r["at"]):
        known = told.setdefault((r.h, r.g), [r.doc, 0, None])
        known[1] += r.docs - (known[2] == r.doc)  # a document that goes on in the next range counts once
        known[2] = r["last"]
    rows = [(h, g, keeper) for (h, g), (keeper, docs, _) in told.items() if docs >= least]
    return seen.sparkSession.createDataFrame(rows, "oh long, og long, keeper long")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, t, n_lines, gone = batch.columns
        counts, keeps = [], []
        for n, places in zip(n_lines.to_pylist(), gone, strict=True):
            keep = np.ones(n, bool)
            keep[places.values.to_numpy()] = False
            counts.append(n - int(keep.sum()))
            keeps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([doc, t, n_lines.cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(keeps, pa.binary())], names=["doc", "t", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """(doc, t, n_lines, n_dropped, keep) of the documents that lose lines.

    ``doc`` and ``t`` are the id (the least long for null) and the xxhash64 of the
    text; ``keep`` is a zlib-compressed bitmap, first line first, highest bit first.
    """
    lines = stored(long_lines(docs, id_col, text_col, least_chars), "lines")
    order = [F.col("h").asc(), F.col("g").asc(), F.col("doc").desc(), F.col("t").asc(), F.col("pos").asc()]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    seen = stored(ranged.mapInArrow(released(stream_ranges(least_docs)), SEEN), "seen")
    spanning = _spanning(seen, least_docs)
    same = (F.col("h") == F.col("oh")) & (F.col("g") == F.col("og")) & (F.col("doc") != F.col("keeper"))
    settled = seen.filter(F.col("kind") == OPEN).join(F.broadcast(spanning), same).select("doc", "t", "pos", "n_lines")
    dropped = seen.filter(F.col("kind") == DROPPED).select("doc", "t", "pos", "n_lines").unionAll(settled)
    places = dropped.groupBy("doc", "t").agg(F.max("n_lines").alias("n_lines"), F.collect_list("pos").alias("gone")).select("doc", "t", "n_lines", "gone")
    return places.mapInArrow(_bitmaps, "doc long, t long, n_lines long, n_dropped long, keep binary")


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, least_chars: int, least_docs: int) -> DataFrame:
    """``docs`` as columns _c0, ... with the bitmap, null where nothing is lost, in ``keep``."""
    bits = stored(keep_bitmaps(docs, id_col, text_col, least_chars, least_docs), "bitmaps").select(F.col("doc").alias("_d"), F.col("t").alias("_x"), "n_dropped", "keep")
    n, size = bits.agg(F.count("*"), F.sum(F.octet_length("keep"))).first()
    if n * 100 + (size or 0) <= MAX_BROADCAST_BYTES:
        bits = F.broadcast(bits)
    doc, t = _identity(F.col(id_col), F.col(text_col))
    return docs.withColumns({"_doc": doc, "_t": t}).join(bits, (F.col("_doc") == F.col("_d")) & (F.col("_t") == F.col("_x")), "left").drop("_d", "_x", "_doc", "_t")


def _left_over(text: str, keep: bytes) -> str:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    lines = text.split("\n")
    return "\n".join([lines[i] for i in np.flatnonzero(bits[: len(lines)])])


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """``docs`` with what is left of each text; untouched rows pass as they are, null texts too."""
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    i, t = (f"_c{docs.columns.index(c)}" for c in (id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(t)
            text = [x if k is None else _left_over(x, k) for x, k in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    met = _with_bitmaps(plain, i, t, least_chars, least_docs).select(*plain.columns, "keep")
    return met.mapInArrow(released(run), plain.schema).toDF(*docs.columns)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        whole, text, keep = (batch.column(names.index(c)) for c in ("whole", "text", "keep"))
        sha = [w if w is not None else hashlib.sha256(_left_over(x.as_py(), k.as_py()).encode()).hexdigest() for w, x, k in zip(whole.to_pylist(), text, keep, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sha, pa.string())], names=[*names[:4], "kept_sha256"])


def report(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row."""
    met = _with_bitmaps(docs.select("doc_id", "text"), "doc_id", "text", least_chars, least_docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    n_lines = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    lost = F.col("keep").isNotNull()
    # Only texts that lose lines go to Python.
    rows = met.select("doc_id", n_lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep", F.when(~lost, F.sha2(text, 256)).alias("whole"), F.when(lost, text).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(_digests), f"doc_id {id_type}, n_lines long, n_dropped long, keep binary, kept_sha256 string").select("doc_id", "n_lines", "n_dropped", "kept_sha256")

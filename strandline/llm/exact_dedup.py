"""Exact deduplication with a two-pass Bloom filter [native].

Pass one sets the bits of every text's hash in a counting Bloom filter (blocks
of 32,768 slots, three slots a hash) and keeps the slots that were hit twice.
Pass two probes each row: only where all three slots were hit twice may the text
be a repeat, and only those rows are shuffled. The others pass straight through.

Where the filter of all rows is too large to broadcast, pass one counts hashes
instead of slots (a row a distinct hash and task moves, no text) and the filter
is made of the repeated ones alone; rows probe it all the same. So texts and
further columns of unsuspected rows move at no size, unless the repeated hashes
by themselves outgrow a broadcast: four bytes for each of them.

Ids are integers. Nulls: a null text counts as empty. A null id is never the
largest unless every id of the group is null. Repeated rows (same id and text) form a group; one of
them stays. An empty table gives an empty result. Very long texts are hashed whole.
Further columns of the input are carried along, whatever their names, but for those
named like a result column in any case, which it replaces. Rows without id are dealt
over all tasks, whatever text a third of them may share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import number_rows
from .common import MAX_BROADCAST_BYTES, attach_groups, stored

BLOCK = 32_768
BITS_PER_ROW = 32
#: Stands for a null id, so that equal ids meet in plain equality and one exchange serves window and join.
NO_ID = -(1 << 63)
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def _slots(sha: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a hash and its three slots there, counted from 1."""
    block = F.pmod(F.xxhash64(sha), F.lit(blocks)).cast("int")
    bits = F.xxhash64(F.lit("slots"), sha)
    return block, [(F.shiftrightunsigned(bits, 15 * i).bitwiseAND(BLOCK - 1) + 1).cast("long") for i in range(3)]


def hit_filter(hashes: DataFrame, sha: str, blocks: int, least: int = 2) -> DataFrame:
    """(``_block``, ``_bits``): the slots that at least ``least`` rows hit."""
    block, slots = _slots(F.col(sha), blocks)
    hit = hashes.select(block.alias("_block"), F.explode(F.array_distinct(F.array(*slots))).alias("_slot"))
    often = hit.groupBy("_block", "_slot").count().filter(F.col("count") >= least)
    return often.groupBy("_block").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))


def _blocks(rows: int) -> int:
    return max(1, -(-rows * BITS_PER_ROW // BLOCK))


def _fits(blocks: int, most: int) -> bool:
    return blocks * (BLOCK // 8 + 64) <= most


def _split(df: DataFrame, bits: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose hash may be in the filter, and the others."""
    probed = df.withColumn("_block", _slots(F.col("_sha"), blocks)[0]).join(bits, "_block", "left")
    maybe = _maybe_repeated(F.col("_sha"), blocks)
    return probed.filter(maybe).select(*df.columns), probed.filter(~maybe).select(*df.columns)


def _maybe_repeated(sha: Column, blocks: int) -> Column:
    """Whether all slots of ``sha`` are set in the joined ``_bits``."""
    found = F.lit(True)
    for slot in _slots(sha, blocks)[1]:
        at = F.bitmap_bit_position(slot)
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = found & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return F.coalesce(found, F.lit(False))


def _named(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column)).alias("keep_id")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_text: bool = False, max_filter_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256.

    Of equal texts the row with the largest id is kept. A filter of more than
    ``max_filter_bytes`` isn't broadcast.
    """
    carried = [c for c in docs.columns if c.lower() not in RESULTS and not (drop_text and c == text_col)]
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    docs = docs.toDF(*own.values())
    columns = [own[c] for c in carried]
    id_, text = F.col(own[id_col]), F.col(own[text_col])
    base = docs.select(*columns, F.coalesce(id_.cast("long"), F.lit(NO_ID)).alias("_id"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("_sha"))
    if drop_text and carried == [id_col]:
        base = stored(base, "hashes")
        narrow = base.select("_id", "_sha")
    else:
        narrow = stored(base.select("_id", "_sha"), "hashes")
    total = narrow.count()
    blocks, hashes, least = _blocks(total), narrow, 2
    if not _fits(blocks, max_filter_bytes):
        hashes, least = stored(narrow.groupBy("_sha").count().filter("count > 1").select("_sha"), "repeated"), 1
        blocks = _blocks(hashes.count())
    if _fits(blocks, max_filter_bytes):
        bits = F.broadcast(stored(hit_filter(hashes, "_sha", blocks, least), "filter"))
        named = _split(narrow, bits, blocks)[0]
        suspects, single = _split(base, bits, blocks)
    else:
        named, suspects, single = narrow, base, None
    groups = named.groupBy("_sha").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
    decided = attach_groups(named.distinct(), groups, "_sha", "group_size", total)
    # One exchange for the suspects, on (_sha, _id), which is as good as unique but where there is no id.
    nth = F.row_number().over(Window.partitionBy("_sha", "_id").orderBy(F.lit(0)))
    same = (F.col("s._sha") == F.col("d._sha")) & (F.col("s._id") == F.col("d._id"))
    kept = (F.col("s._id") == F.col("d.keep_id")) & (F.col("s._nth") == 1)
    out = [*[F.col(f"s.{c}") for c in columns], _named("d.keep_id"), F.col("d.group_size"), kept.alias("kept"), F.col("s._sha").alias("text_sha256")]
    found = suspects.filter(F.col("_id") != NO_ID).withColumn("_nth", nth).alias("s").join(decided.alias("d"), same).select(*out)
    if not narrow.filter(F.col("_id") == NO_ID).isEmpty():
        nameless = number_rows(suspects.filter(F.col("_id") == NO_ID), [], ("_sha",), "_nth")
        groups_of = attach_groups(nameless, groups, "_sha", "group_size", total)
        first = F.col("keep_id").eqNullSafe(NO_ID) & (F.col("_nth") == 1)
        found = found.unionAll(groups_of.select(*columns, _named("keep_id"), "group_size", first.alias("kept"), F.col("_sha").alias("text_sha256")))
    if single is not None:
        alone = single.select(*columns, _named("_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
        found = alone.unionAll(found)
    return found.toDF(*carried, *RESULTS)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs`` with the columns of ``docs``."""
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    i, t = (docs.columns.index(c) for c in (id_col, text_col))
    kept = exact_dedup(plain, f"_c{i}", f"_c{t}").filter("kept")
    return kept.select(*plain.columns).toDF(*docs.columns)

"""Merkle manifest of a dataset: a leaf a row, a tree a group, one tree over the groups.

Slot pivot: conditional aggregates spread each parent's children into slot columns,
which partial aggregation fills before the exchange. A round spreads the ``fanout **
levels`` descendants of a node and hashes runs of neighbouring columns level by
level, so a tree of n leaves takes log(n) / levels rounds, each over a table that
many times smaller. What a leaf's run holds besides its own slot are its siblings;
going back down, each block hands its path to the nodes in its slots.

Places of leaves come from ranges with offsets, so no group is sorted in one task,
and a block's key is its group and number, so a group with a third of all rows is
spread like any other. To the driver come the largest group's size and the root.

A digest is the lowercase hex SHA-256 of its inputs put together; digests go in as
hex text. A field is ``-`` for null, else its bytes' number, ``:`` and the value.
A run of a single node is hashed like any other; a lone leaf is its group's subroot.

Nulls: null ids come first in their group, a null group is a group of its own and
the first. Ties: equal ids stand by their leaf; rows that agree in these too are
alike but for their paths. Repeated rows have a leaf each. Empty texts are fields
of length 0. Very long texts are hashed whole. An empty table has no leaves, no
subroots and no root (None). Only the columns named are read; others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import number_rows
from .common import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


@dataclass(frozen=True)
class Manifest:
    """``rows``: what was given beside ``subroot`` and ``path`` (siblings before and after a node, from the leaf to the root)."""

    rows: DataFrame
    #: (``group``, ``n_rows``, ``subroot``), ordered groups hashed to ``root``.
    groups: DataFrame
    root: str | None


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields."""
    return digest(*[field(v) for v in values])


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(path, start, lambda own, run: digest(run["before"], own, run["after"]))


def siblings(path: Column) -> Column:
    """All siblings of a path as one text."""
    return F.array_join(F.transform(path, lambda run: F.concat(run["before"], run["after"])), "")


def _height(size: Column, fanout: int, most: int) -> Column:
    """Levels above the leaves of a tree of ``size`` leaves; ``most`` is the largest size there is."""
    out, width = F.lit(0), 1
    while width < most:
        out, width = out + (size > width).cast("int"), width * fanout
    return out


def _rounds(fanout: int, levels: int, most: int) -> int:
    rounds, width = 0, 1
    while width < most:
        rounds, width = rounds + 1, width * fanout**levels
    return rounds


def _run(nodes: Column, first: Column, n: Column | int) -> Column:
    """``n`` neighbouring digests as one text; what lies beyond the last is nothing."""
    return F.array_join(F.slice(nodes, first + 1, n), "")


def _pivot(nodes: DataFrame, done: int, fanout: int, levels: int) -> DataFrame:
    """A row a block: its nodes level by level (``_l0``, ...), levels that its tree still has, and its root."""
    width = fanout**levels
    slot = F.pmod(F.col("_i"), F.lit(width))
    spread = nodes.groupBy("_g", F.floor(F.col("_i") / width).cast("long").alias("_i")).agg(
        *[F.max(F.when(slot == s, F.col("_h"))).alias(f"_s{s}") for s in range(width)], F.max("_height").alias("_height")
    )
    out, names = spread, [f"_s{s}" for s in range(width)]
    for k in range(levels):
        runs = [names[i : i + fanout] for i in range(0, len(names), fanout)]
        names = [f"_n{k + 1}_{i}" for i in range(len(runs))]
        out = out.withColumns({name: F.when(F.col(run[0]).isNotNull(), F.sha2(F.concat_ws("", *run), 256)) for name, run in zip(names, runs, strict=True)})
    all_levels = [[f"_s{s}" for s in range(width)], *[[f"_n{k}_{i}" for i in range(fanout ** (levels - k))] for k in range(1, levels + 1)]]
    out = out.select("_g", "_i", "_height", *[F.array_compact(F.array(*columns)).alias(f"_l{k}") for k, columns in enumerate(all_levels)])
    own = F.greatest(F.lit(0), F.least(F.lit(levels), F.col("_height") - done))
    root = F.element_at(F.array(*[F.col(f"_l{k}")[0] for k in range(levels + 1)]), own + 1)
    return out.withColumn("_levels", own).withColumn("_root", root).drop(f"_l{levels}")


def _path(slot: Column, fanout: int, levels: int) -> Column:
    """What stands beside a node in its block, from its own run upwards."""
    runs = []
    for k in range(levels):
        at = F.floor(slot / fanout**k).cast("int")
        first = (F.floor(at / fanout) * fanout).cast("int")
        beside = F.struct(_run(F.col(f"_l{k}"), first, at - first).alias("before"), _run(F.col(f"_l{k}"), at + 1, first + fanout - 1 - at).alias("after"))
        runs.append(F.when(F.col("_levels") > k, beside))
    return F.array_compact(F.array(*runs))


def _rise(nodes: DataFrame, fanout: int, levels: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """The trees' roots as (``_g``, ``_h``), and each round's blocks, from (``_g``, ``_i``, ``_h``, ``_height``)."""
    blocks = []
    for r in range(_rounds(fanout, levels, most)):
        blocks.append(stored(_pivot(nodes, r * levels, fanout, levels), "blocks"))
        nodes = blocks[-1].select("_g", "_i", F.col("_root").alias("_h"), "_height")
    return nodes.select("_g", "_h"), blocks


def _fall(paths: DataFrame, blocks: list[DataFrame], fanout: int, levels: int) -> DataFrame:
    """The lowest blocks with the path of each (``_up``), from the paths of the roots (``_g``, ``_i``, ``_up``, ``_sub``)."""
    for r in range(len(blocks) - 1, -1, -1):
        met = blocks[r].join(paths, ["_g", "_i"])
        if r == 0:
            return met
        nodes = met.select("*", F.posexplode("_l0").alias("_slot", "_node"))
        paths = nodes.select("_g", (F.col("_i") * fanout**levels + F.col("_slot")).alias("_i"), F.concat(_path(F.col("_slot"), fanout, levels), "_up").alias("_up"), "_sub")
    return paths


def _proved(nodes: DataFrame, paths: DataFrame, blocks: list[DataFrame], fanout: int, levels: int) -> DataFrame:
    """``nodes`` with ``path`` and ``_sub``."""
    low = _fall(paths, blocks, fanout, levels)
    if not blocks:
        return nodes.join(low, ["_g", "_i"]).withColumnRenamed("_up", "path")
    width = fanout**levels
    met = nodes.withColumn("_slot", F.pmod("_i", F.lit(width)).cast("int")).withColumn("_i", F.floor(F.col("_i") / width).cast("long")).join(low.drop("_height"), ["_g", "_i"])
    return met.withColumn("path", F.concat(_path(F.col("_slot"), fanout, levels), "_up"))


def manifest(rows: DataFrame, leaf: str = "leaf", group: str = "group", id_col: str = "id", fanout: int = 2, levels: int = 4) -> Manifest:
    """The manifest of ``rows`` that hold a leaf digest, a group and an id each, and whatever else is to be kept."""
    own = {c: f"_c{i}" for i, c in enumerate(rows.columns)}
    plain = rows.toDF(*own.values())
    # The group as text, null before all: its order is that of UTF-8 bytes.
    keyed = plain.withColumn("_g", F.coalesce(F.concat(F.lit("+"), F.col(own[group]).cast("string")), F.lit(""))).withColumn("_h", F.col(own[leaf]))
    placed = stored(number_rows(keyed, [F.col(own[id_col]).asc_nulls_first(), F.col("_h").asc()], ("_g",), "n", "size"), "leaves")
    most = placed.agg(F.max("size")).first()[0] or 0
    nodes = placed.select(*own.values(), "_g", "_h", (F.col("n") - 1).alias("_i"), _height(F.col("size"), fanout, most).alias("_height"))
    roots, blocks = _rise(nodes.select("_g", "_i", "_h", "_height"), fanout, levels, most)
    if not blocks:
        roots = nodes.select("_g", "_h")
    roots = stored(number_rows(roots, [F.col("_g").asc()], (), "n"), "subroots")
    n = roots.count()
    top = roots.select(F.lit("").alias("_g"), (F.col("n") - 1).alias("_i"), "_h", _height(F.lit(n), fanout, n).alias("_height"), F.col("_g").alias("_name"))
    root_rows, top_blocks = _rise(top.drop("_name"), fanout, levels, n)
    root = root_rows.first()
    ends = F.array().cast(PATH)
    whole = root_rows.sparkSession.range(1).select(F.lit("").alias("_g"), F.lit(0).cast("long").alias("_i"), ends.alias("_up"), F.lit(None).cast("string").alias("_sub"))
    proved = _proved(top, whole, top_blocks, fanout, levels)
    paths = stored(proved.select(F.col("_name").alias("_g"), F.lit(0).cast("long").alias("_i"), F.col("path").alias("_up"), F.col("_h").alias("_sub")), "paths")
    out = _proved(nodes.drop("_height"), paths, blocks, fanout, levels)
    name = F.when(F.col("_g") != "", F.substring("_g", 2, 1 << 30))
    sizes = placed.filter("n = 1").select("_g", F.col("size").alias("n_rows"))
    groups = sizes.join(roots, "_g").select(name.alias("group"), "n_rows", F.col("_h").alias("subroot"))
    return Manifest(out.select(*[F.col(c).alias(n) for n, c in own.items()], F.col("_sub").alias("subroot"), "path"), groups, root["_h"] if root else None)


def report(docs: DataFrame, fanout: int = 2, levels: int = 4) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    Each row is proved with the leaf it would have if n_chars were one more, where 7
    divides the crc32 of its id, else with its own: the first must not verify.
    """
    doc_id, source, lang, n_chars, text = (F.col(c) for c in FIELDS)
    more = (n_chars.cast("decimal(20,0)") + 1).cast("decimal(21,0)")
    touched = F.crc32(doc_id.cast("string")) % 7 == 0
    shown = F.when(touched, leaf(doc_id, source, lang, more, text)).otherwise(F.col("leaf"))
    hashed = docs.select(*FIELDS).withColumn("leaf", leaf(doc_id, source, lang, n_chars, text))
    # A leaf that isn't touched is stored once.
    rows = stored(hashed.select(doc_id.alias("id"), lang.alias("group"), "leaf", F.when(shown != F.col("leaf"), shown).alias("shown")), "leaves")
    made = manifest(rows, fanout=fanout, levels=levels)
    root = F.lit(made.root).cast("string")
    proved = made.rows.withColumn("folded_root", fold(F.coalesce("shown", "leaf"), F.col("path")))
    return proved.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified")
    )

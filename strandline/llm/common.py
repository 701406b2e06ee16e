"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch

#: What lies between lower-cased words; words are runs of ASCII digits, a-z and anything beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"

#: A broadcast side must be proven smaller than this; beyond it the join shuffles.
MAX_BROADCAST_BYTES = 64 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor costs only the reading of files that
    outlive it. The files go by ``clear_scratch``, or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` is the fast way where all is ASCII."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def word_array(text: Column) -> Column:
    """The lower-cased words of a text; none for null."""
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if ``rows`` of ``row_bytes`` are proven to fit."""
    return F.broadcast(df) if rows * row_bytes <= MAX_BROADCAST_BYTES else df


def fits(df: DataFrame, overhead: int = 64) -> bool:
    """Whether a stored table is small enough to broadcast, by the measured bytes of its texts and ``overhead`` a row."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    size = F.lit(overhead).cast("long")
    for x in texts:
        size = size + x
    return (df.agg(F.sum(size)).first()[0] or 0) <= MAX_BROADCAST_BYTES


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner", hot_share: float = 1e-4) -> DataFrame:
    """``rows`` joined ("inner" or "left") with their ``groups`` on ``key``, whatever the skew.

    Groups with at least ``hot_share`` of ``total`` rows number at most
    ``1 / hot_share``; they are broadcast. The others meet in a shuffle in which
    no key has more than that share: rows of hot groups, and those without a key,
    are dealt by all their columns there and find nothing.
    """
    least = max(1000, int(total * hot_share))
    extra = [c for c in groups.columns if c != key]
    group = F.struct(*extra)
    hot = groups.filter(F.col(size) >= least).select(F.col(key).alias("_hot"), group.alias("_warm"))
    cold = groups.filter(F.col(size) < least).select(F.col(key).alias("_key"), group.alias("_cold"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    met = F.col("_hot").isNull() & F.col(key).isNotNull()
    spread = F.xxhash64(*rows.columns).cast(rows.schema[key].dataType)
    joined = marked.withColumn("_at", F.when(met, F.col(key)).otherwise(spread)).withColumn("_met", met).join(cold, F.col("_at") == F.col("_key"), "left")
    found = F.when(F.col("_met"), F.col("_cold")).otherwise(F.col("_warm"))
    out = joined.select(*rows.columns, found.alias("_group"))
    if how == "inner":
        out = out.filter("_group is not null")
    return out.select(*rows.columns, *[F.col(f"_group.{c}").alias(c) for c in extra])


def bounded(df: DataFrame, key: Column, most: int, spare: int = 4) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``key``.

    A hash bound that leaves about ``spare * most`` rows comes first, so that the
    single task which sorts them gets a number of rows that doesn't grow.
    """
    cells = 1 << 40
    share = min(1.0, spare * most / max(1, df.count()))
    h = F.xxhash64(key)
    kept = df if share == 1.0 else df.filter(F.pmod(h, F.lit(cells)) < int(share * cells))
    return kept.orderBy(F.pmod(h, F.lit(cells)), key).limit(most)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow that gives free memory back when a task ends, as workers live on for other stages."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task


def slices(batch: pa.RecordBatch, column: int, rows: int = 1 << 20, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``rows`` rows and ``most`` bytes of text, or a single longer text."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + most, side="right"))))
        yield batch.slice(start, end - start)
        start = end

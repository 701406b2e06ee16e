"""Row numbers and running totals over whole tables and large groups, in any order.

A window without a partition key sorts the whole table in one task, and one with a
hot key sorts that key's rows in one task. Here rows are dealt by ranges of (group,
order), numbered and summed inside each range, and the ranges' counts and sums,
one row a range and group, give what lies before each.

Rows that tie are told apart by their place in the input's partitions, so that a lost
task is run again with the same ranges the input should be a scan or a stored table;
store what comes out of a shuffle first, where rows tie in the order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..plans.registry import query
from ..sources.scratch import stored
from ..sources.tables import table

#: Rows inside a range are told apart by the low bits of Spark's increasing ids, ranges by the others.
RANGE_BITS = 33
#: Offsets of ranges are broadcast up to this size, measured.
MAX_BROADCAST_BYTES = 64 << 20


def _ranges(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` sorted by ranges, with its place there in ``_at``; rows that tie in all are spread as well."""
    keys = [*[F.col(b).asc_nulls_first() for b in by], *order, F.col("_tie").asc()]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id())


def _same(left: str, right: str, by: list[str]) -> Column:
    met = F.col(f"{left}._range") == F.col(f"{right}._range")
    for b in by:
        met = met & F.col(f"{left}.{b}").eqNullSafe(F.col(f"{right}.{b}"))
    return met


def _before(parts: DataFrame, by: list[str], values: dict[str, str]) -> DataFrame:
    """Per range what the ranges before it hold (``_before_*``) and the whole group holds (``_all_*``)."""
    if by:
        inside = Window.partitionBy(*by)
        earlier = inside.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        sums = [F.coalesce(F.sum(v).over(earlier), F.lit(0).cast(kind)).alias(f"_before{v}") for v, kind in values.items()]
        return parts.select(*by, "_range", "_first", *sums, *[F.sum(v).over(inside).alias(f"_all{v}") for v in values])
    rows = sorted(parts.collect(), key=lambda r: r["_range"])  # one for each range, however many rows there are
    columns = [[r["_range"] for r in rows], [r["_first"] for r in rows]]
    for v in values:
        ends = list(accumulate(r[v] for r in rows))
        columns += [[0 * e for e in ends[:1]] + ends[:-1], ends[-1:] * len(ends)]
    names = ", ".join([f"_before{v} {kind}, _all{v} {kind}" for v, kind in values.items()])
    return parts.sparkSession.createDataFrame(list(zip(*columns, strict=True)), f"_range long, _first long, {names}")


def _with_offsets(placed: DataFrame, by: list[str], totals: dict[str, str]) -> DataFrame:
    """Rows of ``placed`` (alias r) joined with the offsets of their range (alias o)."""
    ranged = placed.withColumn("_range", F.shiftrightunsigned("_at", RANGE_BITS))
    sums = [F.max(F.struct("_at", t))[t].alias(f"_{t}") for t in totals]  # the last running total of a range is its sum
    parts = ranged.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *sums)
    offsets = _before(parts, by, {"_n": "long", **{f"_{t}": kind for t, kind in totals.items()}})
    if by:
        offsets = stored(offsets, "offsets")
        size = offsets.agg(F.count("*"), F.sum(sum((F.coalesce(F.octet_length(F.col(b).cast("string")), F.lit(0)) for b in by), F.lit(0)))).first()
        small = size[0] * 100 + (size[1] or 0) <= MAX_BROADCAST_BYTES
    else:
        small = True
    return ranged.alias("r").join((F.broadcast(offsets) if small else offsets).alias("o"), _same("r", "o", by))


def number_rows(df: DataFrame, order: list[Column], by: tuple[str, ...] = (), number: str = "n", size: str | None = None) -> DataFrame:
    """``df`` with each row's place in ``order`` from 1 and, if named, the rows of its group.

    Null keys form a group. Rows that tie in ``order`` are numbered in some order.
    An empty table stays empty. Names starting with an underscore are reserved.
    """
    by = list(by)
    joined = _with_offsets(stored(_ranges(df, by, order), "numbered"), by, {})
    place = F.col("o._before_n") + F.col("r._at") - F.col("o._first") + 1
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], place.alias(number), *([F.col("o._all_n").alias(size)] if size else []))


def _sums_inside(by: list[str], values: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds running totals to sorted batches; each starts anew where the group changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, [0] * len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.zeros(batch.num_rows, bool)
            for b in by:
                own = batch.column(batch.schema.get_field_index(b))
                same = pc.equal(own[1:], own[:-1]), pc.and_(pc.is_null(own[1:]), pc.is_null(own[:-1]))
                fresh[1:] |= ~(pc.fill_null(same[0], False).to_numpy(zero_copy_only=False) | same[1].to_numpy(zero_copy_only=False))
            first = [batch.column(batch.schema.get_field_index(b))[0].as_py() for b in by]
            if key is not None and first != key:
                fresh[0] = True
            starts = np.flatnonzero(fresh)
            out = []
            for k, source in enumerate(values.values()):
                own = pc.fill_null(batch.column(batch.schema.get_field_index(source)), 0).to_numpy(zero_copy_only=False)
                sums = np.cumsum(own)
                back = np.zeros(len(own), own.dtype)
                ends = np.append(starts, len(own))
                if ends[0]:
                    back[: ends[0]] = -held[k]
                for s, e in zip(ends[:-1], ends[1:], strict=True):
                    back[s:e] = sums[s - 1] if s else 0
                total = sums - back
                held[k] = total[-1]
                out.append(pa.array(total))
            key = [batch.column(batch.schema.get_field_index(b))[-1].as_py() for b in by]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *values])

    return run


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, str], by: tuple[str, ...] = (), number: str | None = None) -> DataFrame:
    """``df`` with running totals in ``order``: ``totals`` names each result and the column that it sums.

    Sums are long for whole numbers and double for others; null counts as nothing.
    A single exchange: totals are summed while the sorted ranges stream by.
    """
    by = list(by)
    whole = {t: df.schema[v].dataType.typeName() in ("byte", "short", "integer", "long") for t, v in totals.items()}
    kinds = {t: "long" if w else "double" for t, w in whole.items()}
    own = {t: f"_of_{t}" for t in totals}
    ranged = _ranges(df.select("*", *[F.col(v).cast(kinds[t]).alias(own[t]) for t, v in totals.items()]), by, order)
    schema = StructType([*ranged.schema.fields, *[StructField(t, LongType() if whole[t] else DoubleType()) for t in totals]])
    placed = stored(ranged.mapInArrow(_sums_inside(by, own), schema).drop(*own.values()), "running")
    joined = _with_offsets(placed, by, kinds)
    sums = [(F.col(f"r.{t}") + F.col(f"o._before_{t}")).alias(t) for t in totals]
    place = [(F.col("o._before_n") + F.col("r._at") - F.col("o._first") + 1).alias(number)] if number else []
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], *sums, *place)


@query("""
SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS revenue, row_number() OVER w AS n
FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)
""")
def running_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue so far and number of each order, over the whole table."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    out = running_totals(orders, [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()], {"revenue": "o_totalprice"}, number="n")
    return out.select("o_orderkey", F.round("revenue", 2).alias("revenue"), "n")


@query("""
SELECT event_id, event_type, count(*) OVER w AS nth, count(*) OVER (PARTITION BY event_type) AS size FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def running_number_in_large_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few groups of many rows, none of which is sorted by one task."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return number_rows(events, [F.col("ts").asc(), F.col("event_id").asc()], ("event_type",), "nth", "size").drop("ts")


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, sum(l_partkey) OVER w AS parts, round(sum(l_quantity) OVER w, 2) AS quantity
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS twin FROM lineitem)
WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, twin ROWS UNBOUNDED PRECEDING)
""")
def running_totals_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", *keys)
    out = running_totals(line, [F.col(k).asc() for k in keys], {"parts": "l_partkey", "quantity": "l_quantity"}, ("l_suppkey",))
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "parts", F.round("quantity", 2).alias("quantity"))

"""Aggregation over an inequality join without an equal key: how many rows lie below a row in two columns.

A nested loop would compare all pairs. Here each row has its place by the first
column and by the second; ties get places such that "strictly below in both
columns" and "earlier in both places" mean the same. Places are cut into blocks of
equal size. What lies below a row is then

- all of the cells (block, block) that lie below its cell in both: prefix sums of
  a grid of counts, with no more cells than rows;
- within its block of the first place: a sorted merge inside the block;
- within its block of the second place, what is in earlier blocks of the first:
  a sorted merge again.

So a row takes part in two sorted blocks, however the values are distributed, and
a value that a third of all rows have is cut like any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.scratch import stored
from ..sources.tables import table
from .running import number_rows

LEAST_BLOCK, MOST_BLOCK = 1024, 4_000_000


def earlier_and_lower(second: np.ndarray) -> np.ndarray:
    """For each of an array's distinct values how many smaller ones stand before it.

    Merges from the whole array downwards: at each bit of the place, those in the
    right half of a stretch get the number of those of the left half with smaller
    values. The order by value is kept while stretches are cut, so each step is linear.
    """
    n = len(second)
    out = np.zeros(n, np.int64)
    places = np.argsort(second, kind="stable")
    for bit in range(max(0, n - 1).bit_length() - 1, -1, -1):
        right = (places >> bit) & 1
        stretch = places >> (bit + 1)
        lefts = np.cumsum(1 - right)
        starts = np.flatnonzero(np.concatenate([[True], stretch[1:] != stretch[:-1]]))
        before = np.concatenate([[0], lefts])[starts]
        own = lefts - np.repeat(before, np.diff(np.append(starts, n)))
        out[places[right == 1]] += own[right == 1]
        # A stable cut of every stretch into its halves: places of left ones first.
        many = np.repeat(np.add.reduceat(1 - right, starts), np.diff(np.append(starts, n)))
        begin = np.repeat(starts, np.diff(np.append(starts, n)))
        nth = np.arange(n) - begin
        at = begin + np.where(right == 1, many + nth - own, own - 1)
        cut = np.empty_like(places)
        cut[at] = places
        places = cut
    return out


def _within_first(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("_p")
    return block.assign(_below=earlier_and_lower(block["_q"].to_numpy()))


def _within_second(block: pd.DataFrame) -> pd.DataFrame:
    # Within a block of the first place nothing counts, so the larger second place comes first there.
    block = block.sort_values(["_pb", "_q"], ascending=[True, False])
    return block.assign(_below=block["_below"] + earlier_and_lower(block["_q"].to_numpy()))


def _prefix(cells: DataFrame) -> DataFrame:
    """(_pb, _qb, _under): the rows in cells below in both; one row a cell of the whole grid."""
    by_column = Window.partitionBy("_qb").orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    by_row = Window.partitionBy("_pb").orderBy("_qb").rowsBetween(Window.unboundedPreceding, -1)
    columns = cells.withColumn("_left", F.coalesce(F.sum("_n").over(by_column), F.lit(0).cast("long")))
    return columns.select("_pb", "_qb", F.coalesce(F.sum("_left").over(by_row), F.lit(0).cast("long")).alias("_under"))


def count_below(df: DataFrame, first: str, second: str, name: str, block: int | None = None) -> DataFrame:
    """``df`` with the number of rows that are strictly less in both columns.

    Blocks have ``block`` rows, else the two thirds' power of the number of rows,
    between LEAST_BLOCK and MOST_BLOCK. Rows with a null in a column are below
    nothing and nothing is below them: they get 0. An empty table stays empty.
    """
    known = F.col(first).isNotNull() & F.col(second).isNotNull()
    keys = df.withColumn("_known", known)
    # Of rows with one first value the larger second comes first: the smaller isn't earlier.
    placed = number_rows(keys.filter("_known"), [F.col(first).asc(), F.col(second).desc()], number="_p")
    placed = stored(number_rows(placed, [F.col(second).asc(), F.col("_p").desc()], number="_q"), "places")
    n = placed.count()
    size = block or min(MOST_BLOCK, max(LEAST_BLOCK, round(n ** (2 / 3))))
    cut = lambda c: F.floor((F.col(c) - 1) / size).cast("long")
    pairs = placed.select("_p", "_q", cut("_p").alias("_pb"), cut("_q").alias("_qb"))
    schema = "_p long, _q long, _pb long, _qb long, _below long"
    inside = pairs.groupBy("_pb").applyInPandas(_within_first, schema).groupBy("_qb").applyInPandas(_within_second, schema)
    spark, blocks = df.sparkSession, -(-n // size)
    axis = spark.range(blocks * blocks).select((F.col("id") / F.lit(max(blocks, 1))).cast("long").alias("_pb"), F.pmod("id", F.lit(max(blocks, 1))).alias("_qb"))
    counts = pairs.groupBy("_pb", "_qb").agg(F.count("*").alias("_n"))
    under = _prefix(axis.join(counts, ["_pb", "_qb"], "left").fillna(0, ["_n"]))
    below = inside.join(under, ["_pb", "_qb"]).select("_p", (F.col("_below") + F.col("_under")).alias(name))
    found = placed.join(below, "_p").select(*df.columns, name)
    return found.unionAll(keys.filter(~F.col("_known")).select(*df.columns, F.lit(0).cast("long").alias(name)))


@query("""
SELECT a.o_orderkey, count(b.o_orderkey) AS cheaper_earlier FROM orders a LEFT JOIN orders b ON b.o_orderdate < a.o_orderdate AND b.o_totalprice < a.o_totalprice GROUP BY 1
""")
def join_inequality_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order how many cheaper ones came before."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return count_below(orders, "o_orderdate", "o_totalprice", "cheaper_earlier").select("o_orderkey", "cheaper_earlier")

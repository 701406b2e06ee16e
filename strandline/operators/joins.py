"""Joins: equi, outer, semi, anti, theta and range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ``points`` with those of ``intervals`` that have low <= point < high.

    An equi-join on cells of ``width`` instead of a nested loop: an interval is
    repeated once for each cell that it touches, so ``width`` should be about an
    interval's length. Null or reversed bounds match nothing.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = intervals.filter(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    joined = points.withColumn("_cell", cell(point)).join(spread, "_cell").drop("_cell")
    return joined.filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)))


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("""
SELECT c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY c_mktsegment
""")
def join_revenue_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: two equi-joins, a pushed-down filter, partial sums."""
    line, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    early = orders.filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    joined = line.join(early, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.round(F.sum(revenue()), 2).alias("revenue"), F.count("*").alias("n"))


@query("""
SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY n_name, r_name
""")
def join_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, supplier, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    joined = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.round(F.sum(revenue()), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey")
def join_left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    joined = table(spark, sf_dir, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("""
SELECT coalesce(a.k, b.k) AS k, a.n AS n_customer, b.n AS n_supplier
FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k
""")
def join_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").filter("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customer"))
    b = table(spark, sf_dir, "supplier").filter("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_supplier"))
    return a.join(b, "k", "full")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    finished = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(finished, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""
SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
""")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equi-key with an inequality: the inequality filters inside the hash join."""
    a, b = (table(spark, sf_dir, "nation").alias(x) for x in "ab")
    both = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return both.select(F.col("a.n_name").alias("first"), F.col("b.n_name").alias("second"))


@query("""
SELECT a.o_orderkey AS first, b.o_orderkey AS second FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_totalprice < b.o_totalprice
""")
def join_theta_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a table that grows: each order with the dearer ones of its customer."""
    a, b = (table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").alias(x) for x in "ab")
    both = a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_totalprice") < F.col("b.o_totalprice")))
    return both.select(F.col("a.o_orderkey").alias("first"), F.col("b.o_orderkey").alias("second"))


@query("""
SELECT s_nationkey, count(*) AS n FROM part JOIN (SELECT s_nationkey, 900 + s_suppkey % 100 AS lo, 905 + s_suppkey % 100 AS hi FROM supplier)
ON p_retailprice >= lo AND p_retailprice < hi GROUP BY s_nationkey
""")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = table(spark, sf_dir, "supplier").select("s_nationkey", (900 + F.col("s_suppkey") % 100).cast("double").alias("lo"), (905 + F.col("s_suppkey") % 100).cast("double").alias("hi"))
    joined = range_join(table(spark, sf_dir, "part").select("p_retailprice"), bands, "p_retailprice", "lo", "hi", 5.0)
    return joined.groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem l
WHERE l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey)
""")
def join_correlated_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated scalar subquery as an aggregate and a join."""
    line = table(spark, sf_dir, "lineitem")
    mean = line.groupBy("l_partkey").agg((0.2 * F.avg("l_quantity")).alias("bound"))
    return line.join(mean, "l_partkey").filter("l_quantity < bound").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")

"""Aggregations: grouped, distinct, conditional, statistics, cube, rollup, pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table


@query("""
SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag
""")
def agg_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("n"),
    )


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY l_suppkey")
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_orderkey").alias("n_orders"))


@query("""
SELECT c_mktsegment, count(*) FILTER (c_acctbal < 0) AS n_negative, round(sum(CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0 END), 2) AS positive,
       max(c_acctbal) AS most, min(c_acctbal) AS least, bool_or(c_acctbal > 9990) AS any_large
FROM customer GROUP BY c_mktsegment
""")
def agg_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.count_if(balance < 0).alias("n_negative"),
        F.round(F.sum(F.when(balance >= 0, balance).otherwise(0)), 2).alias("positive"),
        F.max("c_acctbal").alias("most"),
        F.min("c_acctbal").alias("least"),
        F.bool_or(balance > 9990).alias("any_large"),
    )


@query("""
SELECT o_orderpriority, round(stddev_samp(o_totalprice), 3) AS sd, round(var_pop(o_totalprice), 0) AS var, round(quantile_cont(o_totalprice, 0.5), 3) AS median,
       round(quantile_cont(o_totalprice, 0.9), 3) AS p90, round(corr(o_totalprice, o_custkey), 6) AS corr
FROM orders GROUP BY o_orderpriority
""")
def agg_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.round(F.stddev_samp("o_totalprice"), 3).alias("sd"),
        F.round(F.var_pop("o_totalprice"), 0).alias("var"),
        F.round(F.median("o_totalprice"), 3).alias("median"),
        F.round(F.percentile("o_totalprice", 0.9), 3).alias("p90"),
        F.round(F.corr("o_totalprice", "o_custkey"), 6).alias("corr"),
    )


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping(o_orderstatus) + 0 AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping("o_orderstatus").cast("long").alias("g"))


@query("""
SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)
""")
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, year(l_shipdate)::INT AS y, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (year(l_shipdate)), ())")
def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("y"))
    sets = [[F.col("l_returnflag")], [F.col("y")], []]
    return rows.groupingSets(sets, "l_returnflag", "y").agg(F.count("*").alias("n")).select("l_returnflag", "y", "n")


@query("""
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view
FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY user_id
""")
def agg_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the values given no job looks for them."""
    kinds = ["click", "purchase", "view"]
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin(kinds))
    return rows.groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)


@query("SELECT s_suppkey, 'balance' AS name, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey FROM supplier")
def agg_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return rows.unpivot("s_suppkey", ["balance", "nation"], "name", "value")


@query("SELECT l_suppkey, round(sum(l_quantity), 1) AS qty FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > (SELECT 1.02 * sum(l_quantity) / count(DISTINCT l_suppkey) FROM lineitem)")
def agg_having_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second aggregate is over the first one's few rows."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    bound = per.agg((1.02 * F.sum("q") / F.count("*")).alias("bound"))
    return per.join(F.broadcast(bound), F.col("q") > F.col("bound")).select("l_suppkey", F.round("q", 1).alias("qty"))


def _held_to(approximate: DataFrame, exact: DataFrame, by: str) -> DataFrame:
    """Both, with ``within``: 1 if the approximate count ``a`` is within 5 % of the exact ``n``. A null key is a group."""
    both = approximate.join(exact.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
    return both.withColumn("within", (F.abs(F.col("a") - F.col("n")) <= 0.05 * F.col("n")).cast("int"))


@query(exact="SELECT l_returnflag, count(DISTINCT l_orderkey) AS n, 1 AS within FROM lineitem GROUP BY l_returnflag")
def agg_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate count is compared as a bound. Counted apart from the exact one: in one aggregate each distinct key would carry a sketch of 13 KB."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    approximate, exact = rows.agg(F.approx_count_distinct("l_orderkey", 0.01).alias("a")), rows.agg(F.countDistinct("l_orderkey").alias("n"))
    return _held_to(approximate, exact, "l_returnflag").select("l_returnflag", "n", "within")


@query(exact="""
SELECT o_orderpriority, count(DISTINCT o_custkey) AS n, 1 AS within, count(DISTINCT date_trunc('month', o_orderdate)) AS n_months FROM orders GROUP BY o_orderpriority
""")
def agg_merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each month, which could be kept, merged to one and held to the exact count; orders without a date have a sketch, but no month."""
    orders = table(spark, sf_dir, "orders")
    monthly = orders.groupBy("o_orderpriority", F.trunc("o_orderdate", "month").alias("m")).agg(F.hll_sketch_agg("o_custkey", F.lit(14)).alias("s"))
    merged = monthly.groupBy("o_orderpriority").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("a"), F.count("m").alias("n_months"))
    exact = orders.groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("n"))
    return _held_to(merged, exact, "o_orderpriority").select("o_orderpriority", "n", "within", "n_months")

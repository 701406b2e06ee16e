"""Window functions: ranking, analytic, frames over rows and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table


@query("""
SELECT o_custkey, o_orderkey, o_totalprice, rn FROM (
  SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3
""")
def window_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank filter becomes a group limit before the shuffle."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).cast("long").alias("rn"))
    return rows.filter("rn <= 3")


@query("""
SELECT p_partkey, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS q
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)
""")
def window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_size")
    by_price = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    whole = lambda c: c.cast("long")
    return table(spark, sf_dir, "part").select(
        "p_partkey", whole(F.rank().over(w)).alias("r"), whole(F.dense_rank().over(w)).alias("d"), F.round(F.percent_rank().over(w), 6).alias("p"), F.round(F.cume_dist().over(w), 6).alias("c"), whole(F.ntile(4).over(by_price)).alias("q")
    )


@query("""
SELECT event_id, lag(event_type) OVER w AS before, lead(value, 2) OVER w AS after, first_value(event_type) OVER w AS first,
       nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
""")
def window_analytic(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    all_rows = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select(
        "event_id", F.lag("event_type").over(w).alias("before"), F.lead("value", 2).over(w).alias("after"), F.first("event_type").over(w).alias("first"), F.nth_value("event_id", 2).over(all_rows).alias("second")
    )


@query("""
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving,
       round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 2) AS running FROM events
""")
def window_rows_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 2).alias("moving"), F.round(F.sum("value").over(w), 2).alias("running"))


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events
""")
def window_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-86_400_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", second.alias("at")).select("event_id", F.count("*").over(w).alias("n"))

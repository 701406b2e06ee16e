"""Set operations, distinct, sorts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return (
        table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")),
        table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("k")),
    )


_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0"


@query(f"{_A} UNION {_B}")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.union(b).distinct()


@query(f"{_A} UNION ALL {_B}")
def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.unionByName(b)


@query(f"{_A} INTERSECT {_B}")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.intersect(b)


@query(f"{_A} INTERSECT ALL {_B}")
def set_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.intersectAll(b)


@query("SELECT c_nationkey AS k, c_custkey % 7 AS m FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT s_nationkey, s_suppkey % 7 FROM supplier")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").selectExpr("c_nationkey AS k", "c_custkey % 7 AS m")
    return a.subtract(table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS k", "s_suppkey % 7 AS m"))


@query(f"{_A} EXCEPT ALL {_B}")
def set_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.exceptAll(b)


@query("SELECT DISTINCT p_brand, p_type FROM part")
def set_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: each task keeps its best 25."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 20")
def sort_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").offset(20).limit(10)

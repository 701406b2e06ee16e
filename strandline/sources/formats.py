"""File formats: writes and reads of the formats that Spark has built in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from .scratch import scratch
from .tables import table

FORMATS = ("parquet", "orc", "json", "csv")


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    """Writes ``df``; CSV gets a header line."""
    if kind not in FORMATS:
        raise ValueError(f"format {kind} is none of {FORMATS}")
    out = df.write.format(kind).mode(mode)
    if kind == "csv":
        out = out.option("header", True)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)


def read(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Reads with a given schema, so that no pass over the data infers it."""
    if kind not in FORMATS:
        raise ValueError(f"format {kind} is none of {FORMATS}")
    return spark.read.format(kind).schema(schema).option("header", True).load(path)


def _round_trip(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    path = scratch(spark, kind)
    write(own, path, kind)
    return read(spark, path, kind, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


@query(_SUPPLIER)
def source_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "orc")


@query(_SUPPLIER)
def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "json")


@query(_SUPPLIER)
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "csv")


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment")
def source_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table partitioned by a column: the filter prunes folders."""
    path = scratch(spark, "partitioned")
    write(table(spark, sf_dir, "customer"), path, partition_by=("c_mktsegment",))
    kept = spark.read.parquet(path).filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return kept.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity < 5")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters and columns reach the Parquet scan."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.filter((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") < 5)).select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")

"""Tables laid out in buckets, and joins and aggregates over them without an exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from .scratch import scratch
from .tables import table


def write_buckets(df: DataFrame, name: str, buckets: int, by: tuple[str, ...], sort: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """Writes ``df`` as the table ``name`` in ``buckets`` by the hash of ``by``, sorted inside, and reads it.

    Rows are dealt by the same hash before they are written, so each bucket is one
    file, and a later join on ``by`` between tables of as many buckets moves nothing.
    """
    dealt = df.repartition(buckets, *by)
    out = dealt.write.format("parquet").bucketBy(buckets, *by).sortBy(*(sort or by)).mode("error")
    (out.option("path", path) if path else out).saveAsTable(name)
    return df.sparkSession.table(name)


def _own_name(kind: str) -> str:
    return f"strandline_{kind}_{uuid.uuid4().hex}"


def bucketed(df: DataFrame, kind: str, buckets: int, by: tuple[str, ...]) -> DataFrame:
    """A bucketed copy of ``df`` under scratch space; the catalog keeps its entry until the session ends."""
    return write_buckets(df, _own_name(kind), buckets, by, path=scratch(df.sparkSession, kind))


@query("""
SELECT o_orderkey, o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2
""")
def join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables are bucketed by order: neither the join nor the sum by order moves a row."""
    orders = bucketed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "orders", 8, ("l_orderkey",))
    line = bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), "lineitem", 8, ("l_orderkey",))
    joined = orders.hint("merge").join(line, "l_orderkey")
    return joined.groupBy(F.col("l_orderkey").alias("o_orderkey"), "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))

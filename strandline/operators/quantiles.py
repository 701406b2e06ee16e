"""Exact quantiles of large groups in rounds of histograms, without a group's values in any one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.scratch import stored
from ..sources.tables import table

BINS = 1024
MAX_BROADCAST_BYTES = 64 << 20


def _sought(groups: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """A row for each order statistic: its rank among the values between ``_low`` and ``_high``, both values of the group."""
    each = groups.withColumn("_share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    at = each.withColumn("_at", F.col("_share") * (F.col("_n") - 1)).withColumn("_down", F.floor("_at").cast("long"))
    ends = at.withColumn("_up", F.explode(F.when(F.col("_at") == F.col("_down"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    return ends.select(*by, "_share", "_at", "_up", (F.col("_down") + F.col("_up") + 1).alias("_rank"), "_low", "_high")


def _round(rows: DataFrame, sought: DataFrame, by: list[str]) -> DataFrame:
    """``sought`` narrowed: counts by bin find the bin of each rank, whose least and largest value are the next bounds."""
    asked = sought.toDF(*[f"_by{i}" for i in range(len(by))], *sought.columns[len(by) :])
    size = sought.count()
    if size * 200 <= MAX_BROADCAST_BYTES:
        asked = F.broadcast(asked)
    same = (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    # Halves keep the width of a bin finite; the bins grow with the value, so they cut the values in order.
    width = (F.col("_high") / 2 - F.col("_low") / 2) / (BINS / 2)
    bin_ = F.when(width > 0, F.floor(F.least(F.lit(float(BINS)), (F.col("_v") / 2 - F.col("_low") / 2) / width * 2))).otherwise((F.col("_v") > F.col("_low")).cast("long"))
    keys = [*by, "_share", "_at", "_up", "_rank"]
    counts = rows.join(asked, same).groupBy(*keys, bin_.alias("_bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    found = counts.withColumn("_upto", F.sum("_n").over(upto)).filter("_upto >= _rank and _upto - _n < _rank")
    return found.select(*by, "_share", "_at", "_up", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), "_low", "_high")


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], least: int = 100_000) -> DataFrame:
    """(by, share, quantile): quantiles with linear interpolation, exact for groups of any size.

    Groups of at most ``least`` values use Spark's own percentile, which holds a
    group's values; larger ones are narrowed in rounds. A round sends BINS counts
    a task, group and order statistic at most, and divides the distance between
    the bounds by BINS; a value that many rows have ends it, as both bounds are that
    value. Null and NaN are left out; a group without values has no rows; a null key is a group.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    groups = stored(rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")), "groups")
    large = groups.filter(F.col("_n") > least)
    done, sought = None, stored(_sought(large, by, shares), "sought")
    while True:
        settled = sought.filter("_low = _high").select(*by, "_share", "_at", "_up", F.col("_low").alias("_value"))
        done = settled if done is None else done.unionAll(settled)
        open_ = sought.filter("_low < _high")
        if open_.isEmpty():
            break
        sought = stored(_round(rows, open_, by), "sought")
    value_at = lambda up: F.max(F.when(F.col("_up") == up, F.col("_value")))
    ends = done.groupBy(*by, "_share", "_at").agg(value_at(0).alias("_a"), value_at(1).alias("_b"))
    part = F.col("_at") - F.floor("_at")
    result = ends.select(*by, F.col("_share").alias("share"), F.when(F.col("_b").isNull(), F.col("_a")).otherwise(F.col("_a") * (1 - part) + F.col("_b") * part).alias("quantile"))
    few = groups.filter(F.col("_n") <= least).select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)])
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    inside = rows.join(few, same, "left_semi").groupBy(*by).agg(F.percentile("_v", F.array(*[F.lit(float(s)) for s in shares])).alias("_qs"))
    if not by:
        inside = inside.filter("_qs is not null")
    pairs = F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("share"), F.col("_qs").alias("quantile"))
    small = inside.select(*by, F.explode(pairs).alias("_q")).select(*by, F.col("_q.share").alias("share"), F.col("_q.quantile").alias("quantile"))
    return result.unionAll(small)


@query("""
SELECT l_linestatus, share, round(CASE share WHEN 0.05 THEN a[1] WHEN 0.5 THEN a[2] ELSE a[3] END, 4) AS quantile
FROM (SELECT l_linestatus, quantile_cont(l_extendedprice, [0.05, 0.5, 0.99]) AS a FROM lineitem GROUP BY l_linestatus), (SELECT unnest([0.05, 0.5, 0.99]::DOUBLE[]) AS share)
""")
def agg_exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups that hold all rows, narrowed in rounds."""
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_extendedprice", [0.05, 0.5, 0.99], least=1000)
    return found.select("l_linestatus", "share", F.round("quantile", 4).alias("quantile"))

"""As-of joins, sessions and time windows over bounded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table


def as_of_join(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str], cell: int, strict: bool = False) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    ``at`` is a whole number (microseconds, say), ``values`` the right columns.
    Rows are dealt by key and time cell of length ``cell``, so that a hot key is
    spread; a cell that starts without a right row takes the last one of the
    cells before it, found on one row per key and cell. With ``strict`` the right
    row must be earlier. Null keys and times match nothing, and such rows are
    dealt by all their columns; among right rows of one time the greatest values win.
    """
    own = F.struct(at, *values)
    mixed = left.select(*left.columns, F.lit(None).cast(right.select(own.alias("x")).schema["x"].dataType).alias("_r"))
    other = right.filter(F.col(by).isNotNull() & F.col(at).isNotNull()).select(by, at, own.alias("_r"))
    rows = mixed.withColumn("_left", F.lit(1)).unionByName(other.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    timed = F.col(by).isNotNull() & F.col(at).isNotNull()
    dealt = F.xxhash64(*[c for c, kind in left.dtypes if "map<" not in kind])
    rows = rows.withColumn("_cell", F.when(timed, F.floor(F.col(at) / cell)).otherwise(dealt))
    order = [F.col(at), (F.col("_left") * (-1 if strict else 1)).alias("_o"), F.col("_r").asc_nulls_last()]
    inside = Window.partitionBy(by, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_hit", F.last("_r", ignorenulls=True).over(inside)).filter("_left = 1")
    last = rows.filter(timed).groupBy(by, "_cell").agg(F.max("_r").alias("_last"))
    before = Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col(by).alias("_k"), F.col("_cell").alias("_c"), F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    joined = found.join(carried, (F.col(by) == F.col("_k")) & (F.col("_cell") == F.col("_c")), "left")
    best = F.when(timed, F.coalesce("_hit", "_carry"))
    return joined.select(*left.columns, best[at].alias(f"{at}_right"), *[best[v].alias(v) for v in values])


@query("""
WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'purchase'),
c AS (SELECT user_id, epoch_us(ts) AS at, event_id AS click_id FROM events WHERE event_type = 'click')
SELECT p.event_id, p.user_id, p.at, c.at AS at_right, c.click_id FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.at >= c.at
""")
def as_of_last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    bought = events.filter("event_type = 'purchase'").drop("event_type")
    clicks = events.filter("event_type = 'click'").select("user_id", "at", F.col("event_id").alias("click_id"))
    return as_of_join(bought, clicks, "user_id", "at", ["click_id"], 86_400_000_000)


@query("""
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, min(epoch_us(ts)) AS started, count(*) AS n, round(sum(value), 2) AS value FROM s GROUP BY user_id, sid
""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after six hours without an event."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    grouped = rows.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return grouped.select("user_id", F.unix_micros("w.start").alias("started"), "n", "value")


@query("SELECT epoch_us(date_trunc('day', ts)) AS started, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    grouped = rows.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return grouped.select(F.unix_micros("w.start").alias("started"), "event_type", "n", "value")


@query("""
SELECT epoch_us(date_trunc('day', ts)) - k * 43200000000 + 43200000000 * (hour(ts) // 12) AS started, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY 1
""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that start every twelve hours."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("at", "1 day", "12 hours").alias("w")).agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("started"), "n")

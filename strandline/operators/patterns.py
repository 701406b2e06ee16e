"""Ordered patterns of events, by an automaton over each key's events in time order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table


def _carried(rows: DataFrame, by: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the last non-null ``value`` of the key's earlier rows.

    Inside a cell by a window; what the cells before it left comes from one row a
    key and cell. Both windows have rows that don't grow with how hot a key is.
    """
    inside = Window.partitionBy(by, "_cell").orderBy(*order)
    seen = rows.withColumn("_own", value)
    seen = seen.withColumn("_here", F.last("_own", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    left = seen.groupBy(by, "_cell").agg(F.max(F.when(F.col("_own").isNotNull(), F.struct(*order, "_own")))["_own"].alias("_left"))
    cells = Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    handed = left.select(F.col(by).alias("_k"), F.col("_cell").alias("_c"), F.last("_left", ignorenulls=True).over(cells).alias("_before"))
    met = seen.join(handed, (F.col(by) == F.col("_k")) & (F.col("_cell") == F.col("_c")))
    return met.withColumn(name, F.coalesce("_here", "_before")).drop("_own", "_here", "_before", "_k", "_c")


def match_pattern(events: DataFrame, by: str, at: str, kind: str, pattern: list[str], within: int, cell: int, tie: str) -> DataFrame:
    """Events that end ``pattern``, with the latest time at which it can have begun (``began_at``).

    The pattern's kinds must come in this order, others may lie between, and first
    and last are at most ``within`` apart. State k of the automaton holds the latest
    beginning of a run through the first k kinds: an event of kind k + 1 hands it on,
    and the last kind ends it. ``at`` is a whole number, ``tie`` orders events of
    one time; ``cell`` is the time that one task takes in one go of a key. Rows without
    key, time or kind are left out; the columns' names may not begin with an underscore.
    """
    rows = events.filter(reduce(lambda a, c: a & F.col(c).isNotNull(), [by, at, kind], F.col(kind).isin(pattern)))
    rows = rows.withColumn("_cell", F.floor(F.col(at) / cell))
    state: Column = F.col(at)
    for k, step in enumerate(pattern[:-1]):
        rows = _carried(rows, by, [at, tie], F.when(F.col(kind) == step, state), f"_state{k}")
        state = F.col(f"_state{k}")
    ended = rows.filter((F.col(kind) == pattern[-1]) & (state >= F.col(at) - within))
    return ended.select(*events.columns, state.alias("began_at"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS moment FROM events)
SELECT p.event_id, p.user_id, p.moment, max(c.moment) AS began_at
FROM e p JOIN e v ON v.user_id = p.user_id AND (v.moment, v.event_id) < (p.moment, p.event_id) JOIN e c ON c.user_id = p.user_id AND (c.moment, c.event_id) < (v.moment, v.event_id)
WHERE p.event_type = 'purchase' AND v.event_type = 'view' AND c.event_type = 'click' AND c.moment >= p.moment - 172800000000 GROUP BY ALL
""")
def pattern_click_view_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases after a view after a click, all in two days, with the latest click."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("moment"))
    day = 86_400_000_000
    found = match_pattern(events, "user_id", "moment", "event_type", ["click", "view", "purchase"], 2 * day, day // 2, "event_id")
    return found.drop("event_type")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS moment FROM events)
SELECT b.event_id, max(a.moment) AS began_at FROM e a JOIN e b ON a.user_id = b.user_id AND (a.moment, a.event_id) < (b.moment, b.event_id)
WHERE a.event_type = 'error' AND b.event_type = 'error' AND b.moment - a.moment <= 3600000000 GROUP BY 1
""")
def pattern_repeated_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error within an hour of another of the same user: a kind may stand twice in a pattern."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("moment"))
    return match_pattern(events, "user_id", "moment", "event_type", ["error", "error"], 3_600_000_000, 3_600_000_000, "event_id").select("event_id", "began_at")

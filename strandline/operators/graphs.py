"""Reachability over tables of edges, and recursive queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.scratch import stored
from ..sources.tables import table
from .skew import _dealt


def reachable(edges: DataFrame, starts: DataFrame, most_hops: int, most: int = 200_000) -> DataFrame:
    """(node, hops): every node that a path of at most ``most_hops`` edges reaches from ``starts``, with the fewest.

    ``edges`` are (src, dst), ``starts`` (node). Rounds over the frontier: each
    joins it with the edges and leaves out what was reached before, so cycles end
    and a node is expanded once. Nodes with more than ``most`` edges are
    dealt into parts before the first round, and a frontier's row is copied to them.
    Each round is stored, so that plans don't grow. Null ends are no edges.
    """
    known = edges.filter("src is not null and dst is not null").select("src", "dst")
    hot = stored(known.groupBy("src").agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")).filter("_parts > 1"), "hubs")
    dealt = known.join(hot, "src", "left").withColumn("_part", _dealt(known, F.coalesce("_parts", F.lit(1))))
    dealt = stored(dealt.select("src", "_part", "dst"), "edges")
    seen = stored(starts.filter("node is not null").select("node").distinct().withColumn("hops", F.lit(0)), "reached")
    frontier = seen
    for hop in range(1, most_hops + 1):
        spread = frontier.select(F.col("node").alias("src")).join(hot, "src", "left")
        spread = spread.select("src", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"))
        found = dealt.join(spread, ["src", "_part"]).select(F.col("dst").alias("node")).distinct()
        frontier = stored(found.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


@query("""
WITH RECURSIVE e AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem WHERE l_quantity >= 49 AND l_discount = 0.05),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r(node, hops) AS (SELECT DISTINCT 'p' || p_partkey, 0 FROM part WHERE p_partkey % 400 = 0 UNION SELECT b.dst, r.hops + 1 FROM r JOIN b ON b.src = r.node WHERE r.hops < 6)
SELECT node, min(hops)::INTEGER AS hops FROM r GROUP BY node
""")
def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers that a chain of large deliveries links to some parts; the graph is full of cycles."""
    big = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49 and l_discount = 0.05")
    edges = big.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"))
    both = edges.unionAll(edges.select(F.col("dst"), F.col("src")))
    starts = table(spark, sf_dir, "part").filter("p_partkey % 400 = 0").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("node"))
    return reachable(both, starts, 6)


@query("""
WITH RECURSIVE p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, value FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, nth, value AS level FROM p WHERE nth = 1 UNION ALL SELECT p.user_id, p.nth, 0.5 * r.level + 0.5 * p.value FROM r JOIN p ON p.user_id = r.user_id AND p.nth = r.nth + 1 WHERE r.nth < 12)
SELECT user_id, nth, level FROM r
""")
def recursive_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive query: each user's first twelve purchases, smoothed exponentially.

    Spark's WITH RECURSIVE ends with an error beyond a million rows and joins the
    whole table anew in each round. A chain stays inside a user here, so its rounds
    are steps of a fold over at most twelve values, in one pass over the table.
    """
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "event_id", "value")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_id").asc_nulls_last()))
    first = bought.withColumn("nth", nth).filter("nth <= 12 and (nth = 1 or user_id is not null)").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("nth", "value"))).alias("own"))
    step = lambda done, x: F.concat(done, F.array(F.struct(x["nth"].cast("long").alias("nth"), F.when(x["nth"] == 1, x["value"]).otherwise(0.5 * F.element_at(done, -1)["level"] + 0.5 * x["value"]).alias("level"))))
    return first.select("user_id", F.inline(F.aggregate("own", F.lit([]).cast("array<struct<nth: bigint, level: double>>"), step)))

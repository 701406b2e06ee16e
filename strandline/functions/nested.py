"""Arrays, higher-order functions and vector similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays as a double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


@query("""
SELECT vec_id, label, round(list_aggregate(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), 'sum'), 6) AS norm2, len(list_filter(embedding, lambda x: x > 0)) AS positive,
       list_contains(list_transform(embedding, lambda x: x > 2), true) AS any_large
FROM embeddings
""")
def nested_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.round(dot(e, e), 6).alias("norm2"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"), F.exists(e, lambda x: x > 2).alias("any_large")
    )


@query("""
SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, pos
""")
def nested_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label, one row for each place."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    return rows.groupBy("label", (F.col("at") + 1).cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey")
def nested_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("keys")
    )


@query("""
SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS last_role, string_agg(role, '>' ORDER BY turn) AS path FROM conversations GROUP BY conv_id
""")
def nested_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ">")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by("role", "turn").alias("last_role"), path.alias("path"))


@query("""
SELECT user_id, count(DISTINCT event_type) AS n_types, count(*) FILTER (event_type = 'click') AS clicks, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types
FROM events GROUP BY user_id
""")
def nested_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map from event type to count for each user, and what it holds."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    zero = F.lit(0).cast("long")
    return maps.select("user_id", F.size("m").cast("long").alias("n_types"), F.coalesce(F.try_element_at("m", F.lit("click")), zero).alias("clicks"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("types"))


@query("""
SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding, b.embedding) / sqrt(list_dot_product(a.embedding, a.embedding)) / sqrt(list_dot_product(b.embedding, b.embedding)), 3) AS similarity
FROM embeddings AS a JOIN embeddings AS b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
""")
def nested_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine similarity of each hundredth vector with all others of its label."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))

    known = vectors.select("vec_id", "label", "v", F.sqrt(dot(F.col("v"), F.col("v"))).alias("size"))
    few = known.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("a"), "label", F.col("v").alias("va"), F.col("size").alias("sa"))
    pairs = few.join(known, "label").filter(F.col("a") != F.col("vec_id"))
    return pairs.select("a", F.col("vec_id").alias("b"), F.round(dot(F.col("va"), F.col("v")) / F.col("sa") / F.col("size"), 3).alias("similarity"))

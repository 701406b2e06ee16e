"""Semi-structured columns: JSON parsed once to a typed variant, read by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table


def parsed(json: Column) -> Column:
    """A variant; null where the text is null or no JSON."""
    return F.try_parse_json(json)


def at(value: Column, path: str, kind: str) -> Column:
    """The value at a path as ``kind``; null where the path is missing or the value doesn't fit."""
    return F.try_variant_get(value, path, kind)


@query("""
SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS whole, json_extract(props, '$.none')::BIGINT AS none FROM events
""")
def variant_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = table(spark, sf_dir, "events").select("event_id", parsed(F.col("props")).alias("v"))
    return props.select("event_id", at(F.col("v"), "$.k", "long").alias("k"), (F.schema_of_variant(F.variant_get("v", "$.k", "variant")) == "BIGINT").alias("whole"), at(F.col("v"), "$.none", "long").alias("none"))


@query("""
WITH b AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"k": ' WHEN 1 THEN '{"k": "many"}' WHEN 2 THEN '{"list": [1, {"k": ' || event_id || '}]}' WHEN 3 THEN NULL ELSE props END AS t FROM events)
SELECT event_id, CASE event_id % 5 WHEN 4 THEN json_extract(t, '$.k')::BIGINT WHEN 2 THEN event_id END AS k, event_id % 5 IN (0, 3) AS nothing FROM b
""")
def variant_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are cut off, null, of another type or of another shape: each has its defined value."""
    n = F.col("event_id") % 5
    text = F.when(n == 0, '{"k": ').when(n == 1, '{"k": "many"}').when(n == 2, F.concat(F.lit('{"list": [1, {"k": '), F.col("event_id").cast("string"), F.lit("}]}"))).when(n == 4, F.col("props"))
    v = table(spark, sf_dir, "events").select("event_id", parsed(text).alias("v"))
    return v.select("event_id", F.coalesce(at(F.col("v"), "$.k", "long"), at(F.col("v"), "$.list[1].k", "long")).alias("k"), F.col("v").isNull().alias("nothing"))


@query("""
SELECT CASE json_type(x) WHEN 'VARCHAR' THEN 'text' WHEN 'DOUBLE' THEN 'number' ELSE 'whole' END AS kind, count(*) AS n, sum(CASE WHEN json_type(x) = 'UBIGINT' THEN x::BIGINT END)::BIGINT AS total
FROM (SELECT unnest(json_extract('[' || user_id || ', ' || value || ', "' || event_type || '"]', '$[*]')) AS x FROM events) GROUP BY 1
""")
def variant_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of arrays of mixed types, a row each."""
    text = F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(", "), F.format_string("%.2f", "value"), F.lit(', "'), F.col("event_type"), F.lit('"]'))
    rows = table(spark, sf_dir, "events").select(parsed(text).alias("v"))
    each = spark.sql("SELECT value AS x, schema_of_variant(value) AS s FROM {rows}, LATERAL variant_explode(v)", rows=rows)
    kind = F.when(F.col("s") == "STRING", "text").when(F.col("s") == "BIGINT", "whole").otherwise("number")
    return each.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("s") == "BIGINT", F.variant_get("x", "$", "long"))).alias("total"))

"""String, regular-expression, date, JSON and numeric functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table


@query("""
SELECT c_custkey, upper(c_mktsegment) AS up, length(c_name) AS len, substr(c_name, 1, 4) AS head, replace(c_name, '#', '-') AS dashed, reverse(c_name) AS back,
       lpad(c_custkey::VARCHAR, 8, '0') AS padded, strpos(c_name, '0') AS zero, concat_ws('|', c_mktsegment, c_nationkey::VARCHAR) AS joined, md5(c_name) AS digest
FROM customer
""")
def scalar_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.upper("c_mktsegment").alias("up"),
        F.length("c_name").cast("long").alias("len"),
        F.substring("c_name", 1, 4).alias("head"),
        F.replace("c_name", F.lit("#"), F.lit("-")).alias("dashed"),
        F.reverse("c_name").alias("back"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"),
        F.instr("c_name", "0").cast("long").alias("zero"),
        F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("joined"),
        F.md5("c_name").alias("digest"),
    )


@query(r"""
SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, regexp_replace(p_type, '[AEIOU]', '', 'g') AS consonants, regexp_matches(p_name, '^[a-m]') AS early, len(string_split(p_name, ' ')) AS n_words
FROM part
""")
def scalar_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"),
        F.regexp_replace("p_type", "[AEIOU]", "").alias("consonants"),
        F.col("p_name").rlike("^[a-m]").alias("early"),
        F.size(F.split("p_name", " ")).cast("long").alias("n_words"),
    )


@query("""
SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, dayofweek(o_orderdate) + 1 AS dow, date_trunc('month', o_orderdate)::TIMESTAMP AS month,
       date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS days, (last_day(o_orderdate::DATE) - o_orderdate::DATE)::BIGINT AS to_end, strftime(o_orderdate, '%Y-%m') AS label
FROM orders
""")
def scalar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    whole = lambda c: c.cast("long")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        whole(F.year(d)).alias("y"),
        whole(F.quarter(d)).alias("q"),
        whole(F.dayofweek(d)).alias("dow"),
        F.date_trunc("month", d).cast("timestamp_ntz").alias("month"),
        whole(F.datediff(d, F.lit("1995-01-01"))).alias("days"),
        whole(F.datediff(F.last_day(d), d)).alias("to_end"),
        F.date_format(d, "yyyy-MM").alias("label"),
    )


@query("SELECT k, count(*) AS n, round(sum(value), 2) AS value FROM (SELECT json_extract_string(props, '$.k')::INT AS k, value FROM events) GROUP BY k")
def scalar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k"), "value")
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_extendedprice), 6) AS ln, floor(l_quantity / 7)::BIGINT AS sevens, round(sqrt(l_quantity), 6) AS root, round(pow(1 + l_tax, 2), 6) AS squared,
       sign(l_discount - 0.05)::INT AS side, greatest(l_tax, l_discount) AS larger, l_orderkey % 7 AS rest
FROM lineitem
""")
def scalar_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(F.log("l_extendedprice"), 6).alias("ln"),
        F.floor(F.col("l_quantity") / 7).alias("sevens"),
        F.round(F.sqrt("l_quantity"), 6).alias("root"),
        F.round(F.pow(1 + F.col("l_tax"), F.lit(2)), 6).alias("squared"),
        F.signum(F.col("l_discount") - 0.05).cast("int").alias("side"),
        F.greatest("l_tax", "l_discount").alias("larger"),
        (F.col("l_orderkey") % 7).alias("rest"),
    )


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS class, nullif(c_mktsegment, 'BUILDING') AS other, coalesce(nullif(c_nationkey, 3), -1) AS nation,
       c_acctbal BETWEEN 0 AND 100 AS low
FROM customer
""")
def scalar_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(b < 0, "debt").when(b < 5000, "some").otherwise("rich").alias("class"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("other"),
        F.coalesce(F.nullif("c_nationkey", F.lit(3)), F.lit(-1)).alias("nation"),
        b.between(0, 100).alias("low"),
    )

"""User-defined functions for what built-in ones can't do: vectorised scalars, table functions, lateral subqueries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType

from ..plans.registry import query
from ..sources.tables import table


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of two names, 1 for equal ones: common letters within half the longer name, swaps, and a shared beginning."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken, strict=True) if t]
    m, swaps = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    same = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return same + 0.1 * start * (1 - same) if same > 0.7 else same


@pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity, an Arrow batch at a time; pairs that recur in a batch are compared once."""
    pairs = pd.DataFrame({"a": a, "b": b})
    found = {p: jaro_winkler(*p) for p in set(pairs.dropna().itertuples(index=False, name=None))}
    return pd.Series([found.get(p) for p in zip(a, b, strict=True)], dtype="float64")


@udtf(returnType="user_id long, filled long, n long, value double")
class Parcels:
    """Rows of a partition packed in order: a parcel is full once its value is at least ``LIMIT``."""

    LIMIT = 200.0

    def __init__(self) -> None:
        self.user, self.filled, self.n, self.value = None, 0, 0, 0.0

    def _row(self) -> tuple:
        return self.user, self.filled, self.n, round(self.value, 2)

    def eval(self, row: Row) -> Iterator[tuple]:
        self.user, self.n, self.value = row["user_id"], self.n + 1, self.value + row["value"]
        if self.value >= self.LIMIT:
            yield self._row()
            self.filled, self.n, self.value = self.filled + 1, 0, 0.0

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self._row()


@query("""
SELECT CAST(floor(l_extendedprice * (1 - l_discount) / 1000) AS BIGINT) AS class, count(*) AS n FROM lineitem GROUP BY 1
""")
def udf_price_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of a discounted price: a column expression, as it needs no function of one's own."""
    price = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(price.alias("class")).agg(F.count("*").alias("n"))


@query("""
SELECT word, place, count(*) AS n FROM (
  SELECT unnest(string_split(p_name, ' ')) AS word, CAST(unnest(range(len(string_split(p_name, ' ')))) AS INTEGER) AS place FROM part)
GROUP BY word, place
""")
def udtf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their places: a built-in table function does it."""
    words = table(spark, sf_dir, "part").select(F.posexplode(F.split("p_name", " ")).alias("place", "word"))
    return words.groupBy("word", "place").agg(F.count("*").alias("n"))


@query("""
SELECT p_brand, p_type, round(avg(jaro_winkler_similarity(p_name, lower(p_type))), 5) AS similarity, max(jaro_winkler_similarity(p_name, lower(p_type))) > 0.6 AS any_close FROM part GROUP BY 1, 2
""")
def udf_name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_brand", "p_type", name_similarity("p_name", F.lower("p_type")).alias("s"))
    return parts.groupBy("p_brand", "p_type").agg(F.round(F.avg("s"), 5).alias("similarity"), (F.max("s") > 0.6).alias("any_close"))


@query("""
WITH RECURSIVE p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events WHERE event_type = 'purchase'),
r AS (
  SELECT user_id, nth, 0 AS filled, value AS total FROM p WHERE nth = 1
  UNION ALL
  SELECT p.user_id, p.nth, filled + CASE WHEN total >= 200 THEN 1 ELSE 0 END, CASE WHEN total >= 200 THEN 0 ELSE total END + value FROM r JOIN p ON p.user_id = r.user_id AND p.nth = r.nth + 1)
SELECT user_id, filled::BIGINT AS filled, count(*) AS n, round(max(total), 2) AS value FROM r GROUP BY user_id, filled
""")
def udtf_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases packed into parcels: a sum that starts anew when it is full, which no window frame can say."""
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "event_id", "value")
    return Parcels(bought.asTable().partitionBy("user_id").orderBy("event_id"))


@query("""
SELECT c_custkey, n, most FROM customer, LATERAL (SELECT count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal)
WHERE n > 0
""")
def lateral_orders_above_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated subquery as a join by its equal key and an aggregate.

    Spark takes a LATERAL with an inequality apart into a nested loop of all
    customers and orders. Customers alike in key and balance are counted, so
    that each still has a row of its own.
    """
    alike = table(spark, sf_dir, "customer").groupBy("c_custkey", "c_acctbal").agg(F.count("*").alias("alike"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    dearer = orders.join(alike, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > F.col("c_acctbal")))
    found = dearer.groupBy("c_custkey", "c_acctbal", "alike").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))
    return found.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike")))).select("c_custkey", "n", "most")


@pandas_udf(DoubleType())
def trimmed_mean(values: pd.Series) -> float:
    """The mean without the lowest and highest tenth."""
    own = values.dropna().sort_values()
    cut = len(own) // 10
    return float(own.iloc[cut : len(own) - cut].mean()) if len(own) else None


@query("""
SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) AS trimmed FROM (
  SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus, o_custkey % 40) AS n FROM orders
  WINDOW w AS (PARTITION BY o_orderpriority, o_orderstatus, o_custkey % 40 ORDER BY o_totalprice))
WHERE nth > n // 10 AND nth <= n - n // 10 AND o_custkey % 40 = 7 GROUP BY 1, 2
""")
def udaf_trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped aggregate of one's own, for groups known to be small; large ones take the sketches."""
    orders = table(spark, sf_dir, "orders").filter("o_custkey % 40 = 7")
    return orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.round(trimmed_mean("o_totalprice"), 4).alias("trimmed"))

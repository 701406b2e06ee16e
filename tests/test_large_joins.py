"""Skewed equi-joins, overlapping intervals and inequality counts against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators.dominance import count_below, earlier_and_lower
from strandline.operators.intervals import interval_join
from strandline.operators.skew import hot_keys, skew_join
from strandline.plans.registry import load


def keyed(seed, n, name):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot", "hot", None, *"abcdefgh"]), f"{name}{i}") for i in range(n)]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_skew_join(spark, how, most):
    a, b = keyed(1, 120, "a"), [r for r in keyed(2, 60, "b") if r[1] not in ("a", "b")]
    left, right = spark.createDataFrame(a, "i long, k string, x string"), spark.createDataFrame(b, "j long, k string, y string")
    found = Counter((r.i, r.k, r.j, r.y) for r in skew_join(left, right, ["k"], how, most).collect())
    want = Counter((i, k, j, y) for i, k, _ in a for j, l, y in b if k == l is not None)
    if how == "left":
        known = {l for _, l, _ in b if l}
        want += Counter((i, k, None, None) for i, k, _ in a if k not in known)
    assert found == want


def test_no_task_has_a_hot_key(spark):
    """One key has half of the rows; no task of the join reads over twice the median."""
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"))
    other = spark.range(1).select(F.lit(0).cast("long").alias("k"), F.lit(1).alias("y"))
    assert hot_keys(rows, other, ["k"], 1000).collect() == [(0, 20, 1)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("8", "false", "-1"), strict=True):
            spark.conf.set(k, v)
        big = rows.unionAll(rows.select((F.col("id") + 40_000).alias("id"), "k"))
        joined = skew_join(big, rows.select("k", F.col("id").alias("y")).filter("k <> 0").unionAll(other.select("k", F.lit(5).cast("long").alias("y"))), ["k"], most=500)
        sizes = sorted(r["count"] for r in joined.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[3]


def spans(seed, n, name):
    rng = random.Random(seed)
    rows = [(f"{name}{i}", rng.choice("xy"), lo := rng.randrange(-300, 300), lo + rng.choice([-3, 0, 1, 2, 3, 8, 40, 500])) for i in range(n)]
    return [*rows, (f"{name}null", "x", None, 5), (f"{name}open", "x", 1, None), (f"{name}wide", "x", -(1 << 40), 1 << 40)]


@pytest.mark.parametrize("most", [4, 100_000])
@pytest.mark.parametrize("by", [(), ("k",)])
def test_intervals(spark, most, by):
    a, b = spans(3, 80, "a"), spans(4, 60, "b")
    left = spark.createDataFrame(a, "x string, k string, alo long, ahi long")
    right = spark.createDataFrame(b, "y string, k string, blo long, bhi long")
    right = right if by else right.drop("k")
    found = [(r.x, r.y) for r in interval_join(left, right, ("alo", "ahi"), ("blo", "bhi"), by, most).collect()]
    full = lambda r: None not in r and r[2] < r[3]
    want = {(p[0], q[0]) for p in a for q in b if full(p) and full(q) and p[2] < q[3] and q[2] < p[3] and (not by or p[1] == q[1])}
    assert len(found) == len(set(found))
    assert set(found) == want


def test_hot_cell(spark):
    """All intervals lie in one cell; every pair is found once, over several parts."""
    left = spark.range(300).select("id", F.lit(0).cast("long").alias("alo"), F.lit(2).cast("long").alias("ahi"))
    right = spark.range(200).select(F.col("id").alias("other"), F.lit(1).cast("long").alias("blo"), F.lit(3).cast("long").alias("bhi"))
    found = interval_join(left, right, ("alo", "ahi"), ("blo", "bhi"), most=50)
    assert found.count() == found.distinct().count() == 300 * 200


def test_pairs_of_small_intervals_are_spread(spark):
    """Rows of a few kilobytes make 90,000 pairs; Spark would put them together in one task by their bytes."""
    left = spark.range(3000).select("id", (F.col("id") * 10).alias("alo"), (F.col("id") * 10 + 150).alias("ahi"))
    right = spark.range(3000).select(F.col("id").alias("other"), (F.col("id") * 10).alias("blo"), (F.col("id") * 10 + 151).alias("bhi"))
    found = interval_join(left, right, ("alo", "ahi"), ("blo", "bhi"))
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    near = [sum(1 for j in range(max(0, i - 15), min(3000, i + 15))) for i in range(3000)]
    assert sum(sizes) == sum(near)
    assert len(sizes) >= 16 and max(sizes) <= sum(sizes) / 4


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 1000])
def test_merge(n):
    own = np.random.default_rng(n).permutation(n)
    assert earlier_and_lower(own).tolist() == [sum(own[j] < own[i] for j in range(i)) for i in range(n)]


@pytest.mark.parametrize("block", [None, 7, 64])
def test_count_below(spark, block):
    rng = random.Random(block)
    rows = [(i, rng.choice([None, 1, 1, 1, 2, 3, rng.randrange(50)]), rng.choice([None, 0.5, 0.5, 1.5, rng.random()])) for i in range(400)]
    found = {r.i: r.n for r in count_below(spark.createDataFrame(rows, "i long, a int, b double"), "a", "b", "n", block).collect()}
    full = [r for r in rows if None not in r]
    assert found == {i: 0 if None in (a, b) else sum(x < a and y < b for _, x, y in full) for i, a, b in rows}


def test_count_below_of_nothing(spark):
    assert count_below(spark.createDataFrame([], "a int, b int"), "a", "b", "n").count() == 0


@pytest.mark.parametrize("name", ["join_inequality_count", "join_intervals", "join_intervals_without_key", "join_skewed"])
def test_no_nested_loop(spark, sf_dir, name):
    plan = load()[0][name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

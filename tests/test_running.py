"""Running totals and numbers over whole tables, hot groups, ties and nulls."""

from __future__ import annotations

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from strandline.operators.running import number_rows, running_totals
from strandline.plans.registry import load


def rows():
    rng = random.Random(3)
    hot = [(i, "hot" if i % 3 else rng.choice([None, "a", "b"]), rng.choice([None, 1, 2, 5]), rng.choice([None, 0.5, 2.25])) for i in range(5000)]
    rng.shuffle(hot)
    return hot


@pytest.mark.parametrize("by", [(), ("k",)])
def test_totals(spark, by):
    own = rows()
    df = spark.createDataFrame(own, "id long, k string, v int, x double")
    found = {r.id: (r.vs, r.xs, r.n) for r in running_totals(df, [F.col("id").asc()], {"vs": "v", "xs": "x"}, by, "n").collect()}
    key = (lambda r: r[1] or "") if by else (lambda r: "")
    for _, group in groupby(sorted(own, key=lambda r: (key(r), r[0])), key):
        v = x = 0
        for n, r in enumerate(group, 1):
            v, x = v + (r[2] or 0), x + (r[3] or 0)
            assert found[r[0]] == (v, x, n)


def test_ties_are_spread(spark):
    df = spark.range(3000).select(F.lit("same").alias("k"), F.lit(1).alias("o"), "id")
    out = number_rows(df, [F.col("o").asc()], ("k",), "n", "size")
    assert sorted(r.n for r in out.collect()) == list(range(1, 3001))
    assert {r["size"] for r in out.select("size").collect()} == {3000}


def test_empty(spark):
    df = spark.createDataFrame([], "id long, v int")
    assert running_totals(df, [F.col("id").asc()], {"s": "v"}).count() == 0
    assert number_rows(df, [F.col("id").asc()], ("v",)).count() == 0


@pytest.mark.parametrize("name", ["running_revenue", "running_number_in_large_groups"])
def test_no_single_partition(spark, sf_dir, name):
    assert "SinglePartition" not in load()[0][name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()

"""Event patterns, reachability, buckets and variants on small cases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.functions.variants import at, parsed
from strandline.operators.graphs import reachable
from strandline.operators.patterns import match_pattern
from strandline.sources.buckets import write_buckets
from strandline.sources.scratch import scratch
from strandline.plans.registry import load

PATTERNS = [["a", "b"], ["a", "b", "c"], ["a", "a", "b"], ["a", "b", "a", "b"], ["c"]]


def latest_beginning(events, end, pattern, within):
    """The latest start of the pattern that ends at an event, by trying all earlier events."""
    best = None

    def back(i, k, start):
        nonlocal best
        if k < 0:
            best = start if best is None else max(best, start)
            return
        for j in range(i - 1, -1, -1):
            if events[j][2] == pattern[k] and events[end][1] - events[j][1] <= within:
                back(j, k - 1, events[j][1])

    if events[end][2] == pattern[-1]:
        back(end, len(pattern) - 2, events[end][1])
    return best


@pytest.mark.parametrize(("pattern", "cell"), [*[(p, 3) for p in PATTERNS], (PATTERNS[1], 1000)])
def test_pattern(spark, pattern, cell):
    rng = random.Random(cell)
    rows = [(i, rng.randrange(60), rng.choice("aabbcx"), rng.choice(["u", "hot", "hot", "hot"])) for i in range(120)]
    rows += [(900, None, "a", "u"), (901, 5, None, "u"), (902, 5, "a", None)]
    df = spark.createDataFrame(rows, "id long, t long, e string, k string")
    found = {r.id: r.began_at for r in match_pattern(df, "k", "t", "e", pattern, 12, cell, "id").collect()}
    want = {}
    for k in ("u", "hot"):
        own = sorted((r for r in rows if r[3] == k and None not in r), key=lambda r: (r[1], r[0]))
        want |= {own[i][0]: b for i in range(len(own)) if (b := latest_beginning(own, i, pattern, 12)) is not None}
    assert found == want


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_reachable(spark, most):
    """Cycles, loops, a hub, repeated edges, nodes without any edge and null ends."""
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(0, n) for n in range(30)] + [(7, 7), (None, 3), (3, None)]
    hops = {0: 0, 99: 0}
    frontier = [0, 99]
    for hop in range(1, 4):
        frontier = sorted({d for s, d in edges if s in frontier and d is not None and d not in hops})
        hops |= dict.fromkeys(frontier, hop)
    df = spark.createDataFrame(edges, "src long, dst long")
    starts = spark.createDataFrame([(0,), (0,), (99,), (None,)], "node long")
    found = [(r.node, r.hops) for r in reachable(df, starts, 3, most).collect()]
    assert sorted(found) == sorted(hops.items())


def test_cycle_ends(spark):
    ring = spark.range(5).select(F.col("id").alias("src"), ((F.col("id") + 1) % 5).alias("dst"))
    found = reachable(ring, spark.createDataFrame([(2,)], "node long"), 1000)
    assert sorted((r.node, r.hops) for r in found.collect()) == [(0, 3), (1, 4), (2, 0), (3, 1), (4, 2)]


def test_join_of_buckets_moves_nothing(spark, sf_dir):
    plan = load()[0]["join_bucketed"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert len(re.findall("Bucketed: true", plan)) == 2


def test_buckets(spark):
    rows = [(i % 7 if i % 5 else None, i) for i in range(200)]
    path = scratch(spark, "b")
    back = write_buckets(spark.createDataFrame(rows, "k int, v int"), "own_buckets", 4, ("k",), ("k", "v"), path)
    try:
        key = lambda r: (r[0] is not None, *(x or 0 for x in r))
        assert sorted(map(tuple, back.collect()), key=key) == sorted(rows, key=key)
        assert len({f for f in spark.read.parquet(path).inputFiles()}) <= 4
    finally:
        spark.sql("DROP TABLE own_buckets")


def test_variants(spark):
    texts = ['{"a": {"b": [1, 2.5, "x"]}}', '{"a": null}', "[]", "not json", None, "", '{"a": 99999999999999999999}', '{"a": {"b": [true]}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parsed(F.col("t")).alias("v"))
    found = [tuple(r) for r in df.orderBy("i").select(F.col("v").isNull(), at(F.col("v"), "$.a.b[0]", "int"), at(F.col("v"), "$.a.b[2]", "string"), at(F.col("v"), "$.a", "long")).collect()]
    assert found == [(False, 1, "x", None), (False, None, None, None), (False, None, None, None), (True, None, None, None), (True, None, None, None), (True, None, None, None), (False, None, None, None), (False, 1, None, None)]

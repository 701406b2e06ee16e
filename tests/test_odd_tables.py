"""Queries on small tables of odd rows, against their own SQL."""

from __future__ import annotations

import datetime as dt
import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.operators.intervals import overlap_totals
from strandline.plans.registry import load
from strandline.sources.scratch import _roots, scratch
from strandline.streaming.events import run_in_steps, timed
from strandline.streaming.state import alerts_of_inactivity, with_rocks

QUERIES, ORACLES = load()


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture
def as_its_sql(spark, tmp_path):
    """Runs a query and its SQL over tables that are given as DataFrames."""

    def check(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        ours = QUERIES[name](spark, str(tmp_path))
        found = con.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        want = sorted(repr([plain(v) for v in r]) for r in found.fetchall())
        assert sorted(repr([plain(r[c]) for c in names]) for r in ours.collect()) == want
        return ours

    return check


def test_lateral_without_a_nested_loop(spark, as_its_sql):
    """Customers alike in all, keys twice with other balances, nulls on both sides, orders of nobody."""
    customer = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, -2.0), (2, None), (None, 1.0), (3, 9.0), (4, 0.0)], "c_custkey long, c_acctbal double")
    orders = spark.createDataFrame([(1, 5.0), (1, 7.0), (1, None), (2, 8.0), (None, 8.0), (3, 9.0), (5, 99.0), (4, 0.5)], "o_custkey long, o_totalprice double")
    plan = as_its_sql("lateral_orders_above_balance", customer=customer, orders=orders)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_recursion_of_many_rows(spark, as_its_sql):
    """More rows than a recursive query of Spark's may have; users with fewer purchases than twelve, with none, with nulls."""
    rows = [(u * 100 + k, u, "purchase" if k % 3 else "view", float(u * k % 17)) for u in range(40) for k in range(u)]
    rows += [(9001, None, "purchase", 1.0), (9000, None, "purchase", 2.0), (9002, 41, "purchase", None), (9003, 41, "purchase", 4.0), (None, 5, "purchase", 8.0), (9004, 42, None, 1.0)]
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        as_its_sql("recursive_smoothing", events=spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double"))
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)


def test_skewed_sums_without_pairs(spark, tmp_path):
    """A million rows of one key on both sides: 10 ** 12 pairs, none of which is made."""
    rows = spark.range(1_000_000).selectExpr("id AS event_id", "id % 2 * 50 AS user_id", "'view' AS event_type", "CAST(1 AS double) AS value")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["join_skewed"](spark, str(tmp_path)).collect()] == [("view", 0, 10**12, 1e12)]


def test_skewed_sums_of_odd_rows(spark, as_its_sql):
    rows = [(i, u, e, v) for i, (u, e, v) in enumerate([(1, "a", 1.5), (51, "a", None), (6, "a", 2.5), (-49, "a", 3.0), (-1, "b", None), (None, "a", 7.0), (2, None, 7.0), (-51, "b", None), (3, "c", -0.25), (103, "c", 0.1)])]
    as_its_sql("join_skewed", events=spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double"))


HOURS = {
    "back_within_the_last_hour": [(1, 0), (2, 24 * 9), (1, 24 * 25), (1, 24 * 25 + 12.5)],
    "months": [(1, 0), (1, 24 * 40), (1, 24 * 60), (2, 24 * 33), (2, 24 * 33 + 5), (3, 24 * 90)],
    "nulls": [*[(None, h) for h in (30, 2, 0, 31, 60)], (1, 30), (2, 100), (None, 150), (3, None)],
    "end_of_silence": [(1, 0), (2, 13)],
}


@pytest.mark.parametrize("case", HOURS)
def test_inactivity(spark, as_its_sql, case):
    start = dt.datetime(2024, 1, 1)
    rows = [(u, None if h is None else start + dt.timedelta(hours=h)) for u, h in HOURS[case]]
    as_its_sql("stream_inactivity_alerts", events=spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").coalesce(1))


def test_late_rows_join_their_period(spark):
    """A row that comes in a later step but before the watermark closes the gap between two periods."""
    start = dt.datetime(2024, 1, 1)
    step = lambda *own: spark.createDataFrame([(u, start + dt.timedelta(hours=h)) for u, h in own], "user_id long, ts timestamp_ntz")
    steps = [step((1, 0), (1, 13)), step((1, 8)), step((1, 13.5), (2, 100))]
    found = with_rocks(spark, lambda: run_in_steps(lambda s: alerts_of_inactivity(timed(s, "10 hours"), "user_id", 12 * 3_600_000), steps, "late"))
    us = lambda h: int((start.replace(tzinfo=dt.UTC).timestamp() + h * 3600) * 1_000_000)
    assert [tuple(r) for r in found.collect()] == [(1, us(13.5), 4)]


def test_overlaps_of_odd_times(spark, as_its_sql):
    """Bounds that touch, times that run backwards, nulls, an event's id twice."""
    start = dt.datetime(2024, 1, 1)
    rng = random.Random(5)
    rows = [(i // 2, rng.choice([None, *range(6)]), rng.choice(["error", "view", "click"]), rng.randrange(0, 72 * 60), rng.choice([-700.0, -30.0, -0.4, 0.0, 0.5, 5.0, 90.0, 2000.0])) for i in range(300)]
    rows += [(900, 1, "error", None, 5.0), (901, 1, "error", 50, None), (902, 1, None, 50, 5.0), (903, 1, "view", None, 1.0), (None, 1, "error", 60, 9.0)]
    events = spark.createDataFrame([(i, u, e, None if m is None else start + dt.timedelta(minutes=m), v) for i, u, e, m, v in rows], "event_id long, user_id long, event_type string, ts timestamp_ntz, value double")
    as_its_sql("join_intervals_without_key", events=events)


def test_overlaps_without_pairs(spark):
    """Two million intervals that all overlap: 10 ** 12 pairs, none of which is made."""
    own = spark.range(1_000_000)
    left = own.select("id", (-F.col("id")).alias("alo"), (F.col("id") + 1).alias("ahi"))
    right = own.select((-F.col("id")).alias("blo"), (F.col("id") + 1).alias("bhi"), F.lit(2).alias("w"))
    found = overlap_totals(left, right, ("alo", "ahi"), ("blo", "bhi"), "id", "n", {"weight": "w"})
    assert found.agg(F.count("*"), F.min("n"), F.max("n"), F.min("weight"), F.max("weight")).collect() == [(10**6, 10**6, 10**6, 2 * 10**6, 2 * 10**6)]


@pytest.mark.parametrize("n", [0, 3, 4000])
def test_milestones(spark, as_its_sql, n):
    """A user with half of all events, users below the first milestone, nulls; twenty files make three micro-batches."""
    events = spark.range(n).select(F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, -7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 613).cast("long").alias("user_id"))
    before = set(commits(spark))
    as_its_sql("stream_milestones", events=events.repartition(20))
    assert len(set(commits(spark)) - before) <= 4


def commits(spark):
    scratch(spark, "root")
    root = next(path for key, path in _roots.items() if key[0] == spark.sparkContext.applicationId)
    return [p for p in glob.glob(f"{root.removeprefix('file:')}/milestones-state-*/commits/*") if os.path.basename(p).isdigit()]

"""Every registered query outside of the corpus operators against its counterpart."""

from __future__ import annotations

import pytest

from strandline.plans.registry import load

QUERIES, ORACLES = load()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, sf_dir, same_rows):
    same_rows(QUERIES[name](spark, sf_dir), ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filter_reaches_the_scan(spark, sf_dir):
    plan = QUERIES["scan_filter_project"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan
    assert "l_extendedprice" not in plan


@pytest.mark.parametrize(("name", "exact"), [
    ("agg_approx_distinct", "SELECT l_returnflag AS k, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1"),
    ("agg_merged_sketches", "SELECT o_orderpriority AS k, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1"),
])
def test_approximate_counts(name, exact, spark, sf_dir, duck):
    found = {r[0]: r["n"] for r in QUERIES[name](spark, sf_dir).collect()}
    want = dict(duck.execute(exact).fetchall())
    assert found.keys() == want.keys()
    assert all(abs(found[k] - n) <= 0.05 * n for k, n in want.items())


def test_all_but_approximate_have_a_counterpart():
    assert set(QUERIES) - set(ORACLES) == {"agg_approx_distinct", "agg_merged_sketches"}


def test_sessions_are_left_as_they_were(spark, sf_dir):
    before = {t.name for t in spark.catalog.listTables()}
    for name in ("udtf_parcels", "lateral_orders_above_balance", "recursive_smoothing", "variant_exploded"):
        QUERIES[name](spark, sf_dir).collect()
    assert {t.name for t in spark.catalog.listTables()} == before

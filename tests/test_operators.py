"""As-of and range joins on small cases."""

from __future__ import annotations

import pytest

from strandline.operators.joins import range_join
from strandline.operators.temporal import as_of_join
from strandline.sources import formats
from strandline.sources.scratch import scratch

LEFT = [(1, "a", 10), (2, "a", 5), (3, "a", 100), (4, "b", 7), (5, None, 9), (6, "a", None), (7, "a", 10)]
RIGHT = [("a", 5, "x"), ("a", 10, "y"), ("a", 10, "z"), ("a", 42, "w"), ("b", 8, "q"), (None, 1, "n")]


@pytest.mark.parametrize(("strict", "cell"), [(False, 1000), (False, 3), (True, 1000), (True, 3)])
def test_as_of(spark, strict, cell):
    left = spark.createDataFrame(LEFT, "id long, k string, t long")
    right = spark.createDataFrame(RIGHT, "k string, t long, v string")
    found = {r.id: (r.t_right, r.v) for r in as_of_join(left, right, "k", "t", ["v"], cell, strict).collect()}
    for i, k, t in LEFT:
        ok = [(rt, v) for rk, rt, v in RIGHT if k is not None and t is not None and rk == k and (rt < t if strict else rt <= t)]
        assert found[i] == max(ok, default=(None, None)), i


def test_range_join(spark):
    points = spark.createDataFrame([(1, 0.0), (2, 4.99), (3, 5.0), (4, -3.0), (5, None)], "id long, p double")
    bands = spark.createDataFrame([("a", 0.0, 5.0), ("b", -10.0, 20.0), ("c", 5.0, 1.0), ("d", None, 3.0)], "n string, lo double, hi double")
    found = {(r.id, r.n) for r in range_join(points, bands, "p", "lo", "hi", 2.0).collect()}
    assert found == {(1, "a"), (2, "a"), (1, "b"), (2, "b"), (3, "b"), (4, "b")}


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="none of"):
        formats.write(spark.range(1), scratch(spark, "x"), "xml")


def test_theta_on_a_growing_table(spark, sf_dir):
    from strandline.plans.registry import load

    found = load()[0]["join_theta_orders"](spark, sf_dir)
    assert any(f.endswith("/orders.parquet") for f in found.inputFiles())
    assert found.count() > spark.read.parquet(f"{sf_dir}/orders.parquet").count()

"""Queries that hold an approximate count to the exact one, against their counterparts; null keys and values too."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query and of its counterpart over one table that is written from a DuckDB query."""

    def run(name: str, table: str, rows: str) -> tuple[list, list]:
        path = tmp_path / f"{table}.parquet"
        con = duckdb.connect()
        con.execute(f"COPY ({rows}) TO '{path}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
        found = __spark_entry__.queries()[name](spark, str(tmp_path))
        theirs = con.execute(__spark_entry__.oracle_sql()[name])
        assert found.columns == [d[0] for d in theirs.description]
        return sorted(map(repr, map(tuple, found.collect()))), sorted(map(repr, theirs.fetchall()))

    return run


LINES = "SELECT CASE WHEN i % 4 < 3 THEN substr('ANR', (i % 4 + 1)::INT, 1) END AS l_returnflag, CASE WHEN i % 4 <> 1 AND i % 7 > 0 THEN i // 9 END AS l_orderkey FROM range(20000) t(i)"


@pytest.mark.parametrize("where", ["", " WHERE i < 0"])
def test_distinct_counts_are_exact(both, where):
    """Also of a group with a null key, of one with null values only, and of no rows."""
    ours, theirs = both("agg_approx_distinct", "lineitem", LINES + where)
    assert ours == theirs
    assert len(ours) == (0 if where else 4)


def test_distinct_keys_carry_no_sketch(spark, sf_dir):
    plan = __spark_entry__.queries()["agg_approx_distinct"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    sketched = [line for line in plan.splitlines() if "approx_count_distinct" in line and "Aggregate" in line]
    assert sketched
    assert not any("distinct l_orderkey" in line or "keys=[l_returnflag#" in line and ", l_orderkey#" in line.split("functions=")[0] for line in sketched)


ORDERS = """
SELECT CASE WHEN i % 5 < 4 THEN 'P' || (i % 5) END AS o_orderpriority, CASE WHEN i % 5 <> 1 AND i % 7 > 0 THEN i % 3000 END AS o_custkey,
       CASE WHEN i % 5 <> 2 AND i % 11 > 0 THEN TIMESTAMP '1969-11-30 23:59:59' + to_hours((i % 9000)::INT) END AS o_orderdate FROM range(20000) t(i)
"""


@pytest.mark.parametrize("where", ["", " WHERE i < 0"])
def test_merged_counts_are_exact(both, where):
    """Also with a null priority, of a group with null customers only, of one without dates, with some dates missing, and of no rows."""
    ours, theirs = both("agg_merged_sketches", "orders", ORDERS + where)
    assert ours == theirs
    assert len(ours) == (0 if where else 5)


@pytest.mark.parametrize("name", ["agg_approx_distinct", "agg_merged_sketches"])
def test_counts_on_given_tables(name, spark, sf_dir, same_rows):
    same_rows(__spark_entry__.queries()[name](spark, sf_dir), __spark_entry__.oracle_sql()[name])

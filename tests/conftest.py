"""A session for all tests, and the comparison with DuckDB."""

from __future__ import annotations

import os
import sys
import tempfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (list, np.ndarray)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return round(value, 6)
    return value if isinstance(value, (int, type(None))) else str(value)


@pytest.fixture(scope="session")
def same_rows(duck):
    """Compares a DataFrame with a DuckDB query: columns and rows in any order."""

    def check(df: DataFrame, sql: str) -> None:
        cols = sorted(df.columns)
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        theirs = sorted(repr([plain(r[k]) for k in at]) for r in found.fetchall())
        ours = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
        assert len(ours) == len(theirs)
        assert ours == theirs

    return check

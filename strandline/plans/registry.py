"""Queries by name, each with its DuckDB counterpart where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Counterparts of the queries that hold an approximate count to the exact one; not among those that ``load`` gives.
EXACT: dict[str, str] = {}


def query(sql: str | None = None, exact: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with ``sql`` as its counterpart, or ``exact`` if it holds an approximation to that."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        if exact:
            EXACT[f.__name__] = exact
        return f

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their counterparts."""
    from ..functions import nested, scalar, sketches, user_defined, variants  # noqa: F401
    from ..operators import aggregates, dominance, graphs, intervals, joins, patterns, quantiles, running, sets, skew, temporal, windows  # noqa: F401
    from ..sources import buckets, formats  # noqa: F401
    from ..streaming import events, state  # noqa: F401

    return QUERIES, ORACLES

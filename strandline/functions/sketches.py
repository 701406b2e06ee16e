"""Aggregates of one's own: mergeable sketches, filled in Arrow batches before the exchange and merged after it.

A task keeps one sketch a group, so what moves is a row a task and group, whatever
the number of rows. Sketches of a group are merged in two steps, first in a number
of parts, so that a group seen by very many tasks isn't merged by one. Both sketches
know a bound on their own error, which the queries use to give exact results:
heavy hitters are counted again among the candidates, quantiles are chosen from the
slice of values that the bound leaves.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.registry import query
from ..sources.scratch import stored
from ..sources.tables import table

#: Groups that a task holds before it passes its sketches on and starts anew.
MOST_GROUPS = 10_000
#: Parts in which the sketches of a group are merged first.
PARTS = 64
MAX_BROADCAST_BYTES = 64 << 20


class Sketch(Protocol):
    """What :func:`sketch_by` needs; sketches are pickled between tasks."""

    def add(self, values: pd.Series) -> None: ...

    def merge(self, other: Sketch) -> None: ...


class Frequent:
    """Counts of the most frequent items: at most ``size`` counters.

    A count is at most ``lost`` too low and never too high, and ``lost`` is at most
    ``n / (size + 1)``; so each item with more than that share of all is present.
    """

    def __init__(self, size: int):
        self.size, self.n, self.lost, self.counts = size, 0, 0, {}

    def add(self, values: pd.Series) -> None:
        found = values.value_counts()
        self.n += int(found.sum())
        self._gather(dict(zip(found.index, found.tolist(), strict=True)))

    def merge(self, other: Frequent) -> None:
        self.n, self.lost = self.n + other.n, self.lost + other.lost
        self._gather(other.counts)

    def _gather(self, counts: dict) -> None:
        for item, n in counts.items():
            self.counts[item] = self.counts.get(item, 0) + n
        if len(self.counts) > self.size:
            # The largest count that doesn't fit is taken off all: each unit takes size + 1 rows away.
            off = sorted(self.counts.values(), reverse=True)[self.size]
            self.lost += off
            self.counts = {item: n - off for item, n in self.counts.items() if n > off}


class Ranks:
    """Numbers by rank: levels of at most ``size`` values, one at level k standing for 2 ** k.

    A full level is sorted and every second value goes up. This moves a rank by at
    most 2 ** k, which is summed in ``error``: with levels of ``size`` values at
    most about n * log2(n / size) / size in all. NaN and null are left out.
    """

    def __init__(self, size: int = 512):
        self.size, self.n, self.error, self.turn, self.levels = size, 0, 0, 0, [np.zeros(0)]

    def add(self, values: pd.Series) -> None:
        own = values.dropna().to_numpy(float)
        self.n += len(own)
        self.levels[0] = np.concatenate([self.levels[0], own])
        self._compact()

    def merge(self, other: Ranks) -> None:
        self.n, self.error = self.n + other.n, self.error + other.error
        while len(self.levels) < len(other.levels):
            self.levels.append(np.zeros(0))
        for k, own in enumerate(other.levels):
            self.levels[k] = np.concatenate([self.levels[k], own])
        self._compact()

    def _compact(self) -> None:
        k = 0
        while k < len(self.levels):
            own = self.levels[k]
            if len(own) > self.size:
                own = np.sort(own)
                even = len(own) // 2 * 2
                if k + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                self.levels[k + 1] = np.concatenate([self.levels[k + 1], own[self.turn : even : 2]])
                self.levels[k] = own[even:]
                self.turn ^= 1
                self.error += 1 << k
            k += 1

    def bracket(self, rank: int) -> tuple[float, float]:
        """Values between which the one of this rank (from 1) is sure to lie; infinite where nothing is known."""
        values = np.concatenate(self.levels)
        weights = np.repeat([1 << k for k in range(len(self.levels))], [len(x) for x in self.levels])
        order = np.argsort(values)
        values, upto = values[order], np.cumsum(weights[order])
        # upto differs by at most ``error`` from the number of values that are not larger.
        low = np.searchsorted(upto, rank - self.error, side="left")
        high = np.searchsorted(upto, rank + self.error, side="left")
        first = values[low - 1] if low > 0 else -np.inf
        return float(first), float(values[high]) if high < len(values) else float(np.inf)


def _partial(by: list[str], value: str, make: Callable[[], Sketch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        part, schema = TaskContext.get().partitionId() % PARTS, None

        def out() -> pa.RecordBatch:
            keys = [pa.array([k[i] for k in held], schema.field(b).type) for i, b in enumerate(by)]
            states = pa.array([pickle.dumps(s) for s in held.values()], pa.binary())
            batch = pa.RecordBatch.from_arrays([*keys, pa.array([part] * len(held), pa.int32()), states], names=[*by, "_part", "_state"])
            held.clear()
            return batch

        for batch in batches:
            schema = batch.schema
            values = batch.column(schema.get_field_index(value)).to_pandas()
            codes = np.zeros(len(values), np.int64)
            uniques = []
            for b in by:
                own = batch.column(schema.get_field_index(b)).dictionary_encode(null_encoding="encode")
                codes = codes * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False)
                uniques.append(own.dictionary.to_pylist())
            for code, rows in values.groupby(codes):
                key = []
                for own in reversed(uniques):
                    code, at = divmod(code, len(own))
                    key.append(own[at])
                key = tuple(reversed(key))
                if key not in held:
                    if len(held) >= MOST_GROUPS:
                        yield out()
                    held[key] = make()
                held[key].add(rows)
        if held:
            yield out()

    return run


def _merged(states: pd.DataFrame) -> Sketch:
    first, *others = map(pickle.loads, states["_state"])
    for other in others:
        first.merge(other)
    return first


def sketch_by(df: DataFrame, by: list[str], value: str, make: Callable[[], Sketch], finish: Callable[[Sketch], pd.DataFrame], columns: str) -> DataFrame:
    """What ``finish`` gives of each group's sketch, as ``columns``, beside the group; a null key is a group."""
    spark = df.sparkSession
    keys = df.select(*by).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    kinds = f"{kinds}, " if by else ""
    partial = df.select(*by, value).mapInArrow(_partial(by, value, make), f"{kinds}_part int, _state binary")

    def merge(states: pd.DataFrame) -> pd.DataFrame:
        return states.iloc[:1].assign(_state=pickle.dumps(_merged(states)))

    def end(states: pd.DataFrame) -> pd.DataFrame:
        done = finish(_merged(states))
        for i, b in enumerate(by):
            done.insert(i, b, states[b].iloc[0])
        return done

    parts = partial.groupBy(*by, "_part").applyInPandas(merge, f"{kinds}_part int, _state binary")
    schema = StructType([*keys.fields, *spark.createDataFrame([], columns).schema.fields])
    return parts.groupBy(*by).applyInPandas(end, schema)


def _fits(stored_rows: DataFrame, columns: list[str]) -> bool:
    """Whether a stored table is small enough to broadcast, by the measured bytes of its columns."""
    texts = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(100).cast("long"))
    return (stored_rows.agg(F.sum(texts)).first()[0] or 0) <= MAX_BROADCAST_BYTES


def heavy_hitters(df: DataFrame, by: list[str], item: str, per: int) -> DataFrame:
    """(by, item, n) of the items that more than one row in ``per`` of their group has; null items count as rows, not as items.

    The sketch gives at most ``2 * per`` candidates a group, which hold all of them;
    only rows of candidates are counted again.
    """
    rows = df.select(*by, item)
    kind = rows.schema[item].dataType.simpleString()

    def finish(sketch: Frequent) -> pd.DataFrame:
        return pd.DataFrame({item: list(sketch.counts)})

    candidates = stored(sketch_by(rows.filter(F.col(item).isNotNull()), by, item, lambda: Frequent(2 * per), finish, f"`{item}` {kind}"), "candidates")
    listed = candidates.toDF(*[f"_{c}" for c in candidates.columns])
    same = F.col(item) == F.col(f"_{item}")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    if _fits(candidates, candidates.columns):
        counted = rows.join(F.broadcast(listed), same).groupBy(*by, item).agg(F.count("*").alias("n"))
    else:  # counted before they meet, so that a heavy hitter moves one row a task
        counted = rows.groupBy(*by, item).agg(F.count("*").alias("n")).join(listed, same, "left_semi")
    totals = rows.groupBy(*by).agg(F.count("*").alias("_total")).toDF(*[f"_{b}" for b in by], "_total")
    if not by:
        return counted.filter(F.col("n") * per > totals.first()[0])
    met = F.lit(True)
    for b in by:
        met = met & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return counted.join(totals, met).filter(F.col("n") * per > F.col("_total")).select(*by, item, "n")


def ranked_values(df: DataFrame, by: list[str], value: str, shares: list[float], size: int = 512) -> DataFrame:
    """(by, share, value) where ``value`` is the least with at least that share of the group's values at or below it; exact.

    The sketch gives a bracket for each rank; values below it are counted, those
    inside it are counted by value. Null and NaN are left out; a group without values has no rows.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))

    def finish(sketch: Ranks) -> pd.DataFrame:
        ranks = [max(1, int(np.ceil(np.round(s * sketch.n, 9)))) for s in shares]
        ends = [sketch.bracket(r) for r in ranks]
        return pd.DataFrame({"_share": shares, "_rank": ranks, "_low": [e[0] for e in ends], "_high": [e[1] for e in ends]})

    brackets = stored(sketch_by(rows, by, "_v", lambda: Ranks(size), finish, "_share double, _rank long, _low double, _high double"), "brackets")
    ends = brackets.toDF(*[f"_{b}" for b in by], "_share", "_rank", "_low", "_high")
    same = F.col("_v") <= F.col("_high")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    if _fits(brackets, by):
        met = rows.withColumn("_n", F.lit(1)).join(F.broadcast(ends), same)
    else:  # values are counted before they meet their group's brackets
        met = rows.groupBy(*by, "_v").agg(F.count("*").alias("_n")).join(ends, same)
    below = F.col("_v") < F.col("_low")
    counted = met.groupBy(*by, "_share", "_rank", F.when(~below, F.col("_v")).alias("_v")).agg(F.sum("_n").alias("_n"))
    upto = Window.partitionBy(*by, "_share").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    enough = counted.withColumn("_upto", F.sum("_n").over(upto)).filter("_upto >= _rank and _v is not null")
    return enough.groupBy(*by, F.col("_share").alias("share")).agg(F.min("_v").alias(value))


@query("""
WITH w AS (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents),
t AS (SELECT lang, count(*) AS total FROM w GROUP BY lang)
SELECT w.lang, word, count(*) AS n FROM w JOIN t ON w.lang IS NOT DISTINCT FROM t.lang GROUP BY w.lang, word, total HAVING count(*) * 500 > total
""")
def agg_heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that are more than 1 in 500 of their language's."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", " ")).alias("word"))
    return heavy_hitters(words, ["lang"], "word", 500)


@query("""
SELECT l_returnflag, share, CASE share WHEN 0.01 THEN a[1] WHEN 0.5 THEN a[2] ELSE a[3] END AS l_extendedprice
FROM (SELECT l_returnflag, quantile_disc(l_extendedprice, [0.01, 0.5, 0.999]) AS a FROM lineitem GROUP BY l_returnflag), (SELECT unnest([0.01, 0.5, 0.999]::DOUBLE[]) AS share)
""")
def agg_sketched_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles that are values of the table, chosen within the brackets of a sketch."""
    return ranked_values(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.01, 0.5, 0.999])

"""Streams with state of one's own and timers, and joins of two streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.registry import query
from ..sources.tables import table
from .events import event_stream, run_in_steps, run_to_files, timed

if TYPE_CHECKING:
    from pyspark.sql.streaming.stateful_processor import TimerValues

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def periods_of(at: np.ndarray, gap: int) -> list[tuple[int, int, int]]:
    """(first, last, events) of the stretches of sorted times that have no gap of ``gap`` inside."""
    if not len(at):
        return []
    starts = np.concatenate([[0], np.flatnonzero(np.diff(at) >= gap) + 1])
    ends = np.append(starts[1:], len(at))
    return list(zip(at[starts].tolist(), at[ends - 1].tolist(), (ends - starts).tolist(), strict=True))


def joined(periods: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Periods in any order with those made one that lie closer than ``gap``."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(periods):
        if out and first - out[-1][1] < gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class Inactivity(StatefulProcessor):
    """A row for each time a key has been silent for ``silence_ms``, once the watermark has passed the end of the silence.

    One state variable a key: its periods of activity that haven't been told yet,
    each with first and last event and their number. Rows may come in any order
    that the watermark allows; they join the period they belong to. A timer stands
    at the end of the first silence, in whole milliseconds as Spark's watermark is;
    its expiry reports what is over, also of a key that has come back since. A
    key that has nothing left to tell holds no state.
    """

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.periods = handle.getValueState("periods", "first array<long>, last array<long>, n array<long>")

    def _known(self) -> list[tuple[int, int, int]]:
        return list(zip(*(self.periods.get() or ()), strict=True))

    def _over(self, period: tuple[int, int, int]) -> int:
        return -(-period[1] // 1000) + self.silence_ms

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        gap = self.silence_ms * 1000
        known = self._known()
        now = known
        for batch in rows:
            now = joined(now + periods_of(np.sort(batch["at"].astype("datetime64[us]").astype("int64").to_numpy()), gap), gap)
        self.periods.update(tuple(list(x) for x in zip(*now, strict=True)))
        timer = self._over(now[0])
        if known and self._over(known[0]) != timer:
            self.handle.deleteTimer(self._over(known[0]))
        if not known or self._over(known[0]) != timer:
            self.handle.registerTimer(timer)
        yield pd.DataFrame([], columns=["_key", "last_at", "n"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        known, mark = self._known(), timerValues.getCurrentWatermarkInMs()
        left = [p for p in known if self._over(p) > mark]
        if left:
            self.periods.update(tuple(list(x) for x in zip(*left, strict=True)))
            self.handle.registerTimer(self._over(left[0]))
        else:
            self.periods.clear()
        yield pd.DataFrame([(key[0], last, n) for _, last, n in known[: len(known) - len(left)]], columns=["_key", "last_at", "n"])

    def close(self) -> None:
        pass


def alerts_of_inactivity(events: DataFrame, key: str, silence_ms: int) -> DataFrame:
    """(key, last_at, n) from a stream with a watermark on ``at``; null is a key like others."""
    kind = events.schema[key].dataType.simpleString()
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # pandas would take nulls for numbers that differ
    silent = events.select(named.alias("_key"), "at").groupBy("_key").transformWithStateInPandas(Inactivity(silence_ms), "_key string, last_at long, n long", "append", "eventTime")
    return silent.select(F.expr(f"CAST(IF(_key = '', NULL, substring(_key, 2)) AS {kind})").alias(key), "last_at", "n")


def with_rocks(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """Runs with the state store that timers need, and puts the session's own back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return run()
    finally:
        spark.conf.set(PROVIDER, before)


def in_order(events: DataFrame, parts: int) -> list[DataFrame]:
    """The events cut by time into ``parts`` of about as many rows, the earliest first."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = events.select(F.percentile_approx(at, [k / parts for k in range(1, parts)])).first()[0] or [0] * (parts - 1)
    ends = [F.lit(True), *[at >= b for b in bounds]]
    return [events.filter(begun & ~over) for begun, over in zip(ends, [*ends[1:], at.isNull()], strict=True)]


@query("""
WITH m AS (SELECT epoch_us(max(ts)) - 3600000000 AS mark FROM events),
g AS (SELECT user_id, epoch_us(ts) AS e, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS prior FROM events),
s AS (SELECT user_id, e, sum(CASE WHEN e - prior < 43200000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY e) AS period FROM g)
SELECT user_id, max(e) AS last_at, count(*) AS n FROM s, m GROUP BY user_id, period, mark HAVING max(e) + 43200000000 <= mark
""")
def stream_inactivity_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that were silent for twelve hours: timers over three runs of one stream.

    Spark keeps the watermark in whole milliseconds, so a silence that ends less
    than one before it isn't told yet, where the SQL tells it.
    """
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    return with_rocks(spark, lambda: run_in_steps(lambda s: alerts_of_inactivity(timed(s), "user_id", 12 * 3_600_000), in_order(events, 3), "inactivity"))


def clicks_before(spark: SparkSession, sf_dir: str, span: str = "1 hour") -> DataFrame:
    """Each purchase with the clicks of its user in the hour before it, or alone once no such click can come any more."""
    bought = event_stream(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", F.col("user_id").alias("buyer"), F.col("at").alias("bought_at"))
    clicks = event_stream(spark, sf_dir).filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("at").alias("clicked_at"))
    near = F.expr(f"buyer = user_id AND clicked_at <= bought_at AND clicked_at >= bought_at - INTERVAL {span}")
    return bought.join(clicks, near, "left_outer").select("event_id", "click_id")


@query("""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS click_id, user_id, ts FROM events WHERE event_type = 'click'),
m AS (SELECT least((SELECT max(ts) FROM p), (SELECT max(ts) FROM c)) - INTERVAL 1 HOUR AS mark)
SELECT p.event_id, click_id FROM p JOIN c ON p.user_id = c.user_id AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 1 HOUR
UNION ALL
SELECT event_id, NULL FROM p, m WHERE p.ts < mark AND NOT EXISTS (SELECT 1 FROM c WHERE p.user_id = c.user_id AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 1 HOUR)
""")
def stream_join_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined within an hour, with outer rows that the watermarks release."""
    return run_to_files(clicks_before(spark, sf_dir), "clicks")

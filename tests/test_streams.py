"""Streams that arrive step by step: timers, state that goes, outer rows that watermarks release."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strandline.sources.scratch import scratch
from strandline.streaming.events import run_in_steps, timed
from strandline.streaming.state import alerts_of_inactivity, with_rocks

START = dt.datetime(2024, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_alerts_over_steps(spark):
    rows = lambda *own: spark.createDataFrame([(u, at(h)) for u, h in own], "user_id long, ts timestamp_ntz")
    steps = [
        rows((1, 0), (2, 1), (1, 2)),
        rows((1, 20), (2, 6), (3, 20)),  # user 1 was silent from 2 on: told as it comes back; 2 goes on
        rows((4, 48), (4, 48)),  # the others' timers expire
        rows((1, 49), (5, 100)),
    ]
    found = with_rocks(spark, lambda: run_in_steps(lambda s: alerts_of_inactivity(timed(s), "user_id", 12 * 3_600_000), steps, "alerts"))
    hours = lambda us: (us / 1e6 - START.replace(tzinfo=dt.UTC).timestamp()) / 3600
    assert sorted((r.user_id, hours(r.last_at), r.n) for r in found.collect()) == [(1, 2.0, 2), (1, 20.0, 1), (1, 49.0, 1), (2, 6.0, 2), (3, 20.0, 1), (4, 48.0, 2)]


def test_state_of_silent_users_goes(spark):
    """A thousand users that went silent leave no rows in the state store."""
    arriving, state = scratch(spark, "arriving"), scratch(spark, "state")
    schema = "user_id long, ts timestamp_ntz"

    def run():
        sizes = []
        for rows in ([(u, at(u % 5)) for u in range(1000)], [(5000, at(200))], [(5001, at(201))]):
            spark.createDataFrame(rows, schema).write.mode("append").parquet(arriving)
            stream = alerts_of_inactivity(timed(spark.readStream.schema(schema).parquet(arriving)), "user_id", 12 * 3_600_000)
            q = stream.writeStream.format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
            q.awaitTermination()
            sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        return sizes

    sizes = with_rocks(spark, run)
    assert sizes[0] >= 1000 > 50 > sizes[-1]


def test_join_of_streams(spark):
    """A row that comes after the watermark joins nothing; one without a partner comes once the watermark has passed."""

    def join(source):
        a = timed(source).filter("kind = 'a'").select("id", "at", F.lit(1).alias("k"))
        b = timed(source).filter("kind = 'b'").select(F.col("id").alias("other"), F.col("at").alias("there"), F.lit(1).alias("l"))
        return a.join(b, F.expr("k = l AND there <= at AND there >= at - INTERVAL 1 HOUR"), "left_outer").select("id", "other")

    rows = lambda *own: spark.createDataFrame([(i, k, at(h)) for i, k, h in own], "id long, kind string, ts timestamp_ntz")
    steps = [rows((1, "a", 5), (2, "b", 4.5), (3, "a", 5.9)), rows((4, "a", 30), (5, "b", 30)), rows((6, "a", 5.2), (7, "b", 5.8), (8, "b", 31), (9, "a", 31))]
    rows_out = run_in_steps(join, steps, "join").collect()
    assert sorted((r.id, r.other or 0) for r in rows_out) == [(1, 2), (3, 0), (4, 5), (9, 5), (9, 8)]

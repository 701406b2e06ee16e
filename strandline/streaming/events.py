"""Event streams: watermarks, windowed sums, sessions, deduplication and state of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.registry import query
from ..sources.scratch import scratch
from ..sources.tables import table


def event_stream(spark: SparkSession, sf_dir: str, late: str = "1 hour") -> DataFrame:
    """The events as a stream with a watermark on ``at``."""
    schema = table(spark, sf_dir, "events").schema
    return timed(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir), late)


def timed(files: DataFrame, late: str = "1 hour") -> DataFrame:
    return files.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there, in append mode, and reads what it wrote."""
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_in_steps(build: Callable[[DataFrame], DataFrame], steps: list[DataFrame], name: str) -> DataFrame:
    """Runs one stream over rows that arrive step by step, each step in as many files as Spark writes, and reads what it wrote.

    ``build`` makes the stream from its source. All runs share checkpoint and
    state, so what a step brings meets the watermark that the steps before it left.
    """
    spark = steps[0].sparkSession
    arriving, out, state = (scratch(spark, f"{name}-{x}") for x in ("arriving", "out", "state"))
    for step in steps:
        step.write.mode("append").parquet(arriving)
        stream = build(spark.readStream.schema(steps[0].schema).parquet(arriving))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("""
WITH m AS (SELECT epoch_us(max(ts)) - 3600000000 AS mark FROM events)
SELECT epoch_us(date_trunc('day', ts)) AS started, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events, m
GROUP BY 1, 2, mark HAVING epoch_us(date_trunc('day', ts)) + 86400000000 <= mark
""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed."""
    events = event_stream(spark, sf_dir)
    days = events.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    done = run_to_files(days.select(F.col("w.start").alias("start"), "event_type", "n", "value"), "tumbling")
    return done.select(F.unix_micros("start").alias("started"), "event_type", "n", F.round("value", 2).alias("value"))


@query("SELECT user_id, min(epoch_us(ts)) IS NOT NULL AS seen FROM events GROUP BY user_id")
def stream_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user, kept once by the state store."""
    first = event_stream(spark, sf_dir).dropDuplicates(["user_id"]).select("user_id", F.lit(True).alias("seen"))
    return run_to_files(first, "users")


@query("""
WITH m AS (SELECT epoch_us(max(ts)) - 3600000000 AS mark FROM events)
SELECT epoch_us(date_trunc('day', ts)) AS started, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events, m
GROUP BY 1, 2, mark HAVING epoch_us(date_trunc('day', ts)) + 86400000000 <= mark
""")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, then the first tenth of them once more: these come after their windows closed and change nothing."""
    events = table(spark, sf_dir, "events")
    mark = events.select(F.percentile_approx("event_id", 0.1)).first()[0]

    def days(source: DataFrame) -> DataFrame:
        grouped = timed(source).groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
        return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "value")

    done = run_in_steps(days, [events, events.filter(F.col("event_id") <= mark)], "late")
    return done.select(F.unix_micros("start").alias("started"), "event_type", "n", F.round("value", 2).alias("value"))


@query("""
WITH m AS (SELECT epoch_us(max(ts)) - 3600000000 AS mark FROM events),
w AS (SELECT epoch_us(date_trunc('day', ts)) - k * 43200000000 + 43200000000 * (hour(ts) // 12) AS started FROM events, (VALUES (0), (1)) t(k))
SELECT started, count(*) AS n FROM w, m WHERE started + 86400000000 <= mark GROUP BY started
""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that start every twelve hours, closed by the watermark."""
    days = event_stream(spark, sf_dir).groupBy(F.window("at", "1 day", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return run_to_files(days.select(F.col("w.start").alias("start"), "n"), "sliding").select(F.unix_micros("start").alias("started"), "n")


@query("""
WITH m AS (SELECT epoch_us(max(ts)) - 3600000000 AS mark FROM events),
g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, min(epoch_us(ts)) AS started, count(*) AS n FROM s, m GROUP BY user_id, sid, mark HAVING max(epoch_us(ts)) + 21600000000 <= mark
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that six hours without an event and the watermark have closed."""
    grouped = event_stream(spark, sf_dir).groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    done = run_to_files(grouped.select("user_id", F.col("w.start").alias("start"), "n"), "sessions")
    return done.select("user_id", F.unix_micros("start").alias("started"), "n")


MILESTONE = 5
#: Micro-batches that the events are cut into.
PORTIONS = 3
#: States that users share.
BUCKETS = 4096


def milestones(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:  # noqa: ARG001
    """One row each time a user's events reach another multiple of MILESTONE; the state is the counts of a bucket's users."""
    users, counts = state.get if state.exists else ([], [])
    before = pd.Series(counts, index=pd.Index(users), dtype="int64")
    now = pd.concat([before, *[b["user_id"].value_counts() for b in batches]]).groupby(level=0).sum()
    done = before.reindex(now.index, fill_value=0).to_numpy() // MILESTONE
    fresh = now.to_numpy() // MILESTONE - done
    nth = np.arange(fresh.sum()) - np.repeat(np.cumsum(fresh) - fresh, fresh)
    state.update((now.index.tolist(), now.tolist()))
    yield pd.DataFrame({"user_id": now.index.to_numpy().repeat(fresh), "reached": (np.repeat(done, fresh) + nth + 1) * MILESTONE})


@query("""
WITH c AS (SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT user_id, unnest(range(5, n + 1, 5)) AS reached FROM c
""")
def stream_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of one's own: counts per user, kept over the micro-batches in which the events come.

    There are about ``PORTIONS`` micro-batches of as many files, however many files
    the table takes: each batch commits every partition's state, so with a file a
    batch commits would take the time. Users share ``BUCKETS`` states, as a call of
    Python for each user would take more than the counting.
    """
    events = table(spark, sf_dir, "events").filter("user_id is not null")
    place = scratch(spark, "portions")
    bucket, portion = F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)), F.pmod(F.xxhash64("event_id"), F.lit(PORTIONS))
    events.select("user_id", bucket.cast("int").alias("bucket"), portion.cast("int").alias("portion")).write.partitionBy("portion").parquet(place)
    user = events.schema["user_id"].dataType.simpleString()
    schema = f"user_id {user}, bucket int, portion int"
    files = len(spark.read.schema(schema).parquet(place).inputFiles())
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // PORTIONS))).parquet(place).select("bucket", "user_id")
    reached = arriving.groupBy("bucket").applyInPandasWithState(milestones, f"user_id {user}, reached long", f"users array<{user}>, counts array<long>", "append", GroupStateTimeout.NoTimeout)
    return run_to_files(reached, "milestones")

"""Streams over the events table, each run to its end over the files that are there (``availableNow``).

Results go to Parquet under the shared folder, so no stream passes through the driver.
Windows are sent when the watermark has closed them (append mode): the windows that
are still open at the end of the input are not part of a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import partial
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from basinflow.sources.shared import fresh_path

#: Deliveries of ``late_deliveries``: on-time files, then one with the rows that come late.
ON_TIME, LATE_ONE_IN = 3, 97


def events_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """``events`` as a stream with ``ts`` as a timestamp (watermarks reject timestamp_ntz)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "events.parquet")
    stream = reader.parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


class Deliveries(NamedTuple):
    """A stream over a folder that fills up delivery by delivery; each delivery is one micro-batch, whatever its number of files."""

    stream: DataFrame
    steps: list[Callable[[], None]]


def late_deliveries(spark: SparkSession, sf_dir: str, with_late: bool = True) -> Deliveries:
    """``events`` in order, in ``ON_TIME`` deliveries, but one in ``LATE_ONE_IN`` rows comes in a last one, after all others (unless all are on time).

    A delivery is written by as many tasks as its rows have splits; on-time ones are ranges of event_id, which a scan can skip to.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = fresh_path(spark, "deliveries")
    late = F.col("event_id") % LATE_ONE_IN == 0 if with_late else F.lit(False)
    end = (events.agg(F.max("event_id")).first()[0] or 0) + 1
    cuts = [-(-end * i // ON_TIME) for i in range(ON_TIME + 1)]
    parts = [~late & (F.col("event_id") >= lo) & (F.col("event_id") < hi) for lo, hi in zip(cuts, cuts[1:])] + [late] * with_late
    spark.createDataFrame([], events.schema).write.mode("append").parquet(path)  # the folder is there before the stream

    def deliver(rows: Column) -> None:
        events.where(rows).write.mode("append").parquet(path)

    stream = spark.readStream.schema(events.schema).parquet(path)
    return Deliveries(stream.withColumn("ts", F.col("ts").cast("timestamp")), [partial(deliver, rows) for rows in parts])


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Streams that start within take ``key`` as ``value``; the session gets its own back."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


ROCKS_DB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(stream: DataFrame, mode: str, steps: Sequence[Callable[[], None]] = (), flush: bool = True) -> DataFrame:
    """Run ``stream`` until its input is used up and give what it put out; in ``update`` and ``complete`` mode with a column ``batch``.

    With ``steps`` it runs once after each of them, going on from its checkpoint, as a job would that is run at intervals. Only the
    last run adds a batch without rows, which sends what the watermark of the last delivery closes; without ``flush`` none does.
    """
    spark = stream.sparkSession
    out = fresh_path(spark, "drained")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}-state")
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:  # a batch that runs again overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer, schema = writer.foreachBatch(keep), schema.add("batch", "long")
    steps = steps or [lambda: None]
    for i, step in enumerate(steps, 1):
        step()
        with setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", str(flush and i == len(steps)).lower()):
            writer.start().awaitTermination()
    return spark.read.schema(schema).parquet(out)


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and value by day and type, of the days that a one-hour watermark has closed."""
    stream = events_stream(spark, sf_dir).withWatermark("ts", "1 hour")
    counts = stream.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return drain(counts, "append").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by closed windows of two days that start every day."""
    stream = events_stream(spark, sf_dir).withWatermark("ts", "1 hour")
    counts = stream.groupBy(F.window("ts", "2 days", "1 day")).agg(F.count("*").alias("n"))
    return drain(counts, "append").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def late_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by closed day over several micro-batches; rows that come after their day was closed are dropped."""
    stream, steps = late_deliveries(spark, sf_dir)
    counts = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return drain(counts, "append", steps).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


def running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type after each micro-batch (complete mode): the last batch has them all."""
    stream, steps = late_deliveries(spark, sf_dir)
    counts = stream.groupBy("event_type").agg(F.count("*").alias("n"))
    return drain(counts, "complete", steps).groupBy("event_type").agg(F.max_by("n", "batch").alias("n"))


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, of six hours' gap, that the watermark has closed."""
    stream = events_stream(spark, sf_dir).withWatermark("ts", "1 hour")
    found = stream.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return drain(found, "append").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def first_of_user_and_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful dedup: one row per (user, type)."""
    stream = events_stream(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return drain(stream, "append").groupBy("event_type").agg(F.count("*").alias("users"))


def repeats_within_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event delivered twice in one batch: ``dropDuplicatesWithinWatermark`` lets one of them through and may forget it after a day."""
    once = events_stream(spark, sf_dir).select("event_id", "ts", "event_type")
    twice = once.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withWatermark("ts", "1 day")
    kept = twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")
    return drain(kept, "append").groupBy("event_type").agg(F.count("*").alias("n"))


def purchases_after_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-stream join: purchases and the views of the same user in the hour before. Both sides forget what no later row can meet."""
    events = events_stream(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")
    views = events.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("viewer"), F.col("ts").alias("seen"))
    bought = events_stream(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    met = bought.withWatermark("ts", "1 hour").join(
        views.withWatermark("seen", "1 hour"),
        F.expr("user_id = viewer AND seen <= ts AND seen >= ts - INTERVAL 1 HOUR"),
    )
    return drain(met.select("event_id", "view_id"), "append")


def purchases_with_views_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stateful operators in a row, over several deliveries: purchases left-joined to the views of the hour before, then counted by closed day.

    A purchase without a view is sent when the watermark says that none can come, so days close an hour later than the watermark.
    """
    stream, steps = late_deliveries(spark, sf_dir, with_late=False)
    events = stream.select("event_id", "user_id", "event_type", "ts")
    bought = events.where("event_type = 'purchase'").withWatermark("ts", "1 hour")
    views = events.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("viewer"), F.col("ts").alias("seen")).withWatermark("seen", "1 hour")
    met = bought.join(views, F.expr("user_id = viewer AND seen <= ts AND seen >= ts - INTERVAL 1 HOUR"), "left_outer")
    days = met.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.count("view_id").alias("with_view"))
    return drain(days, "append", steps).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "n", "with_view")


def user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arbitrary state: a count and a sum per user, kept across micro-batches and sent on each change."""

    def add(key, parts, state):
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n, total = n + len(part), total + float(part["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    schema = "user_id long, n long, total double"
    stream, steps = late_deliveries(spark, sf_dir)
    totals = stream.select("user_id", "value").groupBy("user_id").applyInPandasWithState(add, schema, "n long, total double", "update", GroupStateTimeout.NoTimeout)
    return drain(totals, "update", steps).groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 2).alias("total"))


QUERIES = {
    "stream_user_totals": user_totals,
    "stream_tumbling_counts": tumbling_counts,
    "stream_sliding_counts": sliding_counts,
    "stream_late_rows": late_counts,
    "stream_running_counts": running_counts,
    "stream_sessions": session_counts,
    "stream_dedup": first_of_user_and_type,
    "stream_dedup_within_watermark": repeats_within_watermark,
    "stream_join": purchases_after_views,
    "stream_join_then_count": purchases_with_views_by_day,
}

SQL = {
    "stream_user_totals": "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id",
    "stream_tumbling_counts": """
SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
    "stream_sliding_counts": """
SELECT CAST(s AS TIMESTAMP) AS start, count(*) AS n
FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events)
WHERE s + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
    # Spark judges lateness by the watermark that the batch before has used: that of the first two of three deliveries
    "stream_late_rows": """
SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events, (
  SELECT max(ts) - INTERVAL 1 HOUR AS w, max(ts) FILTER (event_id % 97 <> 0 AND event_id * 3 // (m + 1) < 2) - INTERVAL 1 HOUR AS before
  FROM events, (SELECT max(event_id) AS m FROM events))
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= w AND NOT (event_id % 97 = 0 AND date_trunc('day', ts) + INTERVAL 1 DAY <= before)
GROUP BY ALL""",
    "stream_running_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "stream_sessions": """
SELECT user_id, start, n FROM (
  SELECT user_id, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM (
    SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
      SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
  GROUP BY user_id, s)
WHERE stop + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_dedup": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "stream_dedup_within_watermark": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "stream_join": """
SELECT p.event_id, v.event_id AS view_id FROM events p JOIN events v ON p.user_id = v.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 1 HOUR
WHERE p.event_type = 'purchase' AND v.event_type = 'view'""",
    # The watermark is that of the stream that is behind; what the join keeps holds the days back by one more hour.
    "stream_join_then_count": """
SELECT date_trunc('day', p.ts)::TIMESTAMP AS day, count(*) AS n, count(v.event_id) AS with_view
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 1 HOUR
WHERE date_trunc('day', p.ts) + INTERVAL 1 DAY <= (
  SELECT least(max(ts) FILTER (event_type = 'purchase'), max(ts) FILTER (event_type = 'view')) - INTERVAL 2 HOUR FROM events)
GROUP BY ALL""",
}

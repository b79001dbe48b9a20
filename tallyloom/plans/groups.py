"""Queries of groups that hold most rows, and of streams; see `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import history, intervals
from tallyloom.plans.registry import query
from tallyloom.session import dropped, scratch_dir
from tallyloom.streaming import slices


@query("""
WITH s AS (SELECT CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 60 * (1 + event_id % 5) + CASE WHEN event_id % 97 = 0 THEN 20000 ELSE 0 END AS e FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s),
i AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r + 600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, island::BIGINT AS island, min(s) AS "start", max(e) AS "end", count(*) AS n FROM i GROUP BY user_id, island""")
def merge_windows_hot(t):
    """Intervals merged over gaps up to ten minutes, where one user has half of all rows."""
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    end = start + 60 * (1 + F.col("event_id") % 5) + F.when(F.col("event_id") % 97 == 0, 20000).otherwise(0)
    rows = t("events").select(F.when(F.col("event_id") % 2 == 0, -1).otherwise(F.col("user_id")).alias("user_id"), start.alias("start"), end.alias("end"))
    return intervals.islands(rows, ["user_id"], "start", "end", 600)


@query("""
WITH e AS (SELECT event_id, event_type, user_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 + event_id % 50 END AS room FROM events)
SELECT room, event_id, right(coalesce(string_agg(event_type || ' ' || user_id, chr(10)) OVER (PARTITION BY room ORDER BY event_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), ''), 120) AS transcript FROM e""")
def long_transcripts(t):
    """The last 120 characters of what was said before each event, where one room has a third of all events."""
    rows = t("events").select(F.when(F.col("event_id") % 3 == 0, 0).otherwise(1 + F.col("event_id") % 50).alias("room"), "event_id", F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")).alias("line"))
    return history.running_transcript(rows, "room", ["event_id"], F.col("line"), most=120).select("room", "event_id", "transcript")


@query("""
WITH n AS (SELECT count(*) AS n FROM events),
e AS (SELECT event_type, value, ts, date_trunc('day', ts) + to_hours(hour(ts) // 6 * 6) AS start, least(event_id * 8 // n + CASE WHEN event_id % 13 = 5 THEN 2 ELSE 0 END, 7) AS k FROM events, n),
m AS (SELECT k, date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY AS m FROM e GROUP BY k),
x AS (SELECT k, max(m) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS mark FROM m),
d AS (SELECT e.*, coalesce(start + INTERVAL 6 HOUR <= mark, false) AS late FROM e JOIN x USING (k))
SELECT start, event_type, count(*) AS n, round(sum(value), 2) AS total, start + INTERVAL 6 HOUR <= (SELECT max(m) FROM m) AS closed, (SELECT count(*) FROM d WHERE late) AS late FROM d WHERE NOT late GROUP BY start, event_type""")
def stream_late_rows(t):
    """A stream of events in eight micro-batches, where some rows come two batches late: windows of six hours that a watermark of a day has closed, those still open, and the number of rows that were dropped."""
    events = t("events")
    spark = events.sparkSession
    rows = events.count()
    arrival = F.least(F.floor(F.col("event_id") * 8 / rows) + F.when(F.col("event_id") % 13 == 5, 2).otherwise(0), F.lit(7)).cast("int")
    folder = scratch_dir(spark)
    stream = slices.replayed(events.select("event_id", "ts", "event_type", "value"), arrival, f"{folder}/in")
    closed, still, late = slices.settled_counts(stream, folder, "1 day", "6 hours")
    both = closed.withColumn("closed", F.lit(True)).unionByName(still.withColumn("closed", F.lit(False)))
    both.select("start", "event_type", "n", F.round("total", 2).alias("total"), "closed", F.lit(late).cast("long").alias("late")).write.parquet(f"{folder}/result")
    dropped(spark, *[f"{folder}/{x}" for x in ("in", "windows", "checkpoint")])
    return spark.read.parquet(f"{folder}/result")

"""Structured Streaming: evaluate new files once, counts in event time, quotas by class."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch(spark: SparkSession, folder: str, schema: str, checkpoint: str, evaluate: Callable[[DataFrame, int], None], files_at_once: int = 1, once: bool = True):
    """Call `evaluate` for the new files of a folder, each once; the checkpoint is where a restart resumes."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(evaluate)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
    if once:
        query.awaitTermination()
    return query


def tumbling(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window and type; works on streams and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def replayed(events: DataFrame, arrival: Column, folder: str) -> DataFrame:
    """A stream of a table, whose rows come in the order of `arrival` (a whole number from 0): a micro-batch for each number, as Spark reads one file after the other, oldest first."""
    spark, numbers = events.sparkSession, events.select(arrival.alias("n")).distinct().sort("n")
    # A folder for each arrival, written one after the other, so that files are as old as they should be.
    for r in numbers.toLocalIterator():
        events.filter(arrival == r.n).coalesce(1).write.parquet(f"{folder}/arrival={r.n:06d}")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)


def settled_counts(stream: DataFrame, folder: str, late: str = "1 hour", width: str = "1 hour") -> tuple[DataFrame, DataFrame, int]:
    """Run a stream of events (ts, event_type, value) to its present end: windows that are closed, windows that are still open, and how many rows came too late for any.

    Windows are as `tumbling` makes them. One closes when the watermark passes its end; a row that
    comes when the batch before has closed its window is dropped. Open windows are read from the
    state of the query. Results and the checkpoint, from which a later run goes on, are in `folder`.
    """
    spark = stream.sparkSession
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    already = _counted(spark, folder)[2]
    run = tumbling(rows, late, width).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/windows")
    run.awaitTermination()
    closed, still, kept = _counted(spark, folder)
    return closed, still, sum(p.numInputRows for p in run.recentProgress) - (kept - already)


def _counted(spark: SparkSession, folder: str) -> tuple[DataFrame | None, DataFrame | None, int]:
    """Closed and open windows of a folder of `settled_counts`, and the rows in them; none before its first run."""
    offsets = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/checkpoint/commits")
    if not offsets.getFileSystem(spark._jsc.hadoopConfiguration()).exists(offsets):
        return None, None, 0
    closed = spark.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{folder}/windows")
    state = spark.read.format("statestore").load(f"{folder}/checkpoint")
    field = lambda part, k: F.col(part).getField(state.schema[part].dataType.fields[k].name)
    still = state.select(field("key", 0)["start"].alias("start"), field("key", 1).alias("event_type"), field("value", 0).alias("n"), field("value", 1).alias("total"))
    return closed, still, closed.select("n").unionByName(still.select("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def under_quota(stream: DataFrame, label: str, key: str, quota: int) -> DataFrame:
    """The first `quota` rows (label, key) of each label over the whole stream; the count is kept as state."""

    def keep(label_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for pdf in frames:
            some = pdf.sort_values(key).head(max(0, quota - seen))
            seen += len(some)
            yield some[[label, key]]
        state.update((seen,))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.select(label, key).schema)
    return stream.select(label, key).groupBy(label).applyInPandasWithState(keep, kinds, "seen long", "append", GroupStateTimeout.NoTimeout)

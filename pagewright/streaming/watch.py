"""Changed files as a stream: debounce by session windows, ingest in micro-batches.

The event-time watermark bounds the state; the gap of a session is the quiet
time after which the collected paths of a wiki are handed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def debounce(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds", key: str = "wiki", time: str = "changed_at", path: str = "path") -> DataFrame:
    """(key, opened_at, closed_at, paths, n_events): paths of a key collected until it is quiet for the gap. Batch or stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap), key).agg(F.array_sort(F.collect_set(path)).alias("paths"), F.count(F.lit(1)).alias("n_events"))
    return out.select(key, F.col("session_window.start").alias("opened_at"), F.col("session_window.end").alias("closed_at"), "paths", "n_events")


def file_stream(spark: SparkSession, root: str, pattern: str = "*.md", per_trigger: int = 1000) -> DataFrame:
    """New and rewritten files of a tree, new folders included."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).schema("path string, modificationTime timestamp, length long, content binary").load(root)


def ingest_stream(files: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Hand each micro-batch to the same function that a batch job uses."""
    writer = files.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def deletions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status): files that a listing had and the next one lacks; a file stream never reports these."""
    return before.select("path").join(after.select("path"), "path", "left_anti").withColumn("status", F.lit("D"))

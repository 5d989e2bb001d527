"""Streaming input: bundles and log events that arrive as files, merged into a session as they come; binned counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import Store
from ..sources import bundles, logs


def stream_objects(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """(object, seq) of bundle objects, one in a line, in files that appear in a folder."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_a_batch).text(folder)
    return lines.where("value <> ''").select(F.col("value").alias("object"), F.lit(0).cast("long").alias("seq"))


def stream_events(spark: SparkSession, folder: str, format_name: str, creator: str, files_a_batch: int = 100) -> DataFrame:
    """(object, seq) of observations made of JSON events, one in a line, of a known format."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_a_batch).text(folder)
    return logs.convert_lines(lines, format_name, creator)


def cache_stream(store: Store, objects: DataFrame, query_id: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merges each micro-batch into the session. Merging is idempotent but for sums of repeated objects, so a batch that is tried again does no harm to observations."""

    def merge(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store._merge(bundles.flatten_rows(batch.withColumn("seq", F.monotonically_increasing_id() + F.lit(number << 40))), query_id)

    writer = objects.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def binned_counts(events: DataFrame, time: str, width: str, keys: list[str], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by key and window of event time (tumbling, or sliding by `slide`); rows later than `late` don't change a window that is closed."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counted = events.withWatermark(time, late).groupBy(window, *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def session_counts(events: DataFrame, time: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts by key and session: rows of a key that follow each other within the gap."""
    counted = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")

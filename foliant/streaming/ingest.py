"""Incremental ingestion: new files as a stream that ends when all are read, upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.sinks import PointStore


def new_files(spark: SparkSession, path: str, schema: str, at_once: int = 100) -> DataFrame:
    """A stream of the JSON files of a folder; the checkpoint of what is written knows which were read."""
    return spark.readStream.schema(schema).option("multiLine", True).option("maxFilesPerTrigger", at_once).json(path).withColumn("file", F.col("_metadata.file_name"))


def upsert_available(stream: DataFrame, store: PointStore, checkpoint: str, to_points: Callable[[DataFrame], DataFrame] = lambda x: x) -> None:
    """Upserts what is there now into the store and ends. A batch that is run again changes nothing, since points have ids by name."""

    def write(batch: DataFrame, n: int) -> None:
        made = to_points(batch)
        if not made.isEmpty():
            store.upsert(made)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, length: str = "1 hour", late: str = "2 hours", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums in windows of event time; works on streams (late rows are dropped after the watermark) and tables alike."""
    own = events.withWatermark(time, late) if events.isStreaming else events
    return own.groupBy(F.window(time, length).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n", "total")

"""The intake as a stream: new files under a root become documents, and counts by source and day of arrival follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.intake import FILES, as_files, parse


def stream(spark: SparkSession, root: str, files_at_once: int = 1000) -> DataFrame:
    """Documents of the files that arrive under ``root``."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_at_once).load(root)
    return parse(as_files(files), root)


def arrivals(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts by event type and window of (ts, event_type, value), with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")

"""Streams: an extension beyond what the batch operators cover.

Events arrive as files; the same expressions as in batch run over them, with a watermark for late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by window and kind; rows later than ``late`` are dropped."""
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, width), kind)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def distinct_events(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "2 days") -> DataFrame:
    """Each event once, as long as repeats come within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def to_parquet(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that takes what is there, then stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

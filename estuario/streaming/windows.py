"""Structured Streaming over arriving files: new records once, and volumes per window with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, schema: str, *, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def volumes(events: DataFrame, *, time: str = "ts", by: str = "event_type", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per window and kind; events later than ``late`` are dropped by the watermark. Works on streams and tables alike."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    g = e.withWatermark(time, late) if e.isStreaming else e
    return g.groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("inicio"), by, "n")


def once(events: DataFrame, *, time: str = "ts", key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Each key once, remembered for ``late``."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])

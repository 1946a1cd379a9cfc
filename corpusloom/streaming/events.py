"""Event-log streams. The late-data policy is this library's own: a watermark, beyond which rows are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, files_each: int = 100) -> DataFrame:
    """A stream of event files; the schema is that of the files there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_actions(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and values of each kind in each window of event time."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """A user's sessions: events without a gap of more than ``gap``."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("steps"), F.sum("value").alias("spent")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "steps", "spent")


def append(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Start a query that appends finished rows to Parquet, all that is there, then stops."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()

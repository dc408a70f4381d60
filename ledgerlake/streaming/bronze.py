"""Streams over the landed log: append as it came, exact deduplication, counts by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..contracts import EVENT_ID, RAW
from ..sources import landing


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType = RAW, files: str = "*.parquet") -> StreamingQuery:
    """Everything new is appended once, and the query ends; the checkpoint knows what was read."""
    rows = landing.stream(spark, source, schema, files=files).withColumn("_bronze_loaded_at", F.current_timestamp())
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def deduplicated(rows: DataFrame, at: str, delay: str = "1 day", event_id: list[str] | None = None) -> DataFrame:
    """Each event once; what is remembered of an event is dropped after the delay."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(event_id or EVENT_ID)


def tumbling(rows: DataFrame, at: str, width: str = "10 minutes") -> DataFrame:
    return rows.groupBy(F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("bucket"), "events")

"""Change envelopes to event rows and dead letters, in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import OPS

SOURCE = "STRUCT<table: STRING, ts_ms: BIGINT, lsn: BIGINT, txId: BIGINT>"


def classify(value: Column) -> Column:
    """'skip' for tombstones and heartbeats, 'bad' for what can't be used, else 'event'."""
    keys = F.json_object_keys(value)
    op = F.get_json_object(value, "$.op")
    images = F.coalesce(F.get_json_object(value, "$.after"), F.get_json_object(value, "$.before"))
    return (
        F.when(value.isNull(), "skip")
        .when(keys.isNull(), "bad")  # no JSON, or no object
        .when(~F.array_contains(keys, "op"), "skip")
        .when(~F.coalesce(op.isin(*OPS), F.lit(False)) | images.isNull(), "bad")
        .otherwise("event")
    )


def decode(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """messages (key, value, topic, partition, offset) to (events as contracts.RAW without _ingested_at, dead letters).

    The key stays JSON, with all its columns; an event whose source names no table belongs to the last part of its topic.
    """
    told = messages.withColumn("_kind", classify(F.col("value")))
    get = lambda path: F.get_json_object("value", path)
    source = F.from_json(get("$.source"), SOURCE)
    events = told.filter("_kind = 'event'").select(
        get("$.op").alias("op"),
        F.coalesce(source["table"], F.element_at(F.split("topic", r"\."), -1)).alias("table_name"),
        F.col("key").alias("primary_key"),
        get("$.before").alias("before"),
        get("$.after").alias("after"),
        source["ts_ms"].alias("source_ts_ms"),
        source["lsn"].alias("source_lsn"),
        source["txId"].alias("source_tx_id"),
        get("$.ts_ms").try_cast("long").alias("debezium_ts_ms"),
        F.col("topic").alias("_kafka_topic"),
        F.col("partition").cast("int").alias("_kafka_partition"),
        F.col("offset").cast("long").alias("_kafka_offset"),
    )
    dead = told.filter("_kind = 'bad'").select(F.lit("malformed change envelope").alias("error"), "topic", "partition", "offset", F.col("value").alias("raw_value"), F.current_timestamp().alias("at"))
    return events, dead

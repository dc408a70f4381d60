"""Messages to the landing folder: events by table and day, and dead letters, in one pass of a stream.

A batch is written before its offsets are committed, so a crash between the two delivers it again (at least once);
silver's event ids make that exact. Spark's checkpoint is the offset log, and its triggers are the flush policy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import envelope


def land(messages: DataFrame, landing: str, dead_letters: str, checkpoint: str, seconds: int | None = None, fault: Callable[[int], None] | None = None) -> StreamingQuery:
    """messages: key, value, topic, partition, offset. Without seconds, what is there is landed and the query ends.
    fault(batch) is called between writing and committing, for tests of crashes."""

    def flush(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        events, dead = envelope.decode(kept)
        stamped = events.withColumn("_ingested_at", F.current_timestamp())
        stamped.withColumn("table", F.col("table_name")).withColumn("ingest_date", F.current_date()).write.mode("append").partitionBy("table", "ingest_date").option("compression", "zstd").parquet(landing)
        dead.write.mode("append").json(dead_letters)
        kept.unpersist()
        if fault:
            fault(number)

    out = messages.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=f"{seconds} seconds") if seconds else out.trigger(availableNow=True)).start()

"""Checks of the lake against its source, and figures of its health."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import EVENT_ID


def totals(rows: DataFrame, key: str, amount: str) -> DataFrame:
    """key, n and cents of a side of a reconciliation; a null key is called 'None'."""
    return rows.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("None")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(amount), F.lit(0)).cast("long").alias("cents"))


def closed_days(rows: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Rows of the days from start up to, not including, end."""
    return rows.filter((F.col(at) >= F.lit(start).cast("timestamp")) & (F.col(at) < F.lit(end).cast("timestamp")))


def compare(source: DataFrame, lake: DataFrame) -> DataFrame:
    """key, counts and cents of both sides, and ok; a key that a side lacks counts as nothing there."""
    s = source.select("key", F.col("n").alias("source_n"), F.col("cents").alias("source_cents"))
    o = lake.select("key", F.col("n").alias("lake_n"), F.col("cents").alias("lake_cents"))
    both = s.join(o, "key", "full").na.fill(0, ["source_n", "source_cents", "lake_n", "lake_cents"])
    return both.withColumn("ok", (F.col("source_n") == F.col("lake_n")) & (F.col("source_cents") == F.col("lake_cents")))


def digest(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One number for a set of rows, whatever their order; finds errors that cancel out in sums."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).alias("digest"))


def loss(source: DataFrame, landed: DataFrame, pk: str = "pk", state: str = "state", op: str = "op") -> DataFrame:
    """missing, extra and wrong: keys of the source that the log lacks or has deleted, keys that the log holds alive
    without a source row, and keys whose newest states differ. landed: the newest row of each key."""
    s = source.select(F.col(pk).alias("pk"), F.col(state).alias("source_state"), F.lit(True).alias("in_source"))
    o = landed.select(F.col(pk).alias("pk"), F.col(state).alias("lake_state"), (F.col(op) != "d").alias("alive"))
    both = s.join(o, "pk", "full").select(F.coalesce("in_source", F.lit(False)).alias("a"), F.coalesce("alive", F.lit(False)).alias("b"), F.col("source_state").eqNullSafe(F.col("lake_state")).alias("same"))
    return both.agg(F.count_if(F.col("a") & ~F.col("b")).alias("missing"), F.count_if(~F.col("a") & F.col("b")).alias("extra"), F.count_if(F.col("a") & F.col("b") & ~F.col("same")).alias("wrong"))


def landing_volume(events: DataFrame) -> DataFrame:
    return events.groupBy("table_name", "op").agg(F.count(F.lit(1)).alias("events"))


def duplicates(events: DataFrame, event_id: Sequence[str] = tuple(EVENT_ID)) -> DataFrame:
    """Deliveries, distinct events and the difference; as a struct, so that a null in an id counts too."""
    n, once = F.count(F.lit(1)), F.count_distinct(F.struct(*event_id))
    return events.agg(n.alias("deliveries"), once.alias("events"), (n - once).alias("duplicates"))


def latency(events: DataFrame, start: str, end: str) -> DataFrame:
    """Interpolated p50, p95 and p99, and the maximum, of seconds from start to end (epoch milliseconds)."""
    seconds = (F.col(end) - F.col(start)) / 1000.0
    known = events.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(seconds.alias("s"))
    p = F.percentile("s", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return known.agg(p.alias("p"), F.max("s").alias("max_s")).select(*(F.round(F.col("p")[i], 3).alias(f"p{q}_s") for i, q in enumerate((50, 95, 99))), F.round("max_s", 3).alias("max_s"))


def files_per_table(events: DataFrame) -> DataFrame:
    """events: read from files, with _metadata."""
    return events.groupBy("table_name").agg(F.count_distinct(F.col("_metadata.file_path")).alias("files"), F.count(F.lit(1)).alias("rows"))


def newest(tables: Sequence[DataFrame], at: str) -> DataFrame:
    """The newest moment over several tables, one row."""
    return reduce(DataFrame.unionByName, [t.agg(F.max(at).alias("newest")) for t in tables]).agg(F.max("newest").alias("newest"))


def health(histories: Sequence[DataFrame], bronze: DataFrame, now: str, since: str, at: str = "_source_ts") -> DataFrame:
    """bronze_rows, events of this run, the newest source moment, freshness and latency percentiles in seconds.

    Snapshot reads aren't events of the run; percentiles are approximate (Spark's sketch), as on large tables.
    """
    moment = F.lit(now).cast("timestamp")
    run = reduce(DataFrame.unionByName, [h.filter((F.col("op") != "r") & (F.col("_processed_at") >= F.lit(since).cast("timestamp"))).select((F.unix_millis("_processed_at") - F.unix_millis(at)).alias("ms")) for h in histories])
    p = lambda q: (F.percentile_approx("ms", q) / 1000.0).alias(f"p{int(q * 100)}_s")
    figures = run.agg(F.count(F.lit(1)).alias("events"), p(0.5), p(0.95), p(0.99))
    fresh = newest(histories, at).select(F.col("newest").alias("max_source_ts"), (F.unix_timestamp(moment) - F.unix_timestamp("newest")).alias("freshness_s"))
    return bronze.agg(F.count(F.lit(1)).alias("bronze_rows")).join(F.broadcast(figures)).join(F.broadcast(fresh))


def freshness_lag(source: float | None, lake: float | None) -> float:
    """Seconds by which the lake is behind (epoch seconds): nothing to load is no lag, nothing loaded is endless."""
    if source is None:
        return 0.0
    return float("inf") if lake is None else max(0.0, source - lake)

"""Versions of slowly changing rows, and joins to the version that held at a moment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OPEN_END = "9999-12-31 00:00:00"


def versions(history: DataFrame, key: str, attributes: Sequence[str], order: Sequence[str] = ("source_lsn", "_kafka_offset"), at: str = "_source_ts", created: str | None = "created_at", op: str | None = "op") -> DataFrame:
    """Half-open versions [valid_from, valid_to) of a key, one for each real change of the attributes.

    A change is real if any attribute differs from the event before, where null and the empty string are alike. A
    delete opens no version, but counts as the event before; it closes none, so a deleted key keeps an open
    version. The first version opens when the key was created, if that is known and earlier.
    """
    line = W.partitionBy(key).orderBy(*order)
    now = F.struct(*(F.coalesce(F.col(a).cast("string"), F.lit("")).alias(a) for a in attributes))
    told = history.withColumn("_now", now)
    told = told.withColumn("_before", F.lag("_now").over(line))
    changed = F.col("_before").isNull() | (F.col("_before") != F.col("_now"))
    opening = told.filter(changed if op is None else changed & (F.col(op) != "d"))
    first = F.row_number().over(line) == 1
    start = F.col(at)
    if created:
        start = F.when(first, F.least(F.col(created), F.col(at))).otherwise(F.col(at))
    following = F.lead(at).over(line)
    return opening.select(key, *attributes, start.alias("valid_from"), F.coalesce(following, F.lit(OPEN_END).cast("timestamp").cast(history.schema[at].dataType)).alias("valid_to"), following.isNull().alias("is_current"))


def as_of(left: DataFrame, dim: DataFrame, key: str, at: str, columns: Sequence[str], dim_key: str | None = None) -> DataFrame:
    """left with the columns of the version that held at its moment `at`; null where there was none.

    An equi-join with the interval as a residual condition: AQE broadcasts a small dimension and splits hot keys of
    a large one. Versions of a key don't overlap, so no row is multiplied.
    """
    d = dim.select(F.col(dim_key or key).alias("_key"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), *(F.col(c).alias(f"_dim_{c}") for c in columns))
    within: Column = (left[key] == d["_key"]) & (left[at] >= d["_from"]) & (left[at] < d["_to"])
    return left.join(d, within, "left").select(*left.columns, *(F.col(f"_dim_{c}").alias(c) for c in columns))

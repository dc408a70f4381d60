"""A session as the engine expects it: UTC, adaptive execution, zstd."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("ledgerlake")
    if master:
        b = b.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.parquet.compression.codec": "zstd", "spark.ui.showConsoleProgress": "false"}
    if shuffle_partitions:
        fixed["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (fixed | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def settled(rows: DataFrame) -> DataFrame:
    """rows written to the shared checkpoint folder now, for frames that several parts of a plan read; a folder of our
    own only where the session names none (tests)."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "ledgerlake-checkpoints"))
    return rows.checkpoint()

"""Reshapes for dashboards, and CSV files of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def units(column: str) -> Column:
    return (F.col(column) / 100.0).alias(column.removesuffix("_cents"))


def settlement(daily: DataFrame, merchants: DataFrame) -> DataFrame:
    """Amounts in units, with the merchants' current attributes."""
    now = merchants.filter("is_current").select("merchant_id", "name", "category", "risk_tier")
    money = [units(c) for c in ("gross_cents", "fee_cents", "refund_cents", "dispute_lost_cents", "net_cents", "running_balance_cents")]
    return daily.join(now, "merchant_id", "left").select("settlement_date", "merchant_id", "name", "category", "risk_tier", "currency", "captured_count", *money)


def volume_by_bucket(lifecycle: DataFrame, at: str = "captured_at", minutes: int = 10) -> DataFrame:
    """Captures that aren't flagged, by ten minutes and currency."""
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / (minutes * 60)) * (minutes * 60))
    rows = lifecycle.filter(~F.col("is_flagged") & F.col(at).isNotNull())
    return rows.groupBy(bucket.alias("bucket"), "currency").agg(F.count(F.lit(1)).alias("captured"), F.sum("amount_cents").alias("captured_cents"), F.count_if(F.col("refunded_cents") > 0).alias("refunded"))


def runs(pipeline_runs: DataFrame) -> DataFrame:
    """Freshness and percentiles in minutes; a run over an hour behind was a backfill."""
    minutes = [(F.col(c) / 60.0).alias(c.replace("_s", "_min")) for c in ("freshness_s", "p50_s", "p95_s", "p99_s")]
    return pipeline_runs.select("run_ts", "events", "bronze_rows", *minutes, (F.col("p50_s") > 3600).alias("is_backfill"))


def catch_history(history: DataFrame) -> DataFrame:
    return history.withColumn("catch_rate", F.col("caught") / F.nullif("injected", F.lit(0)))


def top(rows: DataFrame, by: str, measure: str, n: int, where: str | None = None) -> DataFrame:
    """The n members with the largest sum, ties by name; where: the filter that holds before the ranking."""
    kept = rows.filter(where) if where else rows
    return kept.groupBy(by).agg(F.sum(measure).alias(measure)).orderBy(F.col(measure).desc(), by).limit(n)


def risk(rows: DataFrame) -> DataFrame:
    return rows.select("merchant_id", "name", "category", "current_risk_tier", "captured_30d", "disputes_30d", "refunded_30d", "flagged_30d", "chargeback_rate", "refund_rate")


def flags(violations: DataFrame) -> DataFrame:
    return violations.select("rule_name", "table_name", "pk", "observed")


def reconciliations(runs_: DataFrame) -> DataFrame:
    return runs_.select("run_ts", "mode", "checks", "mismatches")


def maintenance(runs_: DataFrame) -> DataFrame:
    return runs_.select("run_ts", "table_name", "files_before", "files_after", (F.col("bytes_before") / 1048576.0).alias("mb_before"), (F.col("bytes_after") / 1048576.0).alias("mb_after"))


def amount_split(daily: DataFrame) -> DataFrame:
    """Fees, refunds, lost disputes and net by currency, as rows."""
    named = {"fees": "fee_cents", "refunds": "refund_cents", "chargebacks": "dispute_lost_cents", "net": "net_cents"}
    sums = daily.groupBy("currency").agg(*(F.sum(c).alias(k) for k, c in named.items()))
    return sums.unpivot(["currency"], list(named), "part", "cents")


def captured_and_refunded(daily: DataFrame) -> DataFrame:
    return daily.groupBy("settlement_date", "currency").agg(F.sum("gross_cents").alias("gross_cents"), F.sum("refund_cents").alias("refund_cents"))


def volume_against_chargebacks(risk_rows: DataFrame, least: int = 20) -> DataFrame:
    return risk_rows.filter(F.col("captured_30d") >= least).select("merchant_id", "category", "captured_30d", "chargeback_rate")


def freshness(runs_: DataFrame) -> DataFrame:
    """By run, without backfills."""
    return runs(runs_).filter(~F.col("is_backfill")).select("run_ts", "freshness_min")


def catch_extremes(history: DataFrame) -> DataFrame:
    return catch_history(history).agg(F.max("catch_rate").alias("best"), F.min("catch_rate").alias("worst"))


def latest(runs_: DataFrame, n: int = 1, at: str = "run_ts") -> DataFrame:
    """The newest runs, the newest first; ties by all other columns."""
    return runs_.orderBy(F.col(at).desc(), *(c for c in runs_.columns if c != at)).limit(n)


def to_csv(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One file, sorted by the columns of order and then by all others, with a header even without rows, moments as
    naive UTC. These are reports for people; a large frame is written without this, as parquet."""
    first = order or []
    rows.orderBy(*first, *(c for c in rows.columns if c not in first)).coalesce(1).write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)

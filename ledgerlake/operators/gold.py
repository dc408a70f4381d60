"""Business tables: the merchant dimension, payments' lifecycles, daily settlement and 30-day risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import quality, temporal

MERCHANT_ATTRIBUTES = ("name", "category", "country", "risk_tier", "fee_bps", "status")


def merchant_versions(history: DataFrame) -> DataFrame:
    return temporal.versions(history, "merchant_id", MERCHANT_ATTRIBUTES)


def payment_lifecycle(payments: DataFrame, payments_history: DataFrame, refunds: DataFrame, disputes: DataFrame, violations: DataFrame) -> DataFrame:
    """A row per live payment. Every input is keyed by payment_id, and the history is read once for both moments."""
    first = lambda condition: F.min(F.when(condition, F.col("_source_ts")))
    moments = payments_history.groupBy("payment_id").agg(first(F.col("op").isin("c", "r")).alias("authorized_at"), first(F.col("status") == "captured").alias("captured_at"))
    paid_back = refunds.filter("status = 'succeeded'").join(quality.flagged(violations, "refunds", "refund_id"), "refund_id", "left_anti").groupBy("payment_id").agg(F.sum("amount_cents").alias("refunded_cents"))
    disputed = disputes.groupBy("payment_id").agg(F.count(F.lit(1)).alias("disputes"), F.coalesce(F.bool_or(F.col("status") == "lost"), F.lit(False)).alias("dispute_lost"))
    bad = quality.flagged(violations, "payments", "payment_id").withColumn("is_flagged", F.lit(True))
    joined = payments.drop("op", "_source_ts").join(moments, "payment_id", "left").join(paid_back, "payment_id", "left").join(disputed, "payment_id", "left").join(bad, "payment_id", "left")
    return joined.select(
        "payment_id", "merchant_id", "customer_id", "amount_cents", "currency", F.col("status").alias("current_status"), "card_brand", "failure_reason", "created_at", "authorized_at", "captured_at",
        F.coalesce("refunded_cents", F.lit(0)).cast("long").alias("refunded_cents"), (F.coalesce("disputes", F.lit(0)) > 0).alias("has_dispute"), F.coalesce("dispute_lost", F.lit(False)).alias("dispute_lost"),
        F.coalesce("is_flagged", F.lit(False)).alias("is_flagged"), (F.unix_timestamp("captured_at") - F.unix_timestamp("authorized_at")).alias("seconds_to_capture"),
    )


def rounded_fee(amount: Column, bps: Column) -> Column:
    """Per transaction, in exact decimals, half up."""
    return F.round(amount.cast("decimal(20,0)") * bps / F.lit(10000).cast("decimal(5,0)"), 0).cast("long")


def settled(history: DataFrame, key: str, status: str) -> DataFrame:
    """The moment at which a row first had the status, for each amount it had then."""
    return history.filter(F.col("status") == status).groupBy(key, "payment_id", "amount_cents").agg(F.min("_source_ts").alias("at"))


MEASURES = ["captured_count", "gross_cents", "fee_cents", "refund_cents", "dispute_lost_cents"]


def daily_settlement(lifecycle: DataFrame, merchants: DataFrame, refunds_history: DataFrame, disputes_history: DataFrame, violations: DataFrame) -> DataFrame:
    """What each merchant is owed by day and currency, with a running balance.

    Captures, refunds and lost disputes count on the day they happened; fees are those of the moment of capture.
    Flagged payments and refunds don't count. A group whose fees are all unknown has no fee and no net.
    """
    good = lifecycle.filter(~F.col("is_flagged"))

    def movement(rows: DataFrame, at: str, **measures: Column) -> DataFrame:
        named = [measures.get(m, F.lit(0)).cast("long").alias(m) for m in MEASURES]
        return rows.select(F.to_date(at).alias("settlement_date"), "merchant_id", "currency", *named)

    priced = temporal.as_of(good.filter("captured_at IS NOT NULL"), merchants, "merchant_id", "captured_at", ["fee_bps"])
    captures = movement(priced, "captured_at", captured_count=F.lit(1), gross_cents=F.col("amount_cents"), fee_cents=rounded_fee(F.col("amount_cents"), F.col("fee_bps")))
    payers = good.select("payment_id", "merchant_id", "currency")
    back = settled(refunds_history, "refund_id", "succeeded").join(quality.flagged(violations, "refunds", "refund_id"), "refund_id", "left_anti").join(payers, "payment_id")
    lost = settled(disputes_history, "dispute_id", "lost").join(payers, "payment_id")
    every = captures.unionByName(movement(back, "at", refund_cents=F.col("amount_cents"))).unionByName(movement(lost, "at", dispute_lost_cents=F.col("amount_cents")))
    daily = every.groupBy("settlement_date", "merchant_id", "currency").agg(*(F.sum(m).alias(m) for m in MEASURES))
    daily = daily.withColumn("net_cents", F.col("gross_cents") - F.col("fee_cents") - F.col("refund_cents") - F.col("dispute_lost_cents"))
    line = W.partitionBy("merchant_id", "currency").orderBy("settlement_date").rowsBetween(W.unboundedPreceding, W.currentRow)
    return daily.withColumn("running_balance_cents", F.sum("net_cents").over(line))


def merchant_risk(lifecycle: DataFrame, merchants: DataFrame, days: int = 30) -> DataFrame:
    """Disputes and refunds of the payments captured in the days up to the newest capture, by merchant."""
    newest = lifecycle.agg((F.max("captured_at") - F.expr(f"INTERVAL {days} DAYS")).alias("since"))
    recent = lifecycle.join(F.broadcast(newest), F.col("captured_at") >= F.col("since"))
    counts = recent.groupBy("merchant_id").agg(
        F.count("captured_at").alias("captured_30d"), F.count_if("has_dispute").alias("disputes_30d"), F.count_if("dispute_lost").alias("disputes_lost_30d"), F.count_if(F.col("refunded_cents") > 0).alias("refunded_30d"), F.count_if("is_flagged").alias("flagged_30d")
    )
    rate = lambda c: F.round(F.col(c) / F.nullif("captured_30d", F.lit(0)), 4)
    current = merchants.filter("is_current").select("merchant_id", "name", "category", F.col("risk_tier").alias("current_risk_tier"))
    return counts.join(current, "merchant_id", "left").withColumns({"chargeback_rate": rate("disputes_30d"), "refund_rate": rate("refunded_30d")})

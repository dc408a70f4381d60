"""A deterministic change log from spark.range and hashes: payments with their lives, refunds, disputes, bad rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START_MS = 1_759_600_000_000
EVERY = ["op", "table_name", "primary_key", "before", "after", "source_ts_ms", "source_lsn", "_kafka_topic", "_kafka_partition", "_kafka_offset"]


def draw(key: Column, salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(n))


def when_ms(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def log(rows: DataFrame, table: str, pk: str, op: Column, ms: Column, lsn: Column, **columns: Column) -> DataFrame:
    image = F.to_json(F.struct(*(c.alias(k) for k, c in columns.items())), {"ignoreNullFields": "false"})
    # topic-wide offsets follow the log's positions
    return rows.select(op.alias("op"), F.lit(table).alias("table_name"), columns[pk].cast("string").alias("primary_key"), F.when(op == "d", image).alias("before"), F.when(op != "d", image).alias("after"),
                       ms.cast("long").alias("source_ts_ms"), lsn.cast("long").alias("source_lsn"), F.lit(f"log.{table}").alias("_kafka_topic"), F.lit(0).alias("_kafka_partition"), lsn.cast("long").alias("_kafka_offset"))


def events(spark: SparkSession, payments: int, merchants: int = 50) -> DataFrame:
    """The log of that many payments: created, captured or failed, some refunded or disputed; about 1 % are bad.
    Merchants change their fee half-way."""
    m = spark.range(merchants).withColumn("ms", F.lit(START_MS))
    merchant = lambda fee, ms: {"merchant_id": F.col("id"), "name": F.concat(F.lit("m"), F.col("id")), "category": F.lit("retail"), "country": F.when(draw(F.col("id"), "country", 40) > 0, "US"), "risk_tier": F.lit("low"), "fee_bps": fee, "status": F.lit("active"), "created_at": when_ms(F.lit(START_MS - 86_400_000)), "updated_at": when_ms(ms)}
    fee = 200 + draw(F.col("id"), "fee", 10) * 10
    half = F.lit(START_MS + payments * 500)
    parts = [log(m, "merchants", "merchant_id", F.lit("r"), F.col("ms"), F.col("id") + 1, **merchant(fee, F.col("ms"))), log(m, "merchants", "merchant_id", F.lit("u"), half, F.lit(10 * payments * 10 // 2) + F.col("id") + 1000, **merchant(fee + 25, half))]
    p = spark.range(payments).withColumn("ms", F.lit(START_MS + 1000) + F.col("id") * 1000).withColumn("fate", draw(F.col("id"), "fate", 100)).withColumn("lsn", F.lit(1000) + F.col("id") * 100)
    bad = draw(F.col("id"), "bad", 300)
    amount = F.when(bad == 0, F.lit(-500)).when(bad == 1, F.lit(0)).otherwise(100 + draw(F.col("id"), "amount", 20_000)).cast("long")
    currency = F.when(bad == 2, "US$").otherwise(F.element_at(F.array(F.lit("USD"), F.lit("EUR"), F.lit("GBP")), (draw(F.col("id"), "currency", 3) + 1).cast("int")))

    def payment(status: str, ms: Column) -> dict[str, Column]:
        return {"payment_id": F.col("id"), "merchant_id": draw(F.col("id"), "merchant", merchants), "customer_id": draw(F.col("id"), "customer", 1000), "amount_cents": amount, "currency": currency, "status": F.lit(status), "card_brand": F.lit("visa"), "failure_reason": F.lit(None).cast("string"), "created_at": when_ms(F.col("ms")), "updated_at": when_ms(ms)}

    def at(step: int) -> tuple[Column, Column]:
        return F.col("ms") + step * 60_000, F.col("lsn") + step

    parts.append(log(p, "payments", "payment_id", F.lit("c"), *at(0), **payment("authorized", F.col("ms"))))
    parts.append(log(p.filter("fate < 90"), "payments", "payment_id", F.lit("u"), *at(2), **payment("captured", at(2)[0])))
    parts.append(log(p.filter("fate >= 95"), "payments", "payment_id", F.lit("u"), *at(2), **payment("failed", at(2)[0])))
    back = p.filter("fate < 8")
    refund = lambda status, ms: {"refund_id": F.col("id"), "payment_id": F.col("id"), "amount_cents": F.greatest(amount, F.lit(1)), "reason": F.lit("asked"), "status": F.lit(status), "created_at": when_ms(at(5)[0]), "updated_at": when_ms(ms)}
    parts += [log(back, "refunds", "refund_id", F.lit(op), *at(step), **refund(status, at(step)[0])) for op, step, status in (("c", 5, "pending"), ("u", 9, "succeeded"))]
    dispute = lambda status, ms: {"dispute_id": F.col("id"), "payment_id": F.col("id"), "amount_cents": amount, "reason": F.lit("fraud"), "status": F.lit(status), "created_at": when_ms(at(6)[0]), "updated_at": when_ms(ms)}
    some = p.filter("fate between 8 and 10")
    parts += [log(some, "disputes", "dispute_id", F.lit("c"), *at(6), **dispute("open", at(6)[0])), log(some.filter("fate < 10"), "disputes", "dispute_id", F.lit("u"), *at(12), **dispute("lost", at(12)[0]))]
    return reduce(DataFrame.unionByName, parts).select(*EVERY)


def redelivered(log_rows: DataFrame, fraction: float = 0.2, seed: int = 7) -> DataFrame:
    """The log with some events delivered again, in random order."""
    return log_rows.unionByName(log_rows.sample(fraction, seed)).orderBy(F.rand(seed))

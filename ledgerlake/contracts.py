"""Fixed contracts of the source tables: keys, columns, personal data, and the columns of a change event."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

EVENT_ID = ["_kafka_topic", "_kafka_partition", "_kafka_offset"]
TIME_COLUMNS = ("created_at", "updated_at")
OPS = ("c", "u", "d", "r")

_TYPES = {"STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "TIMESTAMP": T.TimestampType()}


def columns(ddl: str) -> T.StructType:
    """Plain 'name TYPE' lists; needs no session, unlike StructType.fromDDL."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(","))])


# The columns that the source sends, as its consumers must know them.
RAW = columns(
    "op STRING, table_name STRING, primary_key STRING, before STRING, after STRING, source_ts_ms BIGINT, source_lsn BIGINT, source_tx_id BIGINT, "
    "debezium_ts_ms BIGINT, _kafka_topic STRING, _kafka_partition INT, _kafka_offset BIGINT, _ingested_at TIMESTAMP"
)


@dataclass(frozen=True)
class Contract:
    pk: str
    schema: T.StructType
    pii: tuple[str, ...] = field(default=())

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()


def _contract(pk: str, ddl: str, *pii: str) -> Contract:
    times = ", created_at STRING, updated_at STRING"
    return Contract(pk, columns(ddl + times), pii)


# Tables, keys and columns of the source.
CONTRACTS = {
    "merchants": _contract("merchant_id", "merchant_id BIGINT, name STRING, category STRING, country STRING, risk_tier STRING, fee_bps INT, status STRING"),
    "customers": _contract("customer_id", "customer_id BIGINT, email STRING, country STRING", "email"),
    "payments": _contract("payment_id", "payment_id BIGINT, merchant_id BIGINT, customer_id BIGINT, amount_cents BIGINT, currency STRING, status STRING, card_brand STRING, failure_reason STRING"),
    "refunds": _contract("refund_id", "refund_id BIGINT, payment_id BIGINT, amount_cents BIGINT, reason STRING, status STRING"),
    "disputes": _contract("dispute_id", "dispute_id BIGINT, payment_id BIGINT, amount_cents BIGINT, reason STRING, status STRING"),
}

VIOLATIONS = columns("rule_name STRING, table_name STRING, pk STRING, observed STRING")
INJECTED = columns("injected_at STRING, table_name STRING, pk STRING, kind STRING")
CURRENCIES = ("USD", "EUR", "GBP")

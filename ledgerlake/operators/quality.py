"""Rules that flag bad rows, and how well they catch what is known to be bad."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import CURRENCIES

Tables = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Rule:
    """name and table of the violations; find gives rows with columns pk and observed."""

    name: str
    table: str
    find: Callable[[Tables], DataFrame]

    def violations(self, tables: Tables) -> DataFrame:
        return self.find(tables).select(F.lit(self.name).alias("rule_name"), F.lit(self.table).alias("table_name"), F.col("pk").cast("string").alias("pk"), F.col("observed").cast("string").alias("observed"))


def where(table: str, pk: str, condition: str, observed: str) -> Callable[[Tables], DataFrame]:
    return lambda tables: tables(table).filter(condition).select(F.col(pk).alias("pk"), F.expr(observed).alias("observed"))


def refund_against_payment(condition: str, observed: str) -> Callable[[Tables], DataFrame]:
    def find(tables: Tables) -> DataFrame:
        paid = tables("payments").select("payment_id", F.col("amount_cents").alias("paid_cents"), F.col("status").alias("payment_status"))
        return tables("refunds").join(paid, "payment_id").filter(condition).select(F.col("refund_id").alias("pk"), F.expr(observed).alias("observed"))

    return find


def created_in_future(tables: Tables) -> DataFrame:
    """Created later than the log first saw the row, by more than five minutes."""
    seen = tables("payments_history").groupBy("payment_id").agg(F.min("_source_ts").alias("first_seen"))
    late = tables("payments").join(seen, "payment_id").filter("created_at > first_seen + INTERVAL 5 MINUTES")
    return late.select(F.col("payment_id").alias("pk"), F.col("created_at").alias("observed"))


# The names of the rules and what they ask.
RULES = [
    Rule("amount_not_positive", "payments", where("payments", "payment_id", "amount_cents <= 0", "amount_cents")),
    Rule("invalid_currency", "payments", where("payments", "payment_id", f"currency IS NULL OR currency NOT IN {CURRENCIES}", "coalesce(currency, 'NULL')")),
    Rule("created_in_future", "payments", created_in_future),
    Rule("refund_exceeds_payment", "refunds", refund_against_payment("amount_cents > paid_cents", "concat(amount_cents, ' > ', paid_cents)")),
    Rule("refund_on_uncaptured_payment", "refunds", refund_against_payment("payment_status IN ('authorized', 'failed', 'voided')", "payment_status")),
    Rule("missing_country", "merchants", where("merchants", "merchant_id", "country IS NULL", "'NULL'")),
]


def violations(tables: Tables, rules: list[Rule] | None = None) -> DataFrame:
    """rule_name, table_name, pk and observed of all violations."""
    return reduce(DataFrame.unionByName, [r.violations(tables) for r in (RULES if rules is None else rules)])


def flagged(found: DataFrame, table: str, name: str) -> DataFrame:
    """The distinct keys of a table that were flagged; keys that aren't numbers name no row."""
    return found.filter(F.col("table_name") == table).select(F.col("pk").try_cast("long").alias(name)).filter(F.col(name).isNotNull()).distinct()


def catch_rate(injected: DataFrame, found: DataFrame, newest: DataFrame, at: str = "_source_ts") -> DataFrame:
    """injected, caught, false_positives and flagged_total, one row.

    Only what was injected two minutes or more before the newest event counts as injected; a flag is false if its
    row was never injected at all. One row injected in two ways counts twice.
    """
    horizon = newest.agg((F.max(at) - F.expr("INTERVAL 2 MINUTES")).alias("horizon"))
    key = ["table_name", "pk"]
    known = injected.select("table_name", F.col("pk").cast("string").alias("pk"), "kind", F.col("injected_at").cast("timestamp").alias("injected_at"))
    due = known.join(F.broadcast(horizon), F.col("injected_at") <= F.col("horizon").cast("timestamp")).select(*key, "kind").distinct()
    flags = found.select(*key).distinct()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [count(due, "injected"), count(due.join(flags, key), "caught"), count(flags.join(known.select(*key).distinct(), key, "left_anti"), "false_positives"), count(flags, "flagged_total")]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # four rows of one

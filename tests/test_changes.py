"""Changes to business tables, over a small log of our own: two merchants, five payments, refunds and a dispute."""

import datetime
import hashlib
import itertools
import json

import pytest

from ledgerlake import contracts
from ledgerlake.functions import envelope
from ledgerlake.operators import audit, changes, gold, quality

BEGIN = datetime.datetime(2030, 3, 17, 17, 46, 40, tzinfo=datetime.UTC)
COLUMNS = "op string, table_name string, primary_key string, before string, after string, source_ts_ms long, source_lsn long, source_tx_id long, debezium_ts_ms long, _kafka_topic string, _kafka_partition int, _kafka_offset long"


def clock(minute):
    return (BEGIN + datetime.timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%SZ")


class Log:
    """Collects events; the newest image of a row is carried on, so an update names what changes."""

    def __init__(self):
        self.rows, self.images, self.offsets = [], {}, {}

    def add(self, op, table, key, lsn, minute, times=1, **values):
        pk = contracts.CONTRACTS[table].pk
        image = self.images.setdefault((table, key), dict.fromkeys(contracts.CONTRACTS[table].columns) | {pk: key, "created_at": clock(minute)})
        image.update(values, updated_at=clock(minute))
        ms = int((BEGIN + datetime.timedelta(minutes=minute)).timestamp() * 1000)
        text, place = json.dumps(image), self.offsets.setdefault(table, itertools.count())
        row = (op, table, json.dumps({pk: key}), text if op == "d" else None, None if op == "d" else text, ms, lsn, 1, ms, f"ledger.{table}", 0, next(place))
        self.rows += [row] * times


@pytest.fixture(scope="module")
def events(spark):
    log = Log()
    log.add("r", "merchants", 71, 5, 0, name="north", category="books", country="DE", risk_tier="gold", fee_bps=150, status="open")
    log.add("c", "merchants", 72, 6, 2, name="south", category="tools", risk_tier="gold", fee_bps=400, status="open")
    log.add("u", "merchants", 71, 90, 20)
    log.add("u", "merchants", 71, 300, 95, fee_bps=175)
    log.add("u", "merchants", 71, 420, 200, risk_tier="silver")
    log.add("c", "customers", 900, 8, 3, email=" Kim@Mail.org", country="DE")
    log.add("d", "customers", 900, 700, 240)
    paid = {"merchant_id": 71, "customer_id": 900, "currency": "EUR", "card_brand": "amex"}
    log.add("c", "payments", 41, 100, 30, amount_cents=25_000, status="authorized", **paid)
    log.add("u", "payments", 41, 110, 33, times=2, status="captured")
    log.add("c", "payments", 42, 310, 100, amount_cents=8_000, status="authorized", **paid)
    log.add("u", "payments", 42, 320, 105, status="captured")
    log.add("c", "payments", 43, 330, 106, amount_cents=0, status="authorized", **paid)
    log.add("c", "payments", 44, 340, 107, amount_cents=900, status="authorized", **(paid | {"currency": "EURO", "channel": "web"}))
    log.add("c", "payments", 45, 350, 108, amount_cents=-1, status="authorized", **(paid | {"created_at": clock(120)}))
    log.add("c", "refunds", 501, 400, 150, payment_id=42, amount_cents=3_000, reason="broken", status="pending")
    log.add("u", "refunds", 501, 410, 170, status="succeeded")
    log.add("c", "refunds", 502, 411, 171, payment_id=42, amount_cents=9_000, status="succeeded")
    log.add("c", "refunds", 503, 412, 172, payment_id=44, amount_cents=100, status="succeeded")
    log.add("c", "disputes", 801, 415, 180, payment_id=41, amount_cents=25_000, reason="stolen", status="open")
    log.add("u", "disputes", 801, 430, 210, status="lost")
    return spark.createDataFrame(log.rows, COLUMNS).cache()


@pytest.fixture(scope="module")
def lake(events):
    once = changes.dedupe_events(events)
    out = {}
    for name, contract in contracts.CONTRACTS.items():
        h = changes.parse_changes(once, name)
        out[f"{name}_history"] = h
        out[name] = changes.live(changes.latest_per_key(h, contract.pk))
    found = quality.violations(out.__getitem__).cache()
    dim = gold.merchant_versions(out["merchants_history"])
    life = gold.payment_lifecycle(out["payments"], out["payments_history"], out["refunds"], out["disputes"], found)
    return out | {"found": found, "dim": dim, "life": life}


def settled(lake):
    return gold.daily_settlement(lake["life"], lake["dim"], lake["refunds_history"], lake["disputes_history"], lake["found"]).collect()


def test_deliveries_count_once(events):
    d = audit.duplicates(events).first()
    assert (d["deliveries"], d["events"], d["duplicates"]) == (21, 20, 1) and changes.dedupe_events(events).count() == 20


def test_state_tombstones_and_hashes(lake):
    assert {r["payment_id"]: r["status"] for r in lake["payments"].collect()} == {41: "captured", 42: "captured", 43: "authorized", 44: "authorized", 45: "authorized"}
    assert lake["customers"].count() == 0 and "email" not in lake["customers_history"].columns
    assert {r["op"]: r["email_hash"] for r in lake["customers_history"].collect()} == {"c": hashlib.sha256(b"kim@mail.org").hexdigest(), "d": None}


def test_drift_of_all_tables_at_once(events):
    assert [tuple(r) for r in changes.schema_drift(events).collect()] == [("payments", "channel", 340)]
    got = {tuple(r) for r in changes.schema_drift(events, {"disputes": ["dispute_id", "payment_id", "amount_cents", "status", "created_at"]}).collect()}
    assert got == {("disputes", "reason", 415), ("disputes", "updated_at", 415)}


def test_all_rules(lake):
    got = {(r["rule_name"], r["pk"]) for r in lake["found"].collect()}
    assert got == {("amount_not_positive", "43"), ("amount_not_positive", "45"), ("invalid_currency", "44"), ("created_in_future", "45"), ("refund_exceeds_payment", "502"), ("refund_on_uncaptured_payment", "503"), ("missing_country", "72")}


def test_versions_collapse_what_changes_nothing(lake):
    rows = lake["dim"].filter("merchant_id = 71").orderBy("valid_from").collect()
    assert [(r["fee_bps"], r["risk_tier"], r["is_current"]) for r in rows] == [(150, "gold", False), (175, "gold", False), (175, "silver", True)]
    assert [a["valid_to"] for a in rows[:-1]] == [b["valid_from"] for b in rows[1:]]


def test_lifecycles(lake):
    by_id = {r["payment_id"]: r for r in lake["life"].collect()}
    assert (by_id[41]["seconds_to_capture"], by_id[41]["refunded_cents"], by_id[41]["dispute_lost"]) == (180, 0, True)
    assert (by_id[42]["seconds_to_capture"], by_id[42]["refunded_cents"], by_id[42]["has_dispute"]) == (300, 3_000, False)
    assert [k for k, r in sorted(by_id.items()) if r["is_flagged"]] == [43, 44, 45]


def test_settlement_prices_at_the_moment_of_capture(lake):
    (day,) = settled(lake)
    fee = 25_000 * 150 // 10_000 + 8_000 * 175 // 10_000
    assert (day["captured_count"], day["gross_cents"], day["fee_cents"], day["refund_cents"], day["dispute_lost_cents"]) == (2, 33_000, fee, 3_000, 25_000)
    assert day["net_cents"] == day["running_balance_cents"] == 33_000 - fee - 3_000 - 25_000


def test_risk(lake):
    (risk,) = gold.merchant_risk(lake["life"], lake["dim"]).collect()
    assert (risk["merchant_id"], risk["captured_30d"], risk["disputes_lost_30d"], risk["current_risk_tier"]) == (71, 2, 1, "silver")
    assert (float(risk["refund_rate"]), float(risk["chargeback_rate"])) == (0.5, 0.5)


def test_a_group_without_fees_has_no_net(lake):
    (day,) = gold.daily_settlement(lake["life"], lake["dim"].limit(0), lake["refunds_history"].limit(0), lake["disputes_history"].limit(0), lake["found"]).collect()
    assert day["fee_cents"] is None and day["net_cents"] is None and day["gross_cents"] == 33_000


def test_catch_rate(lake, spark):
    injected = spark.createDataFrame([("2030-03-17T18:00:00Z", "payments", "43", "a"), ("2030-03-17T18:00:00Z", "payments", "41", "b"), ("2040-01-01T00:00:00Z", "payments", "44", "c")], contracts.INJECTED)
    r = quality.catch_rate(injected, lake["found"], lake["customers_history"]).first()
    assert (r["injected"], r["caught"], r["flagged_total"], r["false_positives"]) == (2, 1, 6, 4)


@pytest.mark.parametrize(
    ("value", "kind"),
    [(None, "skip"), ('{"ts_ms": 1}', "skip"), ("{not json", "bad"), ("[1, 2]", "bad"), ("42", "bad"), ('{"op": "x", "after": {"a": 1}, "source": {"table": "t"}}', "bad"), ('{"op": "u", "source": {"table": "t"}}', "bad"), ('{"op": "d", "before": {"a": 1}, "source": {"table": "t"}}', "event"), ('{"op": null, "after": {"a": 1}}', "bad"), ('{"op": "c", "after": {"a": 1}}', "event")],
)
def test_envelopes(spark, value, kind):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(value,)], "value string").select(envelope.classify(F.col("value")).alias("k")).first()["k"] == kind


def test_decode(spark):
    """The key stays JSON with all its columns; the topic names the table if the source doesn't."""
    full = json.dumps({"before": None, "after": {"payment_id": 1}, "op": "c", "ts_ms": 5, "source": {"table": "payments", "ts_ms": 4, "lsn": 9, "txId": 2}})
    brief = json.dumps({"op": "u", "after": {"a": 1}})
    m = spark.createDataFrame([('{"a": 1, "b": 2}', full, "t", 0, 7), (None, "{bad", "t", 0, 8), (None, brief, "x.public.refunds", 0, 9)], "key string, value string, topic string, partition int, offset long")
    events, dead = envelope.decode(m)
    r, other = events.orderBy("_kafka_offset").collect()
    assert (r["op"], r["table_name"], json.loads(r["primary_key"]), r["source_lsn"], r["_kafka_offset"], json.loads(r["after"])) == ("c", "payments", {"a": 1, "b": 2}, 9, 7, {"payment_id": 1})
    assert (other["table_name"], other["source_lsn"]) == ("refunds", None)
    assert dead.first()["offset"] == 8


def test_compare_and_loss(spark):
    side = lambda rows: spark.createDataFrame(rows, "key string, n long, cents long")
    got = {r["key"]: r["ok"] for r in audit.compare(side([("a", 1, 5), ("b", 2, 6), ("c", 1, 1)]), side([("a", 1, 5), ("b", 2, 7), ("d", 1, 1)])).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}
    source = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "pk long, state string")
    landed = spark.createDataFrame([(1, "u", "x"), (2, "u", "old"), (4, "u", "q"), (5, "d", "q")], "pk long, op string, state string")
    assert tuple(audit.loss(source, landed).first()) == (1, 1, 1)
    assert audit.freshness_lag(None, None) == 0 and audit.freshness_lag(1.0, None) == float("inf") and audit.freshness_lag(5.0, 9.0) == 0

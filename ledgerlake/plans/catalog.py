"""The registered queries of the engine, each with the SQL of the same result. Moments are shown as text, so that
no session's time zone matters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, changes, exports, gold, quality, temporal
from ..contracts import Contract, columns
from ..generator import redelivered
from ..sources import landing
from ..streaming import bronze
from ..tables import VersionedTable
from .roles import LOG_ID, Roles, sql

Query = Callable[[SparkSession, str], DataFrame]
_ENTRIES: dict[str, tuple[Callable[[Roles], DataFrame], str | None]] = {}
TIME = "'%Y-%m-%d %H:%M:%S'"


def _folder(r: Roles, name: str) -> str:
    """A new folder in the shared one (a temporary one only where the session names none)."""
    return f"{(r.spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shown(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def day(column: str) -> Column:
    return F.col(column).cast("date").cast("string").alias(column)


def query(name: str, text: str | None = None) -> Callable[[Callable[[Roles], DataFrame]], Callable[[Roles], DataFrame]]:
    def put(f: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
        _ENTRIES[name] = (f, sql(text) if text else None)
        return f

    return put


def queries() -> dict[str, Query]:
    return {name: (lambda spark, sf_dir, f=f: f(Roles(spark, sf_dir))) for name, (f, _) in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _ENTRIES.items() if text}


# --- changes


@query("dedupe_events", "SELECT DISTINCT part, lsn, pk, op, value FROM delivered")
def _(r: Roles) -> DataFrame:
    return changes.dedupe_events(r.delivered(), LOG_ID).select("part", "lsn", "pk", "op", "value")


@query("current_state", "SELECT pk, lsn, op, tier, fee_bps, value FROM state WHERE op <> 'd'")
def _(r: Roles) -> DataFrame:
    return r.state().filter("op <> 'd'").select("pk", "lsn", "op", "tier", "fee_bps", "value")


@query("tombstones", "SELECT pk, lsn FROM state WHERE op = 'd'")
def _(r: Roles) -> DataFrame:
    return r.state().filter("op = 'd'").select("pk", "lsn")


@query("history_insert_only", "SELECT part, lsn, pk, op FROM log")
def _(r: Roles) -> DataFrame:
    """The first half, and then the whole log with deliveries repeated, merged by event id."""
    t = VersionedTable(r.spark, _folder(r, "tables"), LOG_ID)
    t.insert_only(r.log().filter("lsn % 2 = 0"), LOG_ID)
    t.insert_only(r.delivered(), LOG_ID)
    return t.read().select("part", "lsn", "pk", "op")


@query("upsert_two_batches", "SELECT pk, lsn, op FROM state")
def _(r: Roles) -> DataFrame:
    """Newest rows of late events merged into newest rows of early ones, in the wrong order."""
    t = VersionedTable(r.spark, _folder(r, "tables"), ["pk"])
    for k in (1, 0):
        t.upsert_newer(r.log().filter(f"lsn % 2 = {k}"), "pk", ["lsn"])
    return t.read().select("pk", "lsn", "op")


@query("watermark_slice", "SELECT lsn, pk FROM log WHERE lsn > (SELECT max(lsn) FROM log WHERE lsn % 2 = 0) - 500")
def _(r: Roles) -> DataFrame:
    mark = r.log().filter("lsn % 2 = 0").agg((F.max("lsn") - 500).alias("mark")).first()["mark"]
    return landing.after(r.log(), mark, "lsn").select("lsn", "pk")


@query("parse_changes_typed", "SELECT lsn, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, moment IS NOT NULL AS has_time, op = 'd' AS is_deleted FROM log")
def _(r: Roles) -> DataFrame:
    image = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at")))
    events = r.log().select(
        "op", F.lit("events").alias("table_name"), F.when(F.col("op") == "d", image).alias("before"), F.when(F.col("op") != "d", image).alias("after"), F.col("lsn").alias("source_lsn"),
        F.unix_millis(F.col("at").cast("timestamp")).alias("source_ts_ms"), F.lit("log").alias("_kafka_topic"), F.col("part").cast("int").alias("_kafka_partition"), F.col("lsn").alias("_kafka_offset"),
    )
    rows = changes.parse_changes(events, "events", Contract("k", columns("k BIGINT, created_at STRING")))
    return rows.select(F.col("source_lsn").alias("lsn"), "k", F.col("created_at").isNotNull().alias("has_time"), F.col("_is_deleted").alias("is_deleted"))


@query("pii_hash", "SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN sha256(lower(trim(c_name))) END AS name_hash FROM customer")
def _(r: Roles) -> DataFrame:
    return r.table("customer").select("c_custkey", changes.hashed(F.col("c_name"), F.col("c_custkey") % 10 == 0).alias("name_hash"))


@query("schema_drift_keys", "SELECT 'events' AS table_name, key AS column_name, min(lsn) AS first_seen_lsn FROM (SELECT unnest(json_keys(props)) AS key, lsn FROM log) WHERE key NOT IN ('user_id') GROUP BY key")
def _(r: Roles) -> DataFrame:
    rows = r.log().select(F.lit("events").alias("table_name"), F.col("props").alias("after"), F.lit(None).cast("string").alias("before"), F.col("lsn").alias("source_lsn"))
    return changes.schema_drift(rows, {"events": ["user_id"]})


# --- versions


@query("scd2_versions", f"SELECT pk, tier, fee_bps, strftime(valid_from, {TIME}) AS valid_from, strftime(valid_to, {TIME}) AS valid_to, is_current FROM versions")
def _(r: Roles) -> DataFrame:
    return r.versions().select("pk", "tier", "fee_bps", shown("valid_from"), shown("valid_to"), "is_current")


@query("point_in_time_fee", "SELECT l.payment_id, v.fee_bps FROM life l LEFT JOIN versions v ON v.pk = l.merchant_id AND l.captured_at >= v.valid_from AND l.captured_at < v.valid_to WHERE l.captured_at IS NOT NULL")
def _(r: Roles) -> DataFrame:
    captured = r.lifecycle().filter("captured_at IS NOT NULL")
    return temporal.as_of(captured, r.merchants(), "merchant_id", "captured_at", ["fee_bps"]).select("payment_id", "fee_bps")


# --- quality


@query("dq_rules", "SELECT rule_name, table_name, pk, observed FROM found")
def _(r: Roles) -> DataFrame:
    return r.violations()


@query("dq_counts", "SELECT rule_name, count(*) AS n FROM found GROUP BY rule_name")
def _(r: Roles) -> DataFrame:
    return r.violations().groupBy("rule_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "rule_name")


INJECTED = "SELECT 'payments' AS table_name, CAST(payment_id AS VARCHAR) AS pk, TIMESTAMP '2024-01-01 00:00:00' <= (SELECT max(moment) FROM history) - INTERVAL 2 MINUTES AS due FROM own WHERE currency = 'US$' AND payment_id % 7 = 0"
FLAGS = "SELECT DISTINCT table_name, pk FROM found"


@query(
    "dq_catch_rate",
    f"""SELECT (SELECT count(*) FROM ({INJECTED}) WHERE due) AS injected, (SELECT count(*) FROM ({INJECTED}) JOIN ({FLAGS}) USING (table_name, pk) WHERE due) AS caught,
       (SELECT count(*) FROM ({FLAGS}) f WHERE NOT EXISTS (SELECT 1 FROM ({INJECTED}) i WHERE i.table_name = f.table_name AND i.pk = f.pk)) AS false_positives, (SELECT count(*) FROM ({FLAGS})) AS flagged_total""",
)
def _(r: Roles) -> DataFrame:
    return quality.catch_rate(r.injected(), r.violations(), r.payments_history())


@query("refund_anti_join", "SELECT refund_id, amount_cents FROM refunds WHERE refund_id NOT IN (SELECT refund_id FROM bad_refunds)")
def _(r: Roles) -> DataFrame:
    return r.refunds().join(quality.flagged(r.violations(), "refunds", "refund_id"), "refund_id", "left_anti").select("refund_id", "amount_cents")


# --- gold

LIFE = "payment_id, merchant_id, customer_id, amount_cents, currency, current_status, strftime(authorized_at, {t}) AS authorized_at, strftime(captured_at, {t}) AS captured_at, refunded_cents, has_dispute, dispute_lost, is_flagged, seconds_to_capture".format(t=TIME)


@query("payment_lifecycle", f"SELECT {LIFE} FROM life")
def _(r: Roles) -> DataFrame:
    plain = ["payment_id", "merchant_id", "customer_id", "amount_cents", "currency", "current_status"]
    return r.lifecycle().select(*plain, shown("authorized_at"), shown("captured_at"), "refunded_cents", "has_dispute", "dispute_lost", "is_flagged", "seconds_to_capture")


SETTLED = "CAST(day AS VARCHAR) AS settlement_date, merchant_id, currency, captured_count, gross_cents, fee_cents, refund_cents, dispute_lost_cents, net_cents, running_balance_cents"


@query("daily_settlement", f"SELECT {SETTLED} FROM settlement")
def _(r: Roles) -> DataFrame:
    rows = r.settlement()
    return rows.select(day("settlement_date"), *[c for c in rows.columns if c != "settlement_date"])


@query("settlement_by_currency", "SELECT currency, CAST(sum(gross_cents) AS BIGINT) AS gross_cents, CAST(sum(fee_cents) AS BIGINT) AS fee_cents, CAST(sum(refund_cents) AS BIGINT) AS refund_cents, CAST(sum(net_cents) AS BIGINT) AS net_cents FROM days GROUP BY currency")
def _(r: Roles) -> DataFrame:
    return r.settlement().groupBy("currency").agg(*(F.sum(c).alias(c) for c in ("gross_cents", "fee_cents", "refund_cents", "net_cents")))


@query("merchant_risk", "SELECT * FROM risk")
def _(r: Roles) -> DataFrame:
    return gold.merchant_risk(r.lifecycle(), r.merchants())


# --- audit


@query("reconcile_by_day", "SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS key, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents FROM own WHERE created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '1998-01-01' GROUP BY 1")
def _(r: Roles) -> DataFrame:
    rows = r.payments().filter("created_at >= TIMESTAMP_NTZ'1997-01-01 00:00:00' AND created_at < TIMESTAMP_NTZ'1998-01-01 00:00:00'")
    return audit.totals(rows.withColumn("day", F.to_date("created_at")), "day", "amount_cents")


@query("reconcile_by_status", "SELECT status AS key, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents FROM own GROUP BY status")
def _(r: Roles) -> DataFrame:
    return audit.totals(r.payments(), "status", "amount_cents")


@query(
    "reconcile_outer",
    """SELECT coalesce(s.key, l.key) AS key, coalesce(s.n, 0) AS source_n, coalesce(s.cents, 0) AS source_cents, coalesce(l.n, 0) AS lake_n, coalesce(l.cents, 0) AS lake_cents, coalesce(s.n, 0) = coalesce(l.n, 0) AND coalesce(s.cents, 0) = coalesce(l.cents, 0) AS ok
    FROM (SELECT CAST(merchant_id AS VARCHAR) AS key, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents FROM own WHERE merchant_id % 10 <> 1 GROUP BY 1) s FULL JOIN (SELECT CAST(merchant_id AS VARCHAR) AS key, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents FROM own WHERE merchant_id % 10 <> 2 AND payment_id % 50 <> 3 GROUP BY 1) l ON s.key = l.key""",
)
def _(r: Roles) -> DataFrame:
    source, lake = r.payments().filter("merchant_id % 10 <> 1"), r.payments().filter("merchant_id % 10 <> 2 AND payment_id % 50 <> 3")
    return audit.compare(audit.totals(source, "merchant_id", "amount_cents"), audit.totals(lake, "merchant_id", "amount_cents"))


@query(
    "no_loss_diff",
    """SELECT count(*) FILTER (WHERE a AND NOT b) AS missing, count(*) FILTER (WHERE NOT a AND b) AS extra, count(*) FILTER (WHERE a AND b AND NOT same) AS wrong
    FROM (SELECT s.pk IS NOT NULL AS a, l.pk IS NOT NULL AND l.op <> 'd' AS b, s.tier IS NOT DISTINCT FROM l.tier AS same FROM (SELECT * FROM state WHERE op <> 'd' AND pk % 9 <> 4) s FULL JOIN (SELECT pk, op, CASE WHEN pk % 6 = 0 THEN 'stale' ELSE tier END AS tier FROM state WHERE pk % 11 <> 5) l ON s.pk = l.pk)""",
)
def _(r: Roles) -> DataFrame:
    source = r.state().filter("op <> 'd' AND pk % 9 <> 4").select("pk", F.col("tier").alias("state"))
    landed = r.state().filter("pk % 11 <> 5").select("pk", "op", F.expr("CASE WHEN pk % 6 = 0 THEN 'stale' ELSE tier END").alias("state"))
    return audit.loss(source, landed)


@query("landing_profile", "SELECT part AS table_name, op, count(*) AS events FROM delivered GROUP BY part, op")
def _(r: Roles) -> DataFrame:
    return audit.landing_volume(r.delivered().withColumnRenamed("part", "table_name"))


@query("duplicate_check", "SELECT count(*) AS deliveries, (SELECT count(*) FROM log) AS events, count(*) - (SELECT count(*) FROM log) AS duplicates FROM delivered")
def _(r: Roles) -> DataFrame:
    return audit.duplicates(r.delivered(), LOG_ID)


@query("latency_percentiles", "SELECT round(quantile_cont(s, 0.5), 3) AS p50_s, round(quantile_cont(s, 0.95), 3) AS p95_s, round(quantile_cont(s, 0.99), 3) AS p99_s, round(max(s), 3) AS max_s FROM (SELECT ((lsn * 37) % 5000) / 1000.0 AS s FROM log)")
def _(r: Roles) -> DataFrame:
    return audit.latency(r.log().select((F.col("lsn") * 1000).alias("start"), (F.col("lsn") * 1000 + (F.col("lsn") * 37) % 5000).alias("end")), "start", "end")


@query("latency_percentiles_disc", "SELECT quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99 FROM (SELECT (lsn * 37) % 5000 AS ms FROM log)")
def _(r: Roles) -> DataFrame:
    ms = r.log().select(((F.col("lsn") * 37) % 5000).alias("ms"))
    return ms.agg(*(F.percentile_approx("ms", q, 1_000_000).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)))


@query("health_row", f"SELECT (SELECT count(*) FROM delivered) AS bronze_rows, (SELECT count(*) FROM log WHERE op <> 'r') AS events, strftime(greatest((SELECT max(moment) FROM log), (SELECT max(moment) FROM history)), {TIME}) AS newest")
def _(r: Roles) -> DataFrame:
    """The log was handled by this run, the payments' history before it began."""
    moment = lambda c: F.col(c).cast("timestamp").alias("_source_ts")
    own = r.log().select("op", moment("at"), F.lit("2030-01-02").cast("timestamp").alias("_processed_at"))
    past = r.payments_history().select("op", moment("_source_ts"), F.lit("2029-12-31").cast("timestamp").alias("_processed_at"))
    row = audit.health([own, past], r.delivered(), "2030-01-03", "2030-01-01").withColumnRenamed("max_source_ts", "newest")
    return row.select("bronze_rows", "events", shown("newest"))


# --- exports

PRICED = "gross_cents / 100.0 AS gross, fee_cents / 100.0 AS fee, refund_cents / 100.0 AS refund, dispute_lost_cents / 100.0 AS dispute_lost, net_cents / 100.0 AS net, running_balance_cents / 100.0 AS running_balance"


@query("volume_10min", f"SELECT strftime(time_bucket(INTERVAL 10 MINUTES, captured_at), {TIME}) AS bucket, currency, count(*) AS captured, CAST(sum(amount_cents) AS BIGINT) AS captured_cents, count(*) FILTER (WHERE refunded_cents > 0) AS refunded FROM good WHERE captured_at IS NOT NULL GROUP BY 1, 2")
def _(r: Roles) -> DataFrame:
    return exports.volume_by_bucket(r.lifecycle()).withColumn("bucket", shown("bucket"))


@query("export_settlement", f"SELECT CAST(s.day AS VARCHAR) AS settlement_date, s.merchant_id, 'm' || v.pk AS name, 'c' || (v.pk % 7) AS category, v.tier AS risk_tier, s.currency, s.captured_count, {PRICED} FROM settlement s LEFT JOIN versions v ON v.pk = s.merchant_id AND v.is_current")
def _(r: Roles) -> DataFrame:
    rows = exports.settlement(r.settlement(), r.merchants())
    return rows.withColumn("settlement_date", day("settlement_date"))


@query("risk_above_1pct", "SELECT merchant_id, captured_30d, chargeback_rate FROM risk WHERE captured_30d >= 20 AND chargeback_rate > 0.01 ORDER BY captured_30d DESC, merchant_id LIMIT 15")
def _(r: Roles) -> DataFrame:
    risky = gold.merchant_risk(r.lifecycle(), r.merchants()).filter("captured_30d >= 20 AND chargeback_rate > 0.01")
    return risky.orderBy(F.col("captured_30d").desc(), "merchant_id").limit(15).select("merchant_id", "captured_30d", "chargeback_rate")


@query("top10_by_net", "SELECT merchant_id, CAST(sum(net_cents) AS BIGINT) AS net_cents FROM days WHERE currency = 'USD' GROUP BY merchant_id ORDER BY net_cents DESC NULLS LAST, merchant_id LIMIT 10")
def _(r: Roles) -> DataFrame:
    return exports.top(r.settlement(), "merchant_id", "net_cents", 10, "currency = 'USD'")


@query("kpi_by_currency", "SELECT currency, CAST(sum(captured_count) AS BIGINT) AS captured_count, CAST(sum(gross_cents) AS BIGINT) AS gross_cents, CAST(sum(dispute_lost_cents) AS BIGINT) AS dispute_lost_cents FROM days GROUP BY currency")
def _(r: Roles) -> DataFrame:
    return r.settlement().groupBy("currency").agg(*(F.sum(c).alias(c) for c in ("captured_count", "gross_cents", "dispute_lost_cents")))


@query("flags_by_rule", "SELECT table_name, rule_name, count(*) AS flags, count(DISTINCT pk) AS rows_flagged FROM found GROUP BY table_name, rule_name")
def _(r: Roles) -> DataFrame:
    return r.violations().groupBy("table_name", "rule_name").agg(F.count(F.lit(1)).alias("flags"), F.count_distinct("pk").alias("rows_flagged"))


@query("export_risk", "SELECT merchant_id, name, category, current_risk_tier, captured_30d, disputes_30d, refunded_30d, flagged_30d, chargeback_rate, refund_rate FROM risk")
def _(r: Roles) -> DataFrame:
    return exports.risk(gold.merchant_risk(r.lifecycle(), r.merchants()))


@query("export_flags", "SELECT rule_name, table_name, pk, observed FROM found")
def _(r: Roles) -> DataFrame:
    return exports.flags(r.violations())


@query("amount_split", "SELECT currency, part, CAST(sum(cents) AS BIGINT) AS cents FROM (" + " UNION ALL ".join(f"SELECT currency, '{part}' AS part, {c} AS cents FROM days" for part, c in (("fees", "fee_cents"), ("refunds", "refund_cents"), ("chargebacks", "dispute_lost_cents"), ("net", "net_cents"))) + ") GROUP BY currency, part")
def _(r: Roles) -> DataFrame:
    return exports.amount_split(r.settlement())


@query("captured_and_refunded", "SELECT CAST(day AS VARCHAR) AS settlement_date, currency, CAST(sum(gross_cents) AS BIGINT) AS gross_cents, CAST(sum(refund_cents) AS BIGINT) AS refund_cents FROM days GROUP BY day, currency")
def _(r: Roles) -> DataFrame:
    return exports.captured_and_refunded(r.settlement()).withColumn("settlement_date", day("settlement_date"))


@query("volume_against_chargebacks", "SELECT merchant_id, category, captured_30d, chargeback_rate FROM risk WHERE captured_30d >= 20")
def _(r: Roles) -> DataFrame:
    return exports.volume_against_chargebacks(gold.merchant_risk(r.lifecycle(), r.merchants()))


# --- streams, run to their end over the same rows


def _streamed(r: Roles, name: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """The rows of a stream over events.parquet, run to its end into files in the shared folder (a temporary one
    only where the session names none)."""
    spark = r.spark
    rows = spark.readStream.schema(r.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(r.sf_dir)
    root = _folder(r, f"streams/{name}")
    out = build(rows).writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        q = out.format("parquet").start(f"{root}/rows")
    else:
        q = out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/rows")).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/rows")


@query("stream_bronze_append", "SELECT event_id, user_id, event_type FROM events")
def _(r: Roles) -> DataFrame:
    root = _folder(r, "streams")
    bronze.ingest(r.spark, r.sf_dir, f"{root}/rows", f"{root}/state", r.table("events").schema, "events.parquet").awaitTermination()
    return r.spark.read.parquet(f"{root}/rows").select("event_id", "user_id", "event_type")


@query("stream_dedupe", "SELECT DISTINCT event_id, user_id FROM events")
def _(r: Roles) -> DataFrame:
    twice = lambda rows: rows.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"), F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    return _streamed(r, "dedupe", lambda rows: bronze.deduplicated(twice(rows), "at", "400 days", ["event_id"]).select("event_id", "user_id"), "append")


@query("stream_tumbling", f"SELECT strftime(time_bucket(INTERVAL 10 MINUTES, ts), {TIME}) AS bucket, count(*) AS events FROM events GROUP BY 1")
def _(r: Roles) -> DataFrame:
    return _streamed(r, "tumbling", lambda rows: bronze.tumbling(rows, "ts"), "complete").select(shown("bucket"), "events")


@query("replay_identical", "SELECT currency, true AS identical FROM days GROUP BY currency")
def _(r: Roles) -> DataFrame:
    """The settlement's totals over a log of which a fifth came twice and out of order, against those of the log."""
    measures = ["gross_cents", "fee_cents", "refund_cents", "net_cents"]
    total = lambda rows, x: rows.groupBy("currency").agg(*(F.sum(m).alias(f"{x}_{m}") for m in measures))

    class Replayed(Roles):
        def log(self) -> DataFrame:
            return changes.dedupe_events(redelivered(super().log()), LOG_ID)

    a, b = total(r.settlement(), "a"), total(Replayed(r.spark, r.sf_dir).settlement(), "b")
    same = [F.col(f"a_{m}").eqNullSafe(F.col(f"b_{m}")) for m in measures]
    return a.join(b, "currency", "full").select("currency", (same[0] & same[1] & same[2] & same[3]).alias("identical"))

import datetime
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from ledgerlake.generator import events
from ledgerlake.operators import exports
from ledgerlake.plans import jobs
from ledgerlake.plans.lake import Lake
from ledgerlake.sources import files
from ledgerlake.streaming import land


def test_publish_stops_at_what_fails_and_drops_stale_files(spark, tmp_path, monkeypatch):
    source = tmp_path / "landing" / "payments" / "ingest_date=2025-01-01"
    source.mkdir(parents=True)
    for k in (2, 1, 3):
        (source / f"part-{k}.parquet").write_text(str(k))
        os.utime(source / f"part-{k}.parquet", (k % 3 + 1, k % 3 + 1))
    (source / "part-4.parquet.tmp").write_text("half")
    (tmp_path / "truth.jsonl").write_text("{}")
    part = "payments/ingest_date=2025-01-01/part-{}.parquet".format
    args = [str(tmp_path / x) for x in ("landing", "raw", "archive")]
    assert files.complete(spark, args[0]) == [part(3), part(1), part(2)] and files.complete(spark, str(tmp_path / "none")) == []
    real = files.Files.copy

    def full(self, a, b):
        if "part-1" in a:
            raise OSError("disk full")
        real(self, a, b)

    truth = (str(tmp_path / "truth.jsonl"), str(tmp_path / "raw" / "truth.jsonl"))
    monkeypatch.setattr(files.Files, "copy", full)
    assert files.publish(spark, *args, truth) == (1, part(1)) and not (tmp_path / "raw" / "truth.jsonl").exists()
    monkeypatch.undo()
    assert files.publish(spark, *args, truth) == (2, None) and files.complete(spark, args[0]) == []
    assert (tmp_path / "raw" / part(2)).read_text() == (tmp_path / "archive" / part(2)).read_text() == "2" and (tmp_path / "raw" / "truth.jsonl").exists()
    assert files.drop_stale(spark, args[0]) == 0 and files.drop_stale(spark, args[0], now=time.time() + 700) == 1


def test_jobs_skip_retry_and_gate():
    calls = []

    def flaky(parameters):
        calls.append(parameters["n"])
        if len(calls) < 3:
            raise RuntimeError("again")

    tasks = [
        jobs.Task("slot", lambda p: jobs.slot(p["bytes"]), gate=True),
        jobs.Task("load", flaky, ("slot",), retries=2),
        jobs.Task("check", lambda p: jobs.Outcome(False, 1, ["off"]), ("load",)),
        jobs.Task("report", lambda p: None, ("check",)),
        jobs.Task("slow", lambda p: time.sleep(0.02), ("load",), timeout_s=0.001),
    ]
    assert jobs.run_job(tasks, {"n": 7, "bytes": 5}) == {"slot": "done", "load": "done", "check": "failed", "report": "skipped", "slow": "late"}
    assert calls == [7, 7, 7]
    assert set(jobs.run_job(tasks, {"n": 7, "bytes": jobs.SLOT_BYTES + 1}).values()) == {"skipped"}
    assert not jobs.slot(None).ok


def test_bound_values_are_literals(spark):
    from ledgerlake.sources import landing

    assert landing.bound(spark, "SELECT id FROM range(5) WHERE id > :low AND :text = 'x OR 1'", low=2, text="x OR 1").count() == 2


def test_landing_survives_a_crash_between_write_and_commit(spark, tmp_path):
    one = lambda k, v: {"key": json.dumps({"payment_id": k}), "value": v, "topic": "t", "partition": 0, "offset": k}
    good = json.dumps({"op": "c", "after": {"payment_id": 1}, "source": {"table": "payments", "lsn": 1, "ts_ms": 1}})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(one(k, v)) for k, v in enumerate([good, "{bad", good])))
    schema = "key string, value string, topic string, partition int, offset long"
    messages = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in"))
    target = [str(tmp_path / x) for x in ("landing", "dead", "state")]

    def crash(number):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        land.land(messages(), *target, fault=crash).awaitTermination()
    land.land(messages(), *target).awaitTermination()
    landed = spark.read.parquet(target[0])
    assert landed.count() == 4 and landed.select("_kafka_offset").distinct().count() == 2  # twice, none lost
    assert spark.read.json(target[1]).select("offset").distinct().count() == 1
    land.land(messages(), *target).awaitTermination()
    assert spark.read.parquet(target[0]).count() == 4


def test_reconciliation_and_scores(spark, tmp_path):
    log = events(spark, 1200, 5).withColumns({"source_tx_id": F.lit(1).cast("long"), "debezium_ts_ms": F.col("source_ts_ms"), "_ingested_at": F.current_timestamp()})
    log.write.parquet(str(tmp_path / "landing"))
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.run(str(tmp_path / "landing"))
    truth = lake.read("payments").select("payment_id", "amount_cents", "status", F.col("created_at").cast("string").alias("created_at"))
    today = datetime.date(2025, 10, 6)
    assert jobs.reconcile(lake, {"payments": truth}, "daily", today=today).exit_code == 0
    off = truth.withColumn("amount_cents", F.col("amount_cents") + (F.col("payment_id") == 7).cast("int"))
    found = jobs.reconcile(lake, {"payments": off, "nothing": truth.filter("payment_id < 3")}, "full")
    assert found.exit_code == 1 and any(f.startswith("payments") for f in found.failed) and any(f.startswith("nothing") for f in found.failed)
    many = truth.withColumn("created_at", F.col("payment_id").cast("string")).filter("payment_id < 0")
    assert jobs.reconcile(lake, {"payments": many}, "full").exit_code == 1
    told = [r["mismatches"] for r in lake.table("ops", "reconciliation_runs").read().orderBy("run_ts").collect()]
    assert told[0] == 0 and told[1] >= 2 and told[2] == lake.read("payments").select("status").distinct().count()
    assert exports.latest(lake.table("ops", "reconciliation_runs").read(), 2).count() == 2
    lake.record_run("2000-01-01", "2030-01-01")
    run = lake.table("ops", "pipeline_runs").read().first()
    assert run["bronze_rows"] == log.count() and run["events"] > 0 and run["freshness_s"] > 0
    assert lake.good_payments().count() == spark.table("payments_good").count() == lake.read("payments").count() - lake.table("ops", "dq_results").read().filter("table_name = 'payments'").select("pk").distinct().count()
    bad = lake.read("payments").filter("amount_cents <= 0").select(F.lit("payments").alias("table_name"), F.col("payment_id").cast("string").alias("pk"), F.lit("k").alias("kind"), F.lit("2025-10-04T17:46:40Z").alias("injected_at"))
    row = jobs.score(lake, bad).first()
    assert row["injected"] == row["caught"] > 0
    daily = lake.table("gold", "daily_settlement").read()
    assert exports.amount_split(daily).count() == 12
    exports.to_csv(daily.limit(0), str(tmp_path / "csv"))
    (part,) = [f for f in os.listdir(tmp_path / "csv") if f.endswith(".csv")]
    assert (tmp_path / "csv" / part).read_text().startswith("settlement_date,")


def test_lag_and_freshness():
    text = "GROUP TOPIC PARTITION CURRENT-OFFSET LOG-END-OFFSET LAG\ng t 0 10 100 90\ng t 1 - 50 -\nother t 0 1 9 8\n"
    assert jobs.consumer_lag(text, "g") == 140
    assert jobs.freshness(None, None).ok and not jobs.freshness(1.0, None).ok and jobs.freshness(7000.0, 0.0).ok and not jobs.freshness(7300.0, 0.0).ok

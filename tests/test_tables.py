import random

from ledgerlake.generator import events, redelivered
from ledgerlake.operators import audit, gold
from ledgerlake.plans.lake import Lake
from ledgerlake.tables import VersionedTable

SCHEMA = "pk long, source_lsn long, _kafka_offset long, v string"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("pk", "source_lsn", "_kafka_offset", "v").collect())


def test_upserts_do_not_depend_on_order(spark, tmp_path):
    rng = random.Random(5)
    log = [(rng.randrange(6), lsn, rng.randrange(3), f"v{lsn}") for lsn in range(40)] + [(1, None, 0, "no position")]
    want = {}
    for r in log:
        if r[0] not in want or (r[1] or -1, r[2]) > (want[r[0]][1] or -1, want[r[0]][2]):
            want[r[0]] = r
    for k in range(2):
        shuffled = rng.sample(log, len(log)) + rng.sample(log, 8)
        t = VersionedTable(spark, str(tmp_path / f"t{k}"))
        for i in range(0, len(shuffled), 17):
            t.upsert_newer(spark.createDataFrame(shuffled[i : i + 17], SCHEMA), "pk")
        assert rows_of(t.read()) == sorted(want.values())


def test_insert_only_delete_vacuum(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.version() is None and t.vacuum() == []
    t.insert_only(spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 1, "a")], SCHEMA), ["pk"])
    t.insert_only(spark.createDataFrame([(1, 2, 1, "b"), (2, 2, 1, "c")], SCHEMA), ["pk"])
    assert rows_of(t.read()) == [(1, 1, 1, "a"), (2, 2, 1, "c")]
    from pyspark.sql import functions as F

    t.delete(F.col("pk") == 1)
    assert rows_of(t.read()) == [(2, 2, 1, "c")] and t.version() == 3
    assert t.vacuum() == [1, 2] and t.versions() == [3]
    # a crash before the pointer moves leaves files that no version names, or a version that isn't seen
    spark.createDataFrame([(9, 9, 9, "z")], SCHEMA).write.parquet(str(tmp_path / "t" / "data-lost"))
    (tmp_path / "t" / "v4.json").write_text((tmp_path / "t" / "v3.json").read_text())
    assert rows_of(t.read()) == [(2, 2, 1, "c")] and t.vacuum() == [4] and not (tmp_path / "t" / "data-lost").exists()
    assert rows_of(t.read()) == [(2, 2, 1, "c")]


def test_a_change_leaves_other_files_as_they_are(spark, tmp_path):
    from pyspark.sql import functions as F

    t = VersionedTable(spark, str(tmp_path / "t"), ["pk"], buckets=8)
    t.upsert_newer(spark.range(200).select(F.col("id").alias("pk"), F.lit(1).cast("long").alias("source_lsn"), F.lit(0).cast("long").alias("_kafka_offset"), F.lit("a").alias("v")), "pk")
    before = set(t.files())
    assert len(before) == 8
    t.upsert_newer(spark.createDataFrame([(5, 2, 0, "b"), (5, 0, 0, "old")], SCHEMA), "pk")
    after = set(t.files())
    assert len(before - after) == 1 == len(after - before) and t.read().count() == 200 and t.read().filter("v = 'b'").count() == 1
    t.insert_only(spark.createDataFrame([(5, 9, 0, "no"), (None, 9, 0, "null key"), (None, 9, 0, "null key"), (900, 1, 1, "new")], SCHEMA), ["pk"])
    t.insert_only(spark.createDataFrame([(None, 9, 0, "again")], SCHEMA), ["pk"])
    assert after <= set(t.files()) and t.read().count() == 202
    held = set(t.files())
    t.delete(F.col("pk") == 900)
    assert len(held - set(t.files())) <= 2 and t.read().count() == 201
    old = t.version()
    t.append(spark.createDataFrame([(901, 1, 1, "x", 3)], SCHEMA + ", extra int"))
    assert t.read().filter("extra = 3").count() == 1 and t.read(old).count() == 201 and "extra" not in t.read(old).columns
    t.compact()
    assert t.detail()["files"] <= 8 and t.read().count() == 202 and t.vacuum(1) and t.read().count() == 202


def test_bootstrap_makes_empty_tables(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.bootstrap()
    lake.bootstrap()
    assert lake.read("payments").count() == 0 and lake.table("silver", "payments_history").version() == 1


def test_lake_end_to_end_and_replay(spark, tmp_path):
    log = events(spark, 300, 8)
    full = [c for c in ("source_tx_id", "debezium_ts_ms", "_ingested_at")]
    from pyspark.sql import functions as F

    def landed(df, name):
        df.withColumns({full[0]: F.lit(1).cast("long"), full[1]: F.col("source_ts_ms"), full[2]: F.current_timestamp()}).write.mode("append").parquet(str(tmp_path / name))

    landed(log.filter("source_lsn % 2 = 0"), "landing")
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.run(str(tmp_path / "landing"))
    landed(log, "landing")  # half of it again
    lake.run(str(tmp_path / "landing"))
    assert lake.read("payments_history").count() == log.filter("table_name = 'payments'").count()
    lake.silver()  # nothing new
    assert lake.events_processed == 0
    landed(redelivered(log), "other")
    other = Lake(spark, str(tmp_path / "lake2"))
    other.run(str(tmp_path / "other"))
    columns = ["settlement_date", "merchant_id", "currency", "gross_cents", "fee_cents", "refund_cents", "net_cents", "running_balance_cents"]
    a, b = (audit.digest(x.table("gold", "daily_settlement").read(), columns).first() for x in (lake, other))
    assert a == b and a["n"] > 10
    assert lake.table("gold", "merchant_risk").read().filter("captured_30d > 0").count() == 8
    found = lake.table("ops", "dq_results").read()
    assert found.filter("rule_name = 'missing_country'").count() == lake.read("merchants").filter("country is null").count()
    rebuilt = gold.merchant_versions(lake.read("merchants_history"))
    assert rebuilt.count() == 16  # every merchant changed its fee once
    assert lake.maintain()["gold.merchant_risk"]["files_after"] == 1
    assert lake.table("ops", "maintenance_runs").read().count() > 10
    assert lake.table("ops", "quarantine").read().count() == 0

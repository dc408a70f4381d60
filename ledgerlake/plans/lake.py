"""The chain from landed events to business tables: bronze, silver, quality, gold; each stage may be run again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import CONTRACTS, EVENT_ID, RAW, VIOLATIONS
from ..operators import audit, changes, gold, quality
from ..sources import landing
from ..streaming import bronze
from ..tables import VersionedTable

#: The keys by which tables are bucketed; the others are small or written as a whole.
KEYS = {f"silver.{name}_state": [c.pk] for name, c in CONTRACTS.items()} | {f"silver.{name}_history": EVENT_ID for name in CONTRACTS}
#: Tables that are read before a first run may have written them.
OPS = {"dq_results": VIOLATIONS, "watermarks": "pipeline STRING, value STRING", "schema_drift": "table_name STRING, column_name STRING, first_seen_lsn LONG"}


@dataclass
class Lake:
    spark: SparkSession
    root: str
    events_processed: int = 0

    def table(self, schema: str, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{schema}/{name}", KEYS.get(f"{schema}.{name}", []))

    def bootstrap(self) -> None:
        """All tables whose shape is known before any data, empty; those that are there stay."""
        for name, contract in CONTRACTS.items():
            rows = changes.parse_changes(self.spark.createDataFrame([], RAW), name, contract)
            for kind in ("history", "state"):
                self.table("silver", f"{name}_{kind}").create_if_absent(rows)
        for name, shape in OPS.items():
            self.table("ops", name).create_if_absent(self.spark.createDataFrame([], shape))

    def ingest(self, source: str) -> None:
        bronze.ingest(self.spark, source, f"{self.root}/bronze/events", f"{self.root}/checkpoints/bronze").awaitTermination()

    def bronze_rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/bronze/events")

    def silver(self, full_refresh: bool = False) -> None:
        """What came since the watermark, into histories (exactly once) and states (newest per key); the watermark
        moves last, so a run that fails is simply run again."""
        marks = self.table("ops", "watermarks")
        if full_refresh:
            for name in CONTRACTS:
                for kind in ("history", "state"):
                    self.table("silver", f"{name}_{kind}").drop()
            marks.drop()
        known = marks.read().first() if marks.exists() else None
        mark = known["value"] if known else None
        rows = landing.after(self.bronze_rows(), mark).persist()
        try:
            newest = rows.agg(F.max("_bronze_loaded_at").cast("string").alias("m"), F.count(F.lit(1)).alias("n")).first()
            self.events_processed = newest["n"]
            once = changes.dedupe_events(rows)
            for name, contract in CONTRACTS.items():
                good, bad = changes.quarantined(changes.parse_changes(once, name), contract.pk)
                self.table("ops", "quarantine").insert_only(bad.select(F.lit(name).alias("table_name"), "op", "source_lsn", "source_ts_ms", *EVENT_ID, "_processed_at"), EVENT_ID)
                self.table("silver", f"{name}_history").insert_only(good, EVENT_ID)
                self.table("silver", f"{name}_state").upsert_newer(changes.latest_per_key(good, contract.pk), contract.pk)
            self.table("ops", "schema_drift").insert_only(changes.schema_drift(once), ["table_name", "column_name"])
            if newest["m"] is not None:
                marks.overwrite(self.spark.createDataFrame([("silver", newest["m"])], "pipeline STRING, value STRING"))
        finally:
            rows.unpersist()

    def read(self, name: str) -> DataFrame:
        """payments: live rows; payments_history: all changes."""
        return self.table("silver", name).read() if name.endswith("_history") else changes.live(self.table("silver", f"{name}_state").read())

    def quality(self) -> None:
        """New violations are added; the first finding of one stays."""
        self.table("ops", "dq_results").insert_only(quality.violations(self.read), ["rule_name", "table_name", "pk"])

    def gold(self) -> None:
        found = self.table("ops", "dq_results").read()
        dim, facts = self.table("gold", "dim_merchant"), self.table("gold", "payment_lifecycle")
        dim.overwrite(gold.merchant_versions(self.read("merchants_history")))
        facts.overwrite(gold.payment_lifecycle(self.read("payments"), self.read("payments_history"), self.read("refunds"), self.read("disputes"), found))
        self.table("gold", "daily_settlement").overwrite(gold.daily_settlement(facts.read(), dim.read(), self.read("refunds_history"), self.read("disputes_history"), found))
        self.table("gold", "merchant_risk").overwrite(gold.merchant_risk(facts.read(), dim.read()))

    def run(self, source: str, full_refresh: bool = False) -> None:
        self.ingest(source)
        self.silver(full_refresh)
        self.quality()
        self.gold()

    def good_payments(self, view: str = "payments_good") -> DataFrame:
        """Live payments that no rule flagged, also as a view of that name."""
        flagged = quality.flagged(self.table("ops", "dq_results").read(), "payments", "payment_id")
        rows = self.read("payments").join(flagged, "payment_id", "left_anti")
        rows.createOrReplaceTempView(view)
        return rows

    def record_run(self, since: str, now: str) -> DataFrame:
        """The health of a run that began at `since`, added to the record of runs."""
        histories = [self.table("silver", f"{name}_history").read().select("op", "_source_ts", "_processed_at") for name in CONTRACTS]
        row = audit.health(histories, self.bronze_rows(), now, since).withColumn("run_ts", F.lit(now).cast("timestamp"))
        self.table("ops", "pipeline_runs").append(row)
        return row

    def maintain(self, keep: int = 1) -> dict[str, dict[str, int]]:
        """Compacts every table; figures before and after, which are recorded too."""
        out = {}
        for schema, name in [("silver", f"{t}_{k}") for t in CONTRACTS for k in ("history", "state")] + [("gold", n) for n in ("dim_merchant", "payment_lifecycle", "daily_settlement", "merchant_risk")]:
            t = self.table(schema, name)
            if t.exists():
                before = t.detail()
                t.compact()
                t.vacuum(keep)
                now = t.detail()
                out[f"{schema}.{name}"] = {"files_before": before["files"], "files_after": now["files"], "bytes_before": before["bytes"], "bytes_after": now["bytes"]}
        if out:
            rows = [(name, *(f[k] for k in ("files_before", "files_after", "bytes_before", "bytes_after"))) for name, f in out.items()]
            told = self.spark.createDataFrame(rows, "table_name STRING, files_before LONG, files_after LONG, bytes_before LONG, bytes_after LONG")
            self.table("ops", "maintenance_runs").append(told.withColumn("run_ts", F.current_timestamp()))
        return out

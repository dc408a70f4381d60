"""Scheduled jobs around the lake: reconciliation, freshness, lag, run records; each returns what a scheduler needs."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, quality
from .lake import Lake

FRESHNESS_S, SLOT_BYTES = 2 * 3600, 512 * 1024 * 1024


@dataclass(frozen=True)
class Outcome:
    ok: bool
    checks: int
    failed: list[str]

    @property
    def exit_code(self) -> int:
        return 0 if self.ok else 1


def reconcile(lake: Lake, source: dict[str, DataFrame], mode: str = "daily", days: int = 7, today: datetime.date | None = None) -> Outcome:
    """Counts and cents of payments, refunds and disputes by closed UTC day (daily) or by status (full), against the
    source's tables. A table that the lake lacks has all its rows missing. The run is recorded with all mismatches;
    the outcome names ten of a table."""
    end = today or datetime.datetime.now(datetime.UTC).date()
    start, failed, checks, bad = end - datetime.timedelta(days=days), [], 0, 0
    for name, truth in source.items():
        have = lake.table("silver", f"{name}_state")
        mine = lake.read(name) if have.exists() else truth.limit(0)
        sides = [truth, mine]
        if mode == "daily":
            sides = [audit.closed_days(s.withColumn("created_at", F.col("created_at").cast("timestamp")), "created_at", str(start), str(end)).withColumn("key", F.to_date("created_at")) for s in sides]
        key = "key" if mode == "daily" else "status"
        told = audit.compare(*(audit.totals(s, key, "amount_cents") for s in sides))
        counts = told.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("bad")).first()
        checks += counts["n"]
        bad += counts["bad"]
        failed += [f"{name} {r['key']}" for r in told.filter(~F.col("ok")).orderBy("key").limit(10).collect()]
    record(lake, "reconciliation_runs", mode=mode, checks=checks, mismatches=bad)
    return Outcome(not bad, checks, failed)


def record(lake: Lake, table: str, **values: object) -> None:
    """One row of a run, with its moment."""
    row = lake.spark.createDataFrame([tuple(values.values())], list(values)).withColumn("run_ts", F.current_timestamp())
    lake.table("ops", table).append(row)


def score(lake: Lake, injected: DataFrame) -> DataFrame:
    """The catch rate of this run, added to its history."""
    row = quality.catch_rate(injected, lake.table("ops", "dq_results").read(), lake.read("payments_history"))
    lake.table("ops", "dq_catch_rate_history").append(row.withColumn("run_ts", F.current_timestamp()))
    return row


def freshness(source_s: float | None, lake_s: float | None, most: float = FRESHNESS_S) -> Outcome:
    lag = audit.freshness_lag(source_s, lake_s)
    return Outcome(lag <= most, 1, [] if lag <= most else [f"{lag:.0f} s behind"])


def consumer_lag(text: str, group: str) -> int:
    """Messages that a consumer group is behind, from the usual listing (group, topic, partition, current offset,
    end offset, ...); a partition that was never committed ('-') is behind by all of its messages."""
    total = 0
    for line in text.splitlines():
        f = line.split()
        if len(f) >= 5 and f[0] == group and f[4].isdigit():
            total += int(f[4]) - (int(f[3]) if f[3].isdigit() else 0)
    return total


def slot(retained_bytes: int | None, most: int = SLOT_BYTES) -> Outcome:
    """Whether the source's replication slot is there and keeps no more of its log than that."""
    if retained_bytes is None:
        return Outcome(False, 1, ["no slot"])
    return Outcome(retained_bytes <= most, 1, [] if retained_bytes <= most else [f"{retained_bytes} bytes kept"])


@dataclass(frozen=True)
class Task:
    """run takes the job's parameters. A gate that fails skips what depends on it without failing the job."""

    name: str
    run: Callable[[dict[str, object]], object]
    after: tuple[str, ...] = ()
    retries: int = 1
    timeout_s: float = 3600
    gate: bool = False


def run_job(tasks: list[Task], parameters: dict[str, object] | None = None, wait_s: float = 0) -> dict[str, str]:
    """done, failed, late or skipped for each task, in the order given, each once what it depends on is done. A task that
    raises is tried again as often as it asks for; one that returns a failed Outcome or False isn't. A task that took
    longer than its limit is late, and what depends on it is skipped."""
    state: dict[str, str] = {}
    for task in tasks:
        if any(state[name] != "done" for name in task.after):
            state[task.name] = "skipped"
            continue
        for attempt in range(task.retries + 1):
            begun = time.monotonic()
            try:
                result = task.run(parameters or {})
            except Exception:
                state[task.name] = "failed"
                if attempt < task.retries:
                    time.sleep(wait_s)
                continue
            ok = result.ok if isinstance(result, Outcome) else result is not False
            late = time.monotonic() - begun > task.timeout_s
            state[task.name] = "late" if late else "done" if ok else "skipped" if task.gate else "failed"
            break
    return state


def lake_job(lake: Lake, source: str, retained_bytes: Callable[[], int | None]) -> list[Task]:
    """The scheduled chain: the slot is a gate; a run of the lake, its record and the maintenance follow."""
    begun = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")
    now = lambda: datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")
    return [
        Task("slot", lambda p: slot(retained_bytes()), gate=True),
        Task("ingest", lambda p: lake.ingest(source), ("slot",)),
        Task("silver", lambda p: lake.silver(bool(p.get("full_refresh"))), ("ingest",)),
        Task("quality", lambda p: lake.quality(), ("silver",)),
        Task("gold", lambda p: lake.gold(), ("quality",)),
        Task("record", lambda p: lake.record_run(begun, now()), ("gold",)),
        Task("maintain", lambda p: lake.maintain(), ("gold",)),
    ]

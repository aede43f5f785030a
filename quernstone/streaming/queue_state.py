"""The leased queue as keyed state: commands stream in, jobs change, leases end by timers.

A command (entity_kind, entity_id, command, id, at) is one of enqueue (the job starts over), claim (a waiting
job whose backoff is over, or whose lease has ended, is leased), fail (a claimed job has one more attempt
and waits, or is poison at the last), complete and retry (a poison job starts over). Commands of a
key come in order of ``at``, then ``id``, over all batches; what a job's status doesn't allow changes nothing. The state lies
in the stream's checkpoint, so a restart goes on where it stopped; a batch that is run again replaces its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .queue import BACKOFF, BACKOFF_MOST, KEY, POISON_AFTER

JOB = "id bigint, status string, attempts int, lease_until timestamp, backoff_until timestamp, version bigint"
OUT = f"entity_kind string, entity_id string, {JOB}"


def changed(job: tuple | None, command: str, number: int, at: datetime, lease_seconds: int) -> tuple | None:
    """The job after a command; the same one if it isn't allowed."""
    if command == "enqueue":
        return number, "pending", 0, None, None
    if job is None:
        return None
    key, status, attempts, lease, backoff = job
    free = (status == "pending" and (backoff is None or backoff <= at)) or (status == "claimed" and lease <= at)
    if command == "claim" and free:
        return key, "claimed", attempts, at + timedelta(seconds=lease_seconds), None
    if command == "fail" and status == "claimed":
        attempts += 1
        if attempts >= POISON_AFTER:
            return key, "poison", attempts, None, None
        return key, "pending", attempts, None, at + timedelta(seconds=min(BACKOFF_MOST, BACKOFF * 2 ** (attempts - 1)))
    if command == "complete" and status == "claimed":
        return key, "done", attempts, None, None
    if command == "retry" and status == "poison":
        return key, "pending", 0, None, None
    return job


class Jobs(StatefulProcessor):
    """One job a key, with a timer at the end of its lease."""

    def __init__(self, lease_seconds: int):
        self.lease_seconds = lease_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB)

    def _row(self, key: tuple, job: tuple, version: int):
        import pandas as pd

        self.job.update((*job, version))
        names = ["entity_kind", "entity_id", "id", "status", "attempts", "lease_until", "backoff_until", "version"]
        return pd.DataFrame([(*key, *job, version)], columns=names).astype({"lease_until": "datetime64[us]", "backoff_until": "datetime64[us]", "attempts": "int32"})

    def _timers(self, lease: datetime | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if lease is not None:
            self.handle.registerTimer(int((lease - datetime(1970, 1, 1)).total_seconds() * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        held = self.job.get() if self.job.exists() else None
        job, version = (tuple(held[:5]), held[5]) if held else (None, 0)
        commands = sorted((at.to_pydatetime(), number, command) for batch in rows for at, number, command in zip(batch["at"], batch["id"].tolist(), batch["command"], strict=True))
        before = job
        for at, number, command in commands:
            job = changed(job, command, number, at, self.lease_seconds)
        if job is not None and job != before:
            self._timers(job[3])
            yield self._row(key, job, version + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        held = self.job.get() if self.job.exists() else None
        if held and held[1] == "claimed":
            yield self._row(key, (held[0], "pending", held[2], None, held[4]), held[5] + 1)

    def close(self) -> None:
        pass


def job_states(commands: DataFrame, lease_seconds: int = 60, late: str = "1 hour") -> DataFrame:
    """The stream of jobs as they change, with a rising ``version`` a key. ``at`` is a timestamp in UTC.

    Timers need the RocksDB state store, to which the session's streams are set.
    """
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = commands.select(*KEY, "command", "id", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return timed.groupBy(*KEY).transformWithStateInPandas(statefulProcessor=Jobs(lease_seconds), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def run_jobs(states: DataFrame, folder: str):
    """Run what there is to its end; each batch's rows are a folder that a repetition replaces."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/jobs/batch={number}")

    return states.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def current_jobs(spark: SparkSession, folder: str, as_of: Column | None = None) -> DataFrame:
    """The last state of each job; with ``as_of``, leases that have ended by then are free."""
    rows = spark.read.schema(OUT).parquet(f"{folder}/jobs/batch=*")
    names = [c.split()[0] for c in JOB.split(", ")]
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct(*names), "version").alias("j")).select(*KEY, "j.*")
    if as_of is None:
        return last
    over = (F.col("status") == "claimed") & (F.col("lease_until") <= as_of)
    return last.withColumn("status", F.when(over, "pending").otherwise(F.col("status"))).withColumn("lease_until", F.when(~over, F.col("lease_until")))

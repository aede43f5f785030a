"""The leased queue as transforms of its table, each at an explicit time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Attempts after which a job is poison, backoff in seconds, days and hours kept.
POISON_AFTER, BACKOFF, BACKOFF_MOST = 5, 1, 60
DONE_HOURS, POISON_DAYS = 6, 7
KEY = ["entity_kind", "entity_id"]


def enqueued(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Queue after new jobs: the last of a key wins; one whose content is queued already, and not poison, is skipped."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("created_at").desc(), F.col("id").desc()))).where("_n = 1").drop("_n")
    held = jobs.where("content_hash IS NOT NULL AND status <> 'poison'").select(*KEY, "content_hash").distinct()
    changed = last.join(held, [*KEY, "content_hash"], "left_anti").select(*last.columns)
    reset = changed.withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0)).withColumn("lease_until", F.lit(None).cast("timestamp_ntz")).withColumn("backoff_until", F.lit(None).cast("timestamp_ntz"))
    return jobs.join(reset.select(*KEY), KEY, "left_anti").unionByName(reset, allowMissingColumns=True)


def claimable(as_of: Column) -> Column:
    waiting = (F.col("status") == "pending") & (F.col("backoff_until").isNull() | (F.col("backoff_until") <= as_of))
    return waiting | ((F.col("status") == "claimed") & (F.col("lease_until") <= as_of))


def claimed(jobs: DataFrame, as_of: Column, most: int, worker: str = "worker", lease_seconds: int = 60) -> DataFrame:
    """The oldest jobs that may be taken, leased to a worker; a bounded top-k."""
    taken = jobs.where(claimable(as_of)).orderBy("created_at", "id").limit(most)
    return taken.withColumn("status", F.lit("claimed")).withColumn("locked_by", F.lit(worker)).withColumn("lease_until", as_of + F.expr(f"INTERVAL {lease_seconds} SECONDS"))


def failed(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs after a failure: one more attempt; poison at the fifth, else a doubling wait."""
    n = F.col("attempts") + 1
    wait = F.least(F.lit(BACKOFF_MOST), BACKOFF * F.pow(F.lit(2.0), n - 1)).cast("int")
    dead = n >= POISON_AFTER
    later = F.when(~dead, F.timestamp_add("SECOND", wait, as_of))
    return jobs.withColumn("backoff_until", later.cast("timestamp_ntz")).withColumn("status", F.when(dead, "poison").otherwise("pending")).withColumn("attempts", n)


def reconciled(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Expired leases are free again."""
    lost = (F.col("status") == "claimed") & (F.col("lease_until") <= as_of)
    return jobs.withColumn("status", F.when(lost, "pending").otherwise(F.col("status"))).withColumn("lease_until", F.when(~lost, F.col("lease_until")))


def completed(jobs: DataFrame, done: DataFrame, as_of: Column) -> DataFrame:
    met = jobs.join(done.select("id").distinct().withColumn("_done", F.lit(True)), "id", "left")
    return met.withColumn("status", F.when(F.col("_done"), "done").otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("_done"), as_of).otherwise(F.col("updated_at"))).drop("_done")


def retried(jobs: DataFrame) -> DataFrame:
    """Poison jobs start over."""
    dead = F.col("status") == "poison"
    return jobs.withColumn("attempts", F.when(dead, 0).otherwise(F.col("attempts"))).withColumn("status", F.when(dead, "pending").otherwise(F.col("status")))


def purged(jobs: DataFrame, as_of: Column) -> DataFrame:
    old = ((F.col("status") == "done") & (F.col("updated_at") < as_of - F.expr(f"INTERVAL {DONE_HOURS} HOURS"))) | ((F.col("status") == "poison") & (F.col("updated_at") < as_of - F.expr(f"INTERVAL {POISON_DAYS} DAYS")))
    return jobs.where(~old)


def stale_vectors(entities: DataFrame, vectors: DataFrame, most: int | None = None) -> DataFrame:
    """Entities (id, updated_at) without a vector or with an older one, the oldest first."""
    v = vectors.select("id", F.col("updated_at").alias("_v"))
    found = entities.join(v, "id", "left").where("_v IS NULL OR _v < updated_at").drop("_v")
    return found if most is None else found.orderBy("updated_at", "id").limit(most)


def backfill(jobs: DataFrame, entities: DataFrame, vectors: DataFrame, gate: int = 500, most: int = 2000) -> DataFrame:
    """Stale entities to enqueue; none while the queue is deep."""
    depth = jobs.agg(F.count_if(F.col("status").isin("pending", "claimed")).alias("_depth"))
    return stale_vectors(entities, vectors, most).join(F.broadcast(depth)).where(F.col("_depth") < gate).drop("_depth")


def worker_step(jobs: DataFrame, entities: DataFrame, as_of: Column, apply, most: int = 32, worker: str = "worker") -> tuple[DataFrame, DataFrame]:
    """One round of the worker: claim, drop jobs whose entity is gone, apply, complete.

    ``apply`` maps the claimed jobs to the rows they produce, with the ``id`` of each job that
    succeeded. Returns the queue afterwards and those rows; jobs without a row have failed once more.
    """
    taken = claimed(jobs, as_of, most, worker)
    there = taken.join(entities.select(*KEY).distinct(), KEY, "left_semi")
    made = apply(there)
    gone = taken.join(there.select("id"), "id", "left_anti").select("id")
    good = made.select("id").distinct().unionByName(gone)
    lost = failed(taken.join(good, "id", "left_anti"), as_of)
    rest = jobs.join(taken.select("id"), "id", "left_anti")
    done = completed(taken.join(good, "id", "left_semi"), good, as_of)
    after = rest.unionByName(lost, allowMissingColumns=True).unionByName(done, allowMissingColumns=True)
    return after.select(*jobs.columns), made

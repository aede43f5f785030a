"""Windowed streams over the events (an extension), run over what there is and compared with a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import shared_root
from ..streaming import events as E
from ..streaming import queue_state
from .bindings import Tables
from .registry import query


def _folder(t: Tables) -> str:
    """A fresh place in the folder that driver and executors share."""
    return f"{shared_root(t.spark)}/quernstone/stream-{uuid.uuid4().hex}"


def _streamed(t: Tables, shape, names: str) -> DataFrame:
    """Run a stream to its end, each batch's complete result written; return the last."""
    folder = _folder(t)
    like = t.table("events")
    # the source reads folders: the table's file (or files) by a pattern
    stream = t.spark.readStream.schema(like.schema).parquet(f"{t.folder}/events.parquet*")
    done = shape(stream)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data")

    E.run_available(done, folder, keep, "complete").awaitTermination()
    return t.spark.read.schema(done.schema).parquet(f"{folder}/data").select(*names.split())


@query("extension: tumbling windows", "SELECT CAST(epoch(time_bucket(INTERVAL 6 HOURS, ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(t: Tables):
    return _streamed(t, lambda s: E.tumbling(s, "ts", "6 hours", "event_type"), "start_s event_type n total").withColumn("total", F.round("total", 4))


@query("extension: sliding windows", "SELECT CAST(epoch(time_bucket(INTERVAL 6 HOURS, ts)) AS BIGINT) - k * 21600 AS start_s, count(*) AS n FROM events, (VALUES (0), (1)) AS s(k) GROUP BY 1")
def stream_sliding(t: Tables):
    return _streamed(t, lambda s: E.sliding(s, "ts", "12 hours", "6 hours"), "start_s n")


@query(
    "extension: session windows",
    """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts))) AS BIGINT) + 21600 AS end_s, count(*) AS n FROM r GROUP BY user_id, run""",
)
def stream_session(t: Tables):
    return _streamed(t, lambda s: E.sessions(s, "ts", "6 hours", "user_id"), "user_id start_s end_s n")


_COMMAND_SQL = "CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'complete' ELSE 'retry' END"
#: A lease of two days: events of one user are hours apart.
LEASE_S = 172_800


@query(
    "ST1 ST2 ST3 ST4 ST5 the queue as keyed state: jobs after a stream of commands, leases ended by timers",
    f"""WITH RECURSIVE e AS (SELECT user_id, {_COMMAND_SQL} AS command, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS status, 0 AS attempts, CAST(NULL AS TIMESTAMP) AS lease, CAST(NULL AS TIMESTAMP) AS backoff FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, k, CASE WHEN command = 'enqueue' THEN event_id ELSE id END,
  CASE WHEN command = 'enqueue' OR (command = 'retry' AND status = 'poison') THEN 'pending' WHEN command = 'claim' AND free THEN 'claimed' WHEN command = 'fail' AND status = 'claimed' THEN CASE WHEN attempts >= 4 THEN 'poison' ELSE 'pending' END WHEN command = 'complete' AND status = 'claimed' THEN 'done' ELSE status END,
  CASE WHEN command = 'enqueue' OR (command = 'retry' AND status = 'poison') THEN 0 WHEN command = 'fail' AND status = 'claimed' THEN attempts + 1 ELSE attempts END,
  CASE WHEN command = 'claim' AND free THEN ts + INTERVAL {LEASE_S} SECONDS WHEN command = 'enqueue' OR (command IN ('fail', 'complete') AND status = 'claimed') THEN NULL ELSE lease END,
  CASE WHEN command = 'fail' AND status = 'claimed' THEN CASE WHEN attempts < 4 THEN ts + to_seconds(CAST(least(60, pow(2, attempts)) AS INTEGER)) END WHEN command IN ('enqueue', 'claim') AND (command = 'enqueue' OR free) OR (command = 'complete' AND status = 'claimed') OR (command = 'retry' AND status = 'poison') THEN NULL ELSE backoff END
  FROM (SELECT e.*, s.id, s.status, s.attempts, s.lease, s.backoff, coalesce((s.status = 'pending' AND (s.backoff IS NULL OR s.backoff <= e.ts)) OR (s.status = 'claimed' AND s.lease <= e.ts), false) AS free FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
SELECT CAST(user_id AS VARCHAR) AS entity_id, id, CASE WHEN status = 'claimed' AND lease <= TIMESTAMP '2024-02-01 00:00:00' THEN 'pending' ELSE status END AS status, attempts FROM s WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""",
)
def queue_stream(t: Tables):
    folder = _folder(t)
    command = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").otherwise("retry")
    stream = t.spark.readStream.schema(t.table("events").schema).parquet(f"{t.folder}/events.parquet*")
    commands = stream.select(F.lit("user").alias("entity_kind"), F.col("user_id").cast("string").alias("entity_id"), command.alias("command"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    queue_state.run_jobs(queue_state.job_states(commands, LEASE_S, "40 days"), folder).awaitTermination()
    return queue_state.current_jobs(t.spark, folder, F.lit("2024-02-01 00:00:00").cast("timestamp")).select("entity_id", "id", "status", "attempts")

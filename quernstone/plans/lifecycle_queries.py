"""Queries of state transitions and of the queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..sources import tables as S
from ..streaming import queue as Q
from .bindings import AS_OF_SQL, Tables
from .registry import query
from .retrieval_queries import stamp, stamp_sql

QUEUE_NOW = "TIMESTAMP '2024-02-20 00:00:00'"


def queue_now():
    return F.lit("2024-02-20 00:00:00").cast("timestamp_ntz")


_HIT = f"status = 'active' AND (last_used_at IS NULL OR last_used_at < {AS_OF_SQL} - INTERVAL 7 DAYS) AND NOT list_has_any(tags, ['Tag1'])"


@query("L1 decay, Q2 Q10", f"SELECT id, CAST(CASE WHEN {_HIT} THEN greatest(1, importance - 1) ELSE importance END AS INTEGER) AS importance, {_HIT} AS decayed, status FROM memories")
def decay(t: Tables):
    return L.decayed(t.memories, t.as_of, immune=["Tag1"]).select("id", "importance", "decayed", "status")


@query("L3 archive by score", f"SELECT id, CASE WHEN status = 'active' AND ((coalesce(last_used_at, created_at) < {AS_OF_SQL} - INTERVAL 20 DAYS AND importance < 3) OR (hit_count > 10 AND recall_count = 0)) THEN 'archived' ELSE status END AS status FROM memories")
def archive_low_score(t: Tables):
    return L.archived_low_score(t.memories, t.as_of, 20).select("id", "status")


@query("L2 archive expired", f"SELECT id, CASE WHEN status = 'active' AND expires_at <= {AS_OF_SQL} THEN 'archived' ELSE status END AS status FROM memories")
def archive_expired(t: Tables):
    return L.archived_expired(t.memories, t.as_of).select("id", "status")


_CHANGES_SQL = "c AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'completed' WHEN id % 3 = 1 THEN 'in_progress' ELSE status END AS new_status, CASE WHEN id % 4 <> 0 THEN 'note' END AS comment FROM tasks)"
_PROBLEM_SQL = """chk AS (SELECT c.id, t.status, new_status, CASE WHEN t.status = new_status THEN NULL WHEN coalesce(trim(comment), '') = '' THEN 'comment required' WHEN new_status = 'completed' AND t.status IN ('backlog', 'pending', 'blocked') THEN t.status || ' to completed'
 WHEN new_status = 'completed' AND EXISTS (SELECT 1 FROM tasks k WHERE k.parent_id = t.id AND k.status NOT IN ('completed', 'canceled')) THEN 'open children' END AS problem FROM c JOIN tasks t ON c.id = t.id)"""


def _changes(t: Tables):
    status = F.when(F.col("id") % 3 == 0, "completed").when(F.col("id") % 3 == 1, "in_progress").otherwise(F.col("status"))
    return t.tasks.select("id", status.alias("new_status"), F.when(F.col("id") % 4 != 0, "note").alias("comment"))


@query("L7 transition check", f"WITH {_CHANGES_SQL}, {_PROBLEM_SQL} SELECT id, status, new_status, problem FROM chk")
def transition_check(t: Tables):
    return L.checked_transitions(t.tasks, _changes(t)).select("id", "status", "new_status", "problem")


@query(
    "L8 side effects",
    f"""WITH {_CHANGES_SQL}, {_PROBLEM_SQL}, g AS (SELECT id, new_status FROM chk WHERE problem IS NULL) SELECT t.id, coalesce(new_status, status) AS status, {stamp_sql("CASE WHEN new_status = 'completed' AND status <> new_status THEN TIMESTAMP '2024-03-01 00:00:00' ELSE finished_at END")} AS finished FROM tasks t LEFT JOIN g USING (id)""",
)
def transition_effects(t: Tables):
    return L.moved(t.tasks, _changes(t), t.as_of).select("id", "status", stamp("finished_at").alias("finished"))


@query("L8 release of claims, X7", f"SELECT id, task_id, {stamp_sql('CASE WHEN released_at IS NULL AND task_id IN (SELECT id FROM tasks WHERE priority >= 4) THEN ' + AS_OF_SQL + ' ELSE released_at END')} AS released FROM claims")
def claims_release(t: Tables):
    done = t.tasks.where("priority >= 4").select(F.col("id").alias("task_id"))
    return L.released(t.claims, done, t.as_of).select("id", "task_id", stamp("released_at").alias("released"))


@query("L9 L13 archive of tasks", "SELECT id, 'Completed Task: ' || title AS title, 'Task: ' || task_code || ' ' || title || chr(10) || 'Phase: ' || phase || chr(10) || description AS content, least(5, priority + 1) AS importance FROM tasks WHERE status = 'completed'")
def task_archive(t: Tables):
    return L.task_archive(t.tasks).select("id", "title", "content", "importance")


@query(
    "L12 pending overflow",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY repo, status ORDER BY created_at, id) AS k FROM tasks), h AS (SELECT repo, count(*) AS held FROM tasks WHERE priority = 1 AND status = 'pending' GROUP BY repo) SELECT id, CASE WHEN status = 'pending' AND k + coalesce(held, 0) > 10 THEN 'backlog' ELSE status END AS status FROM n LEFT JOIN h USING (repo)""",
)
def pending_overflow(t: Tables):
    return L.overflow(t.tasks, t.tasks.where("priority = 1")).select("id", "status")


@query("A18 repeated codes", "SELECT id, CASE WHEN row_number() OVER (PARTITION BY repo, 'C' || priority ORDER BY id) > 1 THEN 'C' || priority || '-' || row_number() OVER (PARTITION BY repo, 'C' || priority ORDER BY id) ELSE 'C' || priority END AS code FROM tasks")
def dedupe_codes(t: Tables):
    df = t.tasks.select("id", "repo", F.concat(F.lit("C"), F.col("priority").cast("string")).alias("code"))
    return L.unique_codes(df, "code", ["repo"], ["id"]).select("id", "code")


@query("A20 next codes", "WITH e AS (SELECT repo, max(CAST(substr(code, 5) AS BIGINT)) AS last FROM memories WHERE branch = 'main' GROUP BY repo), n AS (SELECT id, repo, row_number() OVER (PARTITION BY repo ORDER BY id) AS k FROM memories WHERE branch = 'dev') SELECT id, 'MEM-' || CASE WHEN length(CAST(coalesce(last, 0) + k AS VARCHAR)) >= 3 THEN CAST(coalesce(last, 0) + k AS VARCHAR) ELSE lpad(CAST(coalesce(last, 0) + k AS VARCHAR), 3, '0') END AS code FROM n LEFT JOIN e USING (repo)")
def next_codes(t: Tables):
    return L.next_codes(t.memories.where("branch = 'main'"), t.memories.where("branch = 'dev'").select("id", "repo"), "MEM", ["repo"], ["id"]).select("id", "code")


@query(
    "S13 upsert, last write wins",
    f"SELECT action, user_id, id, {stamp_sql('created_at')} AS created FROM actions QUALIFY row_number() OVER (PARTITION BY action, user_id ORDER BY created_at DESC, value > 50) = 1",
)
def upsert_lww(t: Tables):
    base, new = t.actions.where("value > 50"), t.actions.where("NOT value > 50")
    return S.upserted(base, new, ["action", "user_id"], "created_at").select("action", "user_id", "id", stamp("created_at").alias("created"))


@query("S15 bulk insert without known codes", "SELECT id, code FROM memories WHERE type <> 'decision'")
def bulk_insert(t: Tables):
    return S.inserted(t.memories.where("type = 'decision'"), t.memories, ["code"], ["id"]).select("id", "code")


@query("S16 X2 bulk update", "SELECT id, CAST(CASE WHEN type = 'pattern' THEN 5 ELSE importance END AS INTEGER) AS importance, title FROM memories")
def bulk_update(t: Tables):
    changes = t.memories.where("type = 'pattern'").select("id", F.lit(5).alias("importance"), F.lit("ignored").alias("title"))
    return S.updated(t.memories, changes, "id", ["importance"]).select("id", "importance", "title")


@query("S17 L10 purge and detach", "SELECT id, CASE WHEN parent_id IN (SELECT id FROM tasks WHERE status = 'canceled') THEN NULL ELSE parent_id END AS parent_id FROM tasks WHERE status <> 'canceled'")
def purge_detach(t: Tables):
    return L.detached(t.tasks, t.tasks.where("status = 'canceled'")).select("id", "parent_id")


@query("L11 supersede and hits", f"SELECT id, CAST(hit_count + CASE WHEN language = 'es' THEN 2 WHEN language = 'fr' THEN 1 ELSE 0 END AS INTEGER) AS hit_count, {stamp_sql('CASE WHEN language IN (\'es\', \'fr\') THEN ' + AS_OF_SQL + ' ELSE last_used_at END')} AS used, CASE WHEN id % 9 = 0 AND id + 1 IN (SELECT id FROM memories) THEN 'archived' ELSE status END AS status FROM memories")
def supersede_and_hits(t: Tables):
    shown = t.memories.where("language IN ('es', 'fr')").select("id").unionByName(t.memories.where("language = 'es'").select("id"))
    marked = t.memories.withColumn("supersedes", F.when((F.col("id") - 1) % 9 == 0, F.col("id") - 1))
    return L.superseded(L.counted_hits(marked, shown, t.as_of)).select("id", "hit_count", stamp("last_used_at").alias("used"), "status")


@query("L14 summaries", "SELECT owner, repo, '- ' || array_to_string(list(title ORDER BY id), chr(10) || '- ') AS summary FROM memories WHERE importance = 5 GROUP BY owner, repo")
def summary_signals(t: Tables):
    return L.summaries(t.memories.where("importance = 5").select("owner", "repo", F.col("id").alias("pos"), F.col("title").alias("signal")))


_READY = f"((status = 'pending' AND (backoff_until IS NULL OR backoff_until <= {QUEUE_NOW})) OR (status = 'claimed' AND lease_until <= {QUEUE_NOW}))"


@query("ST2 claim", f"SELECT id, 'claimed' AS status, {stamp_sql(QUEUE_NOW + ' + INTERVAL 60 SECONDS')} AS lease FROM jobs WHERE {_READY} ORDER BY created_at, id LIMIT 32")
def queue_claim(t: Tables):
    return Q.claimed(t.jobs, queue_now(), 32).select("id", "status", stamp("lease_until").alias("lease"))


@query("ST3 retry", f"SELECT id, CASE WHEN attempts + 1 >= 5 THEN 'poison' ELSE 'pending' END AS status, attempts + 1 AS attempts, {stamp_sql('CASE WHEN attempts + 1 < 5 THEN ' + QUEUE_NOW + ' + to_seconds(CAST(least(60, pow(2, attempts)) AS INTEGER)) END')} AS backoff FROM jobs WHERE status = 'claimed'")
def queue_retry(t: Tables):
    return Q.failed(t.jobs.where("status = 'claimed'"), queue_now()).select("id", "status", "attempts", stamp("backoff_until").alias("backoff"))


@query("ST4 leases and purge", f"SELECT id, CASE WHEN status = 'claimed' AND lease_until <= {QUEUE_NOW} THEN 'pending' ELSE status END AS status FROM jobs WHERE NOT ((status = 'done' AND updated_at < {QUEUE_NOW} - INTERVAL 6 HOURS) OR (status = 'poison' AND updated_at < {QUEUE_NOW} - INTERVAL 7 DAYS))")
def queue_maintenance(t: Tables):
    return Q.purged(Q.reconciled(t.jobs, queue_now()), queue_now()).select("id", "status")


@query("A21 queue counts", "SELECT status, count(*) AS n FROM jobs GROUP BY status")
def queue_counts(t: Tables):
    return t.jobs.groupBy("status").agg(F.count("*").alias("n"))


@query(
    "ST1 enqueue, last write wins with content hashes",
    """WITH b AS (SELECT * FROM jobs WHERE status <> 'pending' QUALIFY row_number() OVER (PARTITION BY entity_kind, entity_id ORDER BY id) = 1), n AS (SELECT * FROM jobs WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY entity_kind, entity_id ORDER BY created_at DESC, id DESC) = 1),
c AS (SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.entity_kind = n.entity_kind AND b.entity_id = n.entity_id AND b.content_hash = n.content_hash AND b.status <> 'poison'))
SELECT entity_kind, entity_id, id, 'pending' AS status, CAST(0 AS INTEGER) AS attempts FROM c UNION ALL SELECT entity_kind, entity_id, id, status, attempts FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.entity_kind = b.entity_kind AND c.entity_id = b.entity_id)""",
)
def queue_enqueue(t: Tables):
    base = t.jobs.where("status <> 'pending'")
    first = base.groupBy(*Q.KEY).agg(F.min("id").alias("id"))
    base = base.join(first, [*Q.KEY, "id"], "left_semi")
    return Q.enqueued(base, t.jobs.where("status = 'pending'")).select("entity_kind", "entity_id", "id", "status", "attempts")


@query("J6 ST6 stale vectors", "SELECT m.id FROM memories m LEFT JOIN vectors v ON m.id = v.id WHERE m.status = 'active' AND (v.id IS NULL OR v.updated_at < m.updated_at)")
def stale_vectors(t: Tables):
    return Q.stale_vectors(t.memories.where("status = 'active'").select("id", "updated_at"), t.vectors).select("id")


@query("ST6 backfill gate", "SELECT m.id FROM memories m LEFT JOIN vectors v ON m.id = v.id WHERE (v.id IS NULL OR v.updated_at < m.updated_at) AND (SELECT count(*) FROM jobs WHERE status IN ('pending', 'claimed')) < 1000000 ORDER BY m.updated_at, m.id LIMIT 100")
def queue_backfill(t: Tables):
    return Q.backfill(t.jobs, t.memories.select("id", "updated_at"), t.vectors, 1_000_000, 100).select("id")


@query("S19 audit counts", "SELECT event_id, CAST(coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 3 = 1 THEN 2 END, 0) AS BIGINT) AS n FROM (SELECT event_id, CAST(event_id % 9 AS BIGINT) AS value FROM events)")
def audit_counts(t: Tables):
    k = F.col("event_id")
    body = F.when(k % 3 == 0, F.concat(F.lit('{"count":'), (k % 9).cast("string"), F.lit("}"))).when(k % 3 == 1, F.lit('{"results":[1,2]}')).otherwise(F.lit("{}"))
    return t.table("events").select(k, S.audited(body).alias("n"))

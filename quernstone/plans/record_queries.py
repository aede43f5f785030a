"""Queries of the life cycles of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documentation, text
from ..operators import code_index as C
from ..operators import lifecycle as L
from ..operators import records as R
from ..operators import retrieval
from ..sources import manifests
from ..sources import tables as S
from .analytics_queries import NOW_SQL, task_now
from .bindings import Tables
from .registry import query
from .retrieval_queries import BODY_SQL, FTS_SQL, STOP_SQL, bm25_sql, stamp, stamp_sql

_BOARD_SQL = "status = 'completed', CASE WHEN status = 'completed' THEN updated_at END DESC NULLS LAST, CASE WHEN status = 'completed' THEN NULL WHEN status = 'in_progress' THEN 0 WHEN status = 'pending' THEN 1 WHEN status = 'backlog' THEN 2 WHEN status = 'blocked' THEN 3 ELSE 4 END NULLS LAST, priority DESC NULLS LAST, created_at, id"


@query(
    "X1 full-text hits without a score, live rows by id",
    f"WITH t AS (SELECT id, {FTS_SQL.replace('{c}', BODY_SQL)} AS tokens FROM memories WHERE repo = 'src1' AND status = 'active') SELECT id FROM t WHERE len(list_filter(tokens, lambda x: starts_with(x, 'th'))) > 0 AND len(list_filter(tokens, lambda x: starts_with(x, 'an'))) > 0 ORDER BY id LIMIT 5",
)
def memory_hits(t: Tables):
    live = (F.col("repo") == "src1") & (F.col("status") == "active")
    return retrieval.bm25(t.memories, "th an", [], live, t.index("memories", "title", "content", "tags[]")).select("id").orderBy("id").limit(5)


@query(
    "X3 deletion of tasks: children detached, comments gone",
    """SELECT id, CASE WHEN parent_id % 9 = 0 THEN NULL ELSE parent_id END AS parent_id, (SELECT count(*) FROM claims WHERE task_id % 9 <> 0) AS comments FROM tasks WHERE id % 9 <> 0""",
)
def task_delete(t: Tables):
    comments = t.claims.select("id", "task_id")
    gone = t.tasks.where("id % 9 = 0").select("id").unionByName(comments.where("task_id % 9 = 0").select(F.col("task_id").alias("id")))
    lost = t.tasks.where("parent_id % 9 = 0").select(F.col("parent_id").alias("id"))
    tasks, left = R.deleted_tasks(t.tasks, comments, gone.unionByName(lost))
    return tasks.select("id", "parent_id").join(F.broadcast(left.agg(F.count("*").alias("comments"))))


@query("X3 codes that exist already", "SELECT task_code FROM tasks WHERE id % 50 = 0")
def task_code_duplicates(t: Tables):
    drafts = t.tasks.select(F.when(F.col("id") % 50 == 0, F.col("task_code")).otherwise(F.concat("task_code", F.lit("-new"))).alias("task_code"))
    return R.duplicates(t.tasks, drafts, ["task_code"])


@query("X4 task list by statuses and text", f"SELECT id, status FROM tasks WHERE repo = 'repo4' AND status IN ('pending', 'blocked', 'completed') AND (title ILIKE '%order 1%' OR description ILIKE '%order 1%') ORDER BY {_BOARD_SQL} LIMIT 30")
def task_list(t: Tables):
    return R.listed_tasks(t.tasks, "repo4", ["pending", "blocked", "completed"], "order 1").limit(30).select("id", "status")


@query("X5 comments of a repository, newest first", f"SELECT id, {stamp_sql('claimed_at')} AS created FROM claims WHERE repo = 'repo2' ORDER BY claimed_at DESC, id DESC LIMIT 25")
def comments_of_repo(t: Tables):
    return R.newest_comments(t.claims.withColumnRenamed("claimed_at", "created_at"), "repo2", 25).select("id", stamp("created_at").alias("created"))


@query(
    "X5 comments after new ones, changes and deletions",
    f"""SELECT id, task_id, CASE WHEN id % 7 = 1 THEN 'changed' ELSE agent END AS comment FROM claims WHERE id % 7 <> 2 UNION ALL SELECT -id, task_id, 'new by ' || agent FROM claims WHERE id % 7 = 3""",
)
def comments_changed(t: Tables):
    notes = t.claims.select("id", "task_id", F.col("agent").alias("comment"))
    new = notes.where("id % 7 = 3").select((-F.col("id")).alias("id"), "task_id", F.concat(F.lit("new by "), "comment").alias("comment"))
    changed = notes.where("id % 7 = 1").select("id", F.lit("changed").alias("comment")).distinct()
    return R.commented(notes, new, changed, notes.where("id % 7 = 2"))


@query("X6 handoffs expired with their tasks, counts by status", "SELECT CASE WHEN h.status = 'pending' AND t.id IS NOT NULL THEN 'expired' ELSE h.status END AS status, count(*) AS n FROM handoffs h LEFT JOIN (SELECT id FROM tasks WHERE status IN ('completed', 'canceled')) t ON t.id = h.task_id GROUP BY 1")
def handoffs_expire(t: Tables):
    done = t.tasks.where("status IN ('completed', 'canceled')")
    return R.expired_handoffs(t.handoffs, done).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "X7 claims after new ones",
    f"""WITH new AS (SELECT DISTINCT task_id FROM claims WHERE task_id % 4 = 0), old AS (SELECT task_id, CASE WHEN released_at IS NULL AND task_id IN (SELECT * FROM new) THEN {NOW_SQL} ELSE released_at END AS released_at FROM claims)
SELECT task_id, count(*) AS claims, count(*) FILTER (WHERE released_at IS NULL) AS active FROM (SELECT * FROM old UNION ALL SELECT task_id, NULL FROM new) GROUP BY task_id""",
)
def claims_taken(t: Tables):
    new = t.claims.where("task_id % 4 = 0").select("task_id").distinct().withColumn("agent", F.lit("agent1"))
    after = R.claimed(t.claims, new, task_now())
    return after.groupBy("task_id").agg(F.count("*").alias("claims"), F.count_if(F.col("released_at").isNull()).alias("active"))


_STANDARD_SQL = "title || ' ' || content"


@query(
    "X8 full-text search of standards by rank, and its count",
    f"WITH {bm25_sql('standards', _STANDARD_SQL, ['re', 'th'], 'TRUE')} SELECT id, round(bm25, 6) AS bm25, (SELECT count(*) FROM bm) AS total FROM bm ORDER BY round(bm25, 9), id LIMIT 20",
)
def standard_fulltext(t: Tables):
    found = retrieval.bm25(t.standards.select("id"), "re th", [], None, t.index("standards", "title", "content"))
    page = S.paged(found.withColumn("key", F.round("bm25", 9)), ["key", "id"], 0, 20)
    return page.select("id", F.round("bm25", 6).alias("bm25"), "total")


@query("X9 symbols after files and a repository are gone", "SELECT repo, count(*) AS n FROM symbols WHERE repo <> 'site2' AND NOT ends_with(file_path, '/f7.ts') GROUP BY repo")
def symbols_deleted(t: Tables):
    gone = t.symbols.where("repo = 'site2' OR file_path LIKE '%/f7.ts'").select("id")
    return L.purged(t.symbols, gone).groupBy("repo").agg(F.count("*").alias("n"))


@query("X10 references after a move, by file and kind", "SELECT repo, CASE WHEN caller_file LIKE 'p1/%' THEN 'moved/' || caller_file ELSE caller_file END AS caller_file, kind, count(*) AS n FROM refs GROUP BY ALL")
def references_moved(t: Tables):
    moves = t.refs.where("caller_file LIKE 'p1/%'").select(F.col("caller_file").alias("old_path"), F.concat(F.lit("moved/"), "caller_file").alias("new_path")).distinct()
    return S.renamed(t.refs, moves, ["caller_file"]).groupBy("repo", "caller_file", "kind").agg(F.count("*").alias("n"))


@query("X11 files by status of their index", "SELECT repo, count(*) FILTER (WHERE last_indexed_at >= TIMESTAMP '2024-01-05 00:00:00') AS indexed, count(*) FILTER (WHERE last_indexed_at < TIMESTAMP '2024-01-05 00:00:00') AS pending FROM files WHERE file_path LIKE 'p%' GROUP BY repo")
def files_by_status(t: Tables):
    done = F.col("last_indexed_at") >= F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    return t.files.where(F.col("file_path").startswith("p")).groupBy("repo").agg(F.count_if(done).alias("indexed"), F.count_if(~done).alias("pending"))


@query(
    "X12 deletion of entities with what hangs on them, in their repository",
    """WITH gone AS (SELECT repo, name FROM entities WHERE (type = 'supplier' AND name LIKE '%1') OR (repo = 'kg0' AND name LIKE 'nation%1')) SELECT 'entities' AS part, repo, count(*) AS n FROM entities WHERE (repo, name) NOT IN (SELECT * FROM gone) GROUP BY repo
UNION ALL SELECT 'relations', repo, count(*) FROM relations WHERE (repo, from_entity) NOT IN (SELECT * FROM gone) AND (repo, to_entity) NOT IN (SELECT * FROM gone) GROUP BY repo UNION ALL SELECT 'observations', repo, count(*) FROM observations WHERE (repo, entity_name) NOT IN (SELECT * FROM gone) GROUP BY repo""",
)
def kg_delete(t: Tables):
    gone = t.entities.where("(type = 'supplier' AND name LIKE '%1') OR (repo = 'kg0' AND name LIKE 'nation%1')")
    parts = zip(("entities", "relations", "observations"), R.without_entities(gone, t.entities, t.relations, t.observations), strict=True)
    counts = [df.groupBy("repo").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "repo", "n") for name, df in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("X12 creation of entities, none twice", "SELECT type, count(*) * 2 AS n FROM entities GROUP BY type")
def kg_create(t: Tables):
    new = t.entities.withColumn("name", F.concat("name", F.lit(" too")))
    return R.created(t.entities, new, ["repo", "name"]).groupBy("type").agg(F.count("*").alias("n"))


@query(
    "X13 batch of relations, rows failing alone",
    """WITH batch AS (SELECT id, repo, entity_name AS from_entity, CASE WHEN id % 5 = 0 THEN 'no one' ELSE 'nation NATION_' || (id % 25) END AS to_entity, CASE WHEN id % 11 = 0 THEN ' ' ELSE 'located_in' END AS relation_type FROM observations),
o AS (SELECT b.*, CASE WHEN trim(relation_type) = '' THEN 'invalid' WHEN (repo, from_entity) NOT IN (SELECT repo, name FROM entities) OR (repo, to_entity) NOT IN (SELECT repo, name FROM entities) THEN 'no entity' WHEN EXISTS (SELECT 1 FROM relations r WHERE r.repo = b.repo AND r.from_entity = b.from_entity AND r.to_entity = b.to_entity AND r.relation_type = b.relation_type) OR row_number() OVER (PARTITION BY repo, from_entity, to_entity, relation_type ORDER BY id) > 1 THEN 'ignored' ELSE 'saved' END AS outcome FROM batch b)
SELECT outcome, count(*) AS n, min(id) AS first FROM o GROUP BY outcome""",
)
def kg_batch(t: Tables):
    to = F.when(F.col("id") % 5 == 0, "no one").otherwise(F.concat(F.lit("nation NATION_"), (F.col("id") % 25).cast("string")))
    batch = t.observations.select("id", "repo", F.col("entity_name").alias("from_entity"), to.alias("to_entity"), F.when(F.col("id") % 11 == 0, " ").otherwise("located_in").alias("relation_type"))
    return R.saved_batch(t.entities, t.relations, batch).groupBy("outcome").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("X15 jobs for rows that have none", "SELECT entity_kind, entity_id, 'pending' AS status FROM (SELECT 'click' AS entity_kind, CAST(id AS VARCHAR) AS entity_id FROM memories) WHERE (entity_kind, entity_id) NOT IN (SELECT entity_kind, entity_id FROM jobs)")
def queue_enqueue_absent(t: Tables):
    return R.enqueued(t.jobs, t.memories, "click", t.as_of).select("entity_kind", "entity_id", "status")


@query("X16 standards after a bulk update and a deletion", "SELECT id, CASE WHEN id % 6 = 0 THEN '2.0' ELSE version END AS version, title FROM standards WHERE id % 10 <> 3")
def standards_bulk(t: Tables):
    changes = t.standards.where("id % 6 = 0").select("id", F.lit("2.0").alias("version"), F.lit("not allowed").alias("title"))
    return L.purged(S.updated(t.standards, changes, "id", ["version", "context"]), t.standards.where("id % 10 = 3").select("id")).select("id", "version", "title")


@query(
    "X17 mixed bulk of tasks: updates by id, new ones without, phase tags",
    f"""WITH after AS (SELECT id, task_code, CASE WHEN id % 8 = 0 THEN 'blocked' ELSE status END AS status, phase, id % 8 = 0 AS touched FROM tasks UNION ALL SELECT NULL, 'NEW-' || id, 'pending', 'Design', true FROM tasks WHERE id % 100 = 0)
SELECT task_code, status, touched, 'a,phase:' || lower(phase) AS tags FROM after""",
)
def task_bulk(t: Tables):
    tasks = t.tasks.select("id", "task_code", "status", "phase", "updated_at")
    changes = tasks.where("id % 8 = 0").select("id", F.lit(None).cast("string").alias("task_code"), F.lit("blocked").alias("status"), F.lit(None).cast("string").alias("phase"))
    new = tasks.where("id % 100 = 0").select(F.lit(None).cast("long").alias("id"), F.concat(F.lit("NEW-"), F.col("id").cast("string")).alias("task_code"), F.lit("pending").alias("status"), F.lit("Design").alias("phase"))
    at = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    after = R.mixed_bulk(tasks, changes.unionByName(new), ["status"], at)
    tagged = L.with_phase_tag(after.withColumn("tags", F.array(F.lit("a"), F.lit("Phase:old"))))
    return tagged.select("task_code", "status", (F.col("updated_at") == at).alias("touched"), F.array_join("tags", ",").alias("tags"))


@query(
    "X19 what an agent holds and is offered",
    """WITH c AS (SELECT task_id, agent FROM claims WHERE released_at IS NULL QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY claimed_at DESC, id DESC) = 1),
h AS (SELECT task_id, to_agent FROM handoffs WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, id DESC) = 1)
SELECT t.id AS task_id, t.task_code, coalesce(c.agent = 'agent3', false) AS held, coalesce(h.to_agent = 'agent3', false) AS offered FROM tasks t LEFT JOIN c ON c.task_id = t.id LEFT JOIN h ON h.task_id = t.id WHERE t.status NOT IN ('completed', 'canceled') AND (c.agent = 'agent3' OR h.to_agent = 'agent3')""",
)
def agent_work(t: Tables):
    return R.coordination(t.handoffs, t.claims, t.tasks, "agent3")


_LANG_SQL = "CASE WHEN {c} LIKE '%.ts' THEN 'typescript' WHEN {c} LIKE '%.py' THEN 'python' WHEN {c} LIKE '%.md' THEN 'markdown' ELSE 'html' END"


@query(
    "G10 A30 dead code by reliable languages, with entry points and caps",
    f"""WITH s AS (SELECT *, {_LANG_SQL.replace("{c}", "file_path")} AS lang FROM symbols), r AS (SELECT *, {_LANG_SQL.replace("{c}", "caller_file")} AS lang FROM refs),
reliable AS (SELECT DISTINCT repo, lang FROM r WHERE lang IN ('typescript', 'python')),
head AS (SELECT * FROM s WHERE parent_symbol_id IS NULL QUALIFY row_number() OVER (PARTITION BY repo ORDER BY file_path, start_line, id) <= 500),
named AS (SELECT repo, 'p' || (id % 7) || '/q' || (id % 3) || '/f' || (id % 50) || '.ts' AS file_path, CASE WHEN bool_or(id % 2 = 0) THEN 'bin' ELSE 'manifest' END AS kind FROM files GROUP BY ALL),
banged AS (SELECT DISTINCT repo, 'p' || (id % 7) || '/q' || (id % 3) || '/f' || (id % 50 + 1) || '.ts' AS file_path FROM files WHERE id % 5 = 0),
dead AS (SELECT h.*, CASE WHEN exported THEN 'public-api' WHEN n.kind IS NOT NULL THEN n.kind WHEN b.repo IS NOT NULL THEN 'shebang' END AS entry FROM head h LEFT JOIN named n ON n.repo = h.repo AND n.file_path = h.file_path LEFT JOIN banged b ON b.repo = h.repo AND b.file_path = h.file_path SEMI JOIN reliable l ON l.repo = h.repo AND l.lang = h.lang WHERE NOT EXISTS (SELECT 1 FROM refs f WHERE f.repo = h.repo AND f.symbol_name = h.name)),
totals AS (SELECT repo, count(*) AS scanned, count(*) FILTER (WHERE entry IS NULL) AS dead, count(*) FILTER (WHERE entry IS NOT NULL) AS excluded FROM dead GROUP BY repo),
scanned AS (SELECT repo, count(*) AS n FROM head GROUP BY repo)
SELECT d.repo, name, file_path, entry, t.scanned, t.dead, t.excluded, c.n >= 500 OR t.scanned > 20 AS truncated FROM dead d JOIN totals t ON t.repo = d.repo JOIN scanned c ON c.repo = d.repo
QUALIFY row_number() OVER (PARTITION BY d.repo ORDER BY entry IS NOT NULL, file_path, start_line, id) <= 20""",
)
def dead_code_report(t: Tables):
    path = lambda n: F.concat(F.lit("p"), (F.col("id") % 7).cast("string"), F.lit("/q"), (F.col("id") % 3).cast("string"), F.lit("/f"), n.cast("string"), F.lit(".ts"))
    member = F.when(F.col("id") % 2 == 0, '"bin": {"x": "./').otherwise('"main": "')
    close = F.when(F.col("id") % 2 == 0, '"}').otherwise('"')
    packages = t.files.select("repo", F.lit("package.json").alias("file_path"), F.concat(F.lit("{"), member, path(F.col("id") % 50), close, F.lit("}")).alias("content"))
    scripts = t.files.where("id % 5 = 0").select("repo", path(F.col("id") % 50 + 1).alias("file_path"), F.concat(F.lit("#!/usr/bin/env node\n"), "content").alias("content")).dropDuplicates(["repo", "file_path"])
    found = C.dead_code_report(t.symbols, t.refs, manifests.manifest_entries(packages), scripts)
    return found.select("repo", "name", "file_path", "entry", "scanned", "dead", "excluded", "truncated")


@query(
    "F3 F38 L13 X25 texts of records",
    rf"""WITH m AS (SELECT id, content, title, repo, CASE id % 4 WHEN 0 THEN '[agent:x] ' || repo WHEN 1 THEN '[on 2024-01-02]' WHEN 2 THEN '[x] agent:' ELSE repo END AS mark FROM memories)
SELECT id, CAST(len(list_filter(string_split_regex(trim(regexp_replace(lower(content), '[^\w\s\x{{00C0}}-\x{{017F}}]', ' ', 'g')), '\s+'), lambda t: length(t) > 2 AND NOT list_contains({STOP_SQL}, t))) AS INTEGER) AS stubs, id % 4 IN (0, 1) AS metadata,
  'Decision: ' || title || CASE WHEN id % 2 = 0 THEN chr(10) || chr(10) || 'Session: ' || repo ELSE '' END AS structured, CASE WHEN length(content || '; ' || repo) > 300 THEN substr(content || '; ' || repo, 1, 300) || '...' ELSE content || '; ' || repo END AS steps FROM m""",
)
def record_texts(t: Tables):
    n = F.col("id") % 4
    mark = F.when(n == 0, F.concat(F.lit("[agent:x] "), "repo")).when(n == 1, "[on 2024-01-02]").when(n == 2, "[x] agent:").otherwise(F.col("repo"))
    structured = L.structured_content(decision=F.col("title"), session=F.when(F.col("id") % 2 == 0, F.col("repo")))
    return t.memories.select("id", F.size(text.stub_tokens(F.col("content"))).alias("stubs"), text.metadata_title(mark).alias("metadata"), structured.alias("structured"), documentation.next_steps(F.array("content", "repo")).alias("steps"))


@query(
    "X21 entry points of manifests",
    """WITH r AS (SELECT DISTINCT repo FROM memories) SELECT repo, 'src/' || repo || '.js' AS file_path, 'manifest' AS kind FROM r UNION ALL SELECT repo, 'cli.js', 'bin' FROM r UNION ALL SELECT repo, 'lib/' || repo || '.mjs', 'manifest' FROM r""",
)
def manifest_entry_points(t: Tables):
    name = F.col("repo")
    body = F.concat(F.lit('{"main": "./src/'), name, F.lit('.js", "bin": {"a": "./cli.js", "b": "/src/'), name, F.lit('.js"}, "exports": {".": {"import": "./lib/'), name, F.lit('.mjs", "types": null}}}'))
    files = t.memories.select("repo").distinct().select("repo", F.lit("package.json").alias("file_path"), body.alias("content"))
    return manifests.manifest_entries(files)


@query("P16 columns that answers leave out", "SELECT id, code, title, importance FROM memories WHERE repo = 'src2'")
def memory_public(t: Tables):
    own = retrieval.scoped(t.memories, "src2").select("id", "code", "title", "importance", "hit_count", "recall_count", "last_used_at", "expires_at")
    return S.public(own)

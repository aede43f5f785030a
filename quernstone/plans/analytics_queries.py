"""Queries of task, claim, activity and repository analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import analytics as A
from ..operators import retrieval as R
from .bindings import Tables
from .registry import query
from .retrieval_queries import VECTOR, VECTOR_SQL, stamp, stamp_sql

#: Tasks date from 1995 to 2001, so their "now" lies there.
TASK_NOW = "2001-06-15 12:00:00"
NOW_SQL = f"TIMESTAMP '{TASK_NOW}'"


def task_now():
    return F.lit(TASK_NOW).cast("timestamp_ntz")


@query(
    "T3 board order, P8 statuses, J3 self joins",
    f"""WITH board AS (SELECT t.id, t.task_code, t.status, d.task_code AS depends_on_code, p.task_code AS parent_code,
  row_number() OVER (ORDER BY t.status = 'completed', CASE WHEN t.status = 'completed' THEN t.updated_at END DESC NULLS LAST, CASE WHEN t.status = 'completed' THEN NULL WHEN t.status = 'in_progress' THEN 0 WHEN t.status = 'pending' THEN 1 WHEN t.status = 'backlog' THEN 2 WHEN t.status = 'blocked' THEN 3 ELSE 4 END NULLS LAST, t.priority DESC NULLS LAST, t.created_at, t.id) AS rank
FROM tasks t LEFT JOIN tasks d ON t.depends_on = d.id LEFT JOIN tasks p ON t.parent_id = p.id WHERE t.repo = 'repo3' AND t.status <> 'canceled') SELECT id, task_code, status, depends_on_code, parent_code, CAST(rank AS INTEGER) AS rank FROM board WHERE rank <= 50""",
)
def task_board(t: Tables):
    from pyspark.sql.window import Window

    tasks = t.tasks
    own = tasks.where("repo = 'repo3' AND status <> 'canceled'").orderBy(*A.board_order()).limit(50)
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*A.board_order())))
    code = lambda key, name: tasks.select(F.col("id").alias(key), F.col("task_code").alias(name))
    met = own.join(code("depends_on", "depends_on_code"), "depends_on", "left").join(code("parent_id", "parent_code"), "parent_id", "left")
    return met.select("id", "task_code", "status", "depends_on_code", "parent_code", "rank")


@query("A3 status pivot", "SELECT repo, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in A.STATUSES) + " FROM tasks GROUP BY repo")
def task_status_pivot(t: Tables):
    return A.status_pivot(t.tasks, "repo")


def _period_sql(name: str, since: str | None) -> str:
    ended = "status = 'completed'" + (f" AND finished_at >= {since}" if since else "")
    added = f"created_at >= {since}" if since else "TRUE"
    return f"""SELECT '{name}' AS period, count(*) FILTER (WHERE {ended}) AS completed, CAST(coalesce(sum(est_tokens) FILTER (WHERE {ended}), 0) AS BIGINT) AS tokens,
  round(avg((epoch_us(finished_at) - epoch_us(in_progress_at)) / 60e6) FILTER (WHERE {ended} AND in_progress_at IS NOT NULL), 6) AS avg_minutes, count(*) FILTER (WHERE {added}) AS added FROM tasks"""


@query(
    "A4 time stats, F25, Q12",
    " UNION ALL ".join([_period_sql("overall", None), _period_sql("daily", f"date_trunc('day', {NOW_SQL})"), _period_sql("weekly", f"{NOW_SQL} - INTERVAL 7 DAYS"), _period_sql("monthly", f"{NOW_SQL} - INTERVAL 30 DAYS")]),
)
def task_time_stats(t: Tables):
    return A.task_time_stats(t.tasks, task_now()).withColumn("avg_minutes", F.round("avg_minutes", 6))


_LABEL_SQL = {
    "daily": "strftime({c}, '%H:00')",
    "weekly": "strftime({c}, '%Y-%m-%d')",
    "monthly": "'W' || strftime({c}, '%W')",
    "overall": "strftime({c}, '%Y-%m')",
}


def _series(period: str, since: str | None):
    def one(column: str, created: int) -> str:
        return f"SELECT {_LABEL_SQL[period].replace('{c}', column)} AS label, {created} AS created, {1 - created} AS completed FROM tasks WHERE {column} IS NOT NULL" + (f" AND {column} >= TIMESTAMP '{since}'" if since else "")

    sql = f"SELECT label, CAST(sum(created) AS BIGINT) AS created, CAST(sum(completed) AS BIGINT) AS completed FROM ({one('created_at', 1)} UNION ALL {one('finished_at', 0)}) GROUP BY label ORDER BY label LIMIT 100"

    def run(t: Tables):
        return A.task_series(t.tasks, period, F.lit(since).cast("timestamp_ntz") if since else None)

    run.__name__ = f"task_series_{period}"
    query("A5 created against completed, F24, Q11, Q12", sql)(run)


_series("daily", "2001-06-01 00:00:00")
_series("weekly", "2001-06-09 12:00:00")
_series("monthly", "2001-01-01 00:00:00")
_series("overall", None)


@query(
    "W2 latest active claim, J18 instead of correlated subqueries",
    f"""SELECT task_id, agent, {stamp_sql("claimed_at")} AS claimed FROM claims WHERE released_at IS NULL QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY claimed_at DESC, id DESC) = 1""",
)
def task_latest_claim(t: Tables):
    return A.active_claims(t.claims).select("task_id", "agent", stamp("claimed_at").alias("claimed"))


@query("W3 latest pending handoff", f"SELECT task_id, to_agent, {stamp_sql('created_at')} AS created FROM handoffs WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, id DESC) = 1")
def task_latest_handoff(t: Tables):
    return A.latest(t.handoffs.where("status = 'pending'"), "task_id", "created_at", ["to_agent", "created_at"]).select("task_id", "to_agent", stamp("created_at").alias("created"))


@query("J19 children", "SELECT parent_id, array_to_string(list(task_code ORDER BY created_at, id), ',') AS children FROM tasks WHERE parent_id IS NOT NULL GROUP BY parent_id")
def task_children(t: Tables):
    return A.children(t.tasks).select("parent_id", F.array_join("children", ",").alias("children"))


@query("J20 comments, newest first", "SELECT l_orderkey AS task_id, array_to_string(list(l_shipmode_ ORDER BY l_shipdate DESC, l_shipmode_), ',') AS comments FROM (SELECT l_orderkey, l_shipdate, l_returnflag || l_linenumber AS l_shipmode_ FROM lineitem) GROUP BY l_orderkey")
def task_comments(t: Tables):
    rows = t.table("lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_shipdate").alias("created_at"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("comment"))
    lists = rows.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("k"), "comment"))).alias("c"))
    return lists.select("task_id", F.array_join(F.transform("c", lambda x: x["comment"]), ",").alias("comments"))


@query(
    "R8 task search, P12 filters after ranking, F16, Q28",
    f"""WITH pool AS (SELECT *, CASE WHEN created_at >= {NOW_SQL} THEN 1.0 ELSE pow(2.0, -(epoch_us({NOW_SQL}) - epoch_us(created_at)) / 86400000000.0 / 30.0) END AS recency,
  least(1.0, (CAST(list_contains(words, 'customer') AS INT) + CAST(list_contains(words, '42') AS INT)) / 2.0) AS domain
  FROM (SELECT *, list_filter(string_split_regex(lower(title || ' ' || description || ' ' || task_code || ' ' || phase), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM tasks WHERE title ILIKE '%customer 42%' OR description ILIKE '%customer 42%' OR task_code ILIKE '%customer 42%')),
scored AS (SELECT *, 0.3 * 1.0 + 0.15 * recency + 0.15 * domain AS score, count(*) OVER () AS eligible FROM pool), ranked AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS place FROM scored),
kept AS (SELECT *, row_number() OVER (ORDER BY place) AS rank FROM ranked WHERE (score >= CASE WHEN eligible <= 5 THEN 0.08 ELSE 0.2 END OR place = 1) AND lower(phase) = 'build')
SELECT id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM kept WHERE rank <= 10""",
)
def task_search(t: Tables):
    from ..functions import scoring

    tasks = t.tasks.where(R.substring("customer 42", "title", "description", "task_code"))
    words = text.word_tokens(F.concat_ws(" ", "title", "description", "task_code", "phase"), 1)
    domain = scoring.coverage(words, text.strings(["customer", "42"]))
    pool = tasks.select("id", "phase", F.lit(0.0).alias("similarity"), F.lit(1.0).alias("keyword"), scoring.recency(F.col("created_at"), task_now(), "task").alias("recency"), domain.alias("domain"))
    return R.hybrid(pool, "task", limit=10, post=F.lower("phase") == "build").select("id", F.round("score", 4).alias("score"), "rank")


@query(
    "R8 J17 P12 task search: text and vectors, top-up, filters afterwards",
    f"""WITH near AS (SELECT id, list_cosine_similarity(CAST(vector AS DOUBLE[]), {VECTOR_SQL}) AS s FROM vectors WHERE id IN (SELECT id FROM tasks) ORDER BY round(s, 9) DESC, id LIMIT 60),
pool AS (SELECT t.*, coalesce(n.s, 0.0) AS similarity, CASE WHEN title ILIKE '%customer 4%' OR description ILIKE '%customer 4%' OR task_code ILIKE '%customer 4%' THEN 1.0 ELSE 0.0 END AS keyword,
  CASE WHEN created_at >= {NOW_SQL} THEN 1.0 ELSE pow(2.0, -(epoch_us({NOW_SQL}) - epoch_us(created_at)) / 86400000000.0 / 30.0) END AS recency, list_filter(string_split_regex(lower(title || ' ' || description || ' ' || task_code || ' ' || phase), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM tasks t LEFT JOIN near n ON n.id = t.id),
chosen AS (SELECT * FROM pool WHERE keyword > 0 OR id IN (SELECT id FROM near)),
scored AS (SELECT *, 0.4 * similarity + 0.3 * keyword + 0.15 * recency + 0.15 * least(1.0, (CAST(list_contains(words, 'customer') AS INT) + CAST(list_contains(words, '4') AS INT)) / 2.0) AS score, count(*) OVER () AS eligible FROM chosen),
marked AS (SELECT *, score >= CASE WHEN eligible <= 5 THEN 0.08 ELSE 0.2 END OR id = (SELECT id FROM scored ORDER BY round(score, 9) DESC, id LIMIT 1) AS passed FROM scored),
spare AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS k FROM marked WHERE NOT passed AND keyword > 0) WHERE k <= 20 - (SELECT count(*) FROM marked WHERE passed)),
found AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM marked WHERE (passed OR id IN (SELECT id FROM spare)) AND priority = 3 AND lower(phase) = 'test')
SELECT id, round(score, 6) AS score, eligible, CAST(rank AS INTEGER) AS rank FROM found WHERE rank > 2 AND rank <= 20""",
)
def task_search_vectors(t: Tables):
    post = (F.col("priority") == 3) & (F.lower("phase") == "test")
    found = R.task_search(t.tasks, t.vectors, "customer 4", VECTOR, task_now(), 2, 18, post)
    return found.select("id", F.round("score", 6).alias("score"), "eligible", "rank")


@query("F26 issue references, linked and textual", "SELECT id, contains(title || ' ' || description, '#' || CAST(7 AS VARCHAR) || ']') AS linked FROM tasks WHERE regexp_matches(title || ' ' || description, '#7\\b') OR regexp_matches(lower(title || ' ' || description), '\\bissue 7\\b')".replace("\\\\", "\\"))
def task_issue_refs(t: Tables):
    from ..functions.querytext import issue_numbers

    (number,) = issue_numbers("what about issue 7?")
    body = F.concat_ws(" ", "title", "description")
    linked = F.array_contains(text.issue_refs(body), F.lit(number).cast("long"))
    textual = F.lower(body).rlike(rf"\bissue {number}\b")
    return t.tasks.where(linked | textual).select("id", linked.alias("linked"))


@query("J4 handoffs with task codes", "SELECT h.id, h.to_agent, t.task_code FROM handoffs h LEFT JOIN tasks t ON h.task_id = t.id WHERE h.status = 'pending' AND h.repo = 'repo2'")
def handoff_list(t: Tables):
    return t.handoffs.where("status = 'pending' AND repo = 'repo2'").join(t.tasks.select(F.col("id").alias("task_id"), "task_code"), "task_id", "left").select("id", "to_agent", "task_code")


@query("J4 W2 active claims", "SELECT c.id, c.agent, t.task_code, t.status FROM claims c LEFT JOIN tasks t ON c.task_id = t.id WHERE c.released_at IS NULL AND c.repo = 'repo5'")
def claims_active(t: Tables):
    return t.claims.where("released_at IS NULL AND repo = 'repo5'").join(t.tasks.select(F.col("id").alias("task_id"), "task_code", "status"), "task_id", "left").select("id", "agent", "task_code", "status")


@query(
    "A8 repository statistics",
    """SELECT repo, count(*) AS total, round(avg(importance), 1) AS avg_importance, CAST(sum(hit_count) AS BIGINT) AS hits, count(*) FILTER (WHERE expires_at BETWEEN TIMESTAMP '2024-03-01 00:00:00' AND TIMESTAMP '2024-03-08 00:00:00') AS expiring FROM memories GROUP BY repo""",
)
def repo_dashboard_stats(t: Tables):
    return A.dashboard_stats(t.memories, t.as_of, "repo")


@query(
    "A9 global statistics",
    """SELECT (SELECT count(*) FROM memories) AS memories, (SELECT count(*) FROM tasks) AS tasks, (SELECT count(DISTINCT agent) FROM claims WHERE released_at IS NULL) AS agents,
  (SELECT count(*) FROM claims WHERE released_at IS NULL AND claimed_at < TIMESTAMP '2001-06-14 12:00:00') AS stale, (SELECT count(*) FROM tasks t WHERE status = 'in_progress' AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.task_id = t.id AND c.released_at IS NULL)) AS unassigned""",
)
def global_stats(t: Tables):
    open_ = t.claims.where("released_at IS NULL")
    day = task_now() - F.expr("INTERVAL 1 DAY")
    parts = [
        t.memories.agg(F.count("*").alias("memories")),
        t.tasks.agg(F.count("*").alias("tasks")),
        open_.agg(F.countDistinct("agent").alias("agents"), F.count_if(F.col("claimed_at") < day).alias("stale")),
        t.tasks.where("status = 'in_progress'").join(open_.select(F.col("task_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("unassigned")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


@query(
    "A10 A11 repository navigation and pressure",
    f"""WITH r AS (SELECT repo FROM memories UNION SELECT repo FROM tasks UNION SELECT repo FROM claims WHERE released_at IS NULL UNION SELECT repo FROM handoffs WHERE status = 'pending'),
n AS (SELECT repo, (SELECT count(*) FROM memories m WHERE m.repo = r.repo) AS memories, (SELECT count(*) FROM tasks t WHERE t.repo = r.repo) AS tasks, (SELECT count(*) FROM tasks t WHERE t.repo = r.repo AND status = 'pending') AS pending,
  (SELECT count(*) FROM tasks t WHERE t.repo = r.repo AND status = 'in_progress') AS in_progress, (SELECT count(*) FROM tasks t WHERE t.repo = r.repo AND status = 'blocked') AS blocked, (SELECT count(*) FROM claims c WHERE c.repo = r.repo AND released_at IS NULL) AS claims,
  (SELECT count(*) FROM handoffs h WHERE h.repo = r.repo AND status = 'pending') AS handoffs, greatest((SELECT max(updated_at) FROM memories m WHERE m.repo = r.repo), (SELECT max(updated_at) FROM tasks t WHERE t.repo = r.repo)) AS changed FROM r)
SELECT repo, memories, tasks, pending, in_progress, blocked, claims, handoffs, {stamp_sql("changed")} AS changed, blocked * 5 + in_progress * 3 + pending * 2 + handoffs * 2 + claims AS pressure FROM n""",
)
def repo_navigation(t: Tables):
    return A.repo_navigation(t.memories, t.tasks, t.claims, t.handoffs).withColumn("changed", stamp("changed"))


@query(
    "W7 top tasks a repository and status",
    """SELECT repo, status, id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo, status ORDER BY priority DESC, created_at, id) AS place FROM tasks) WHERE place <= CASE status WHEN 'in_progress' THEN 10 WHEN 'pending' THEN 8 WHEN 'blocked' THEN 4 ELSE 0 END""",
)
def arena_overview(t: Tables):
    caps = {"in_progress": 10, "pending": 8, "blocked": 4}
    shown = t.tasks.where(F.col("status").isin(*caps))
    return A.top_per_group(shown, ["repo", "status"], [F.col("priority").desc(), "created_at", "id"], caps, "status").select("repo", "status", "id", "place")


@query("U1 repositories", "SELECT repo FROM memories UNION SELECT repo FROM tasks")
def repos_union(t: Tables):
    return t.memories.select("repo").union(t.tasks.select("repo")).distinct()


@query("A6 actions a day", "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM actions WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAYS GROUP BY 1")
def actions_by_date(t: Tables):
    since = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS")
    return t.actions.where(F.col("created_at") >= since).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("A7 distribution", "SELECT action, count(*) AS n FROM actions GROUP BY action")
def action_distribution(t: Tables):
    return A.counts(t.actions, "action")


@query(
    "A26 W5 bursts, Q24",
    f"""WITH m AS (SELECT *, CASE WHEN action = lag(action) OVER w AND query IS NOT DISTINCT FROM lag(query) OVER w AND memory_id = lag(memory_id) OVER w AND created_at - lag(created_at) OVER w <= INTERVAL 600 MINUTES THEN 0 ELSE 1 END AS fresh FROM actions WINDOW w AS (PARTITION BY repo ORDER BY created_at, id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY repo ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT repo, action, query, memory_id, min(id) AS id, {stamp_sql("max(created_at)")} AS created, count(*) AS burst FROM r GROUP BY repo, run, action, query, memory_id""",
)
def action_bursts(t: Tables):
    return A.bursts(t.actions, 600, ["repo"]).select("repo", "action", "query", "memory_id", "id", stamp("created_at").alias("created"), "burst")


@query("J5 actions with memories, ST7 tail", "SELECT a.id, a.action, m.title, m.type FROM actions a LEFT JOIN memories m ON a.memory_id = m.id WHERE a.id > 700")
def action_memory_join(t: Tables):
    from ..streaming.events import tail

    met = t.actions.join(t.memories.select(F.col("id").alias("memory_id"), "title", "type"), "memory_id", "left")
    return tail(met, 700).select("id", "action", "title", "type")


@query(
    "A24 latency percentiles by nearest rank",
    """SELECT action, count(*) AS n, round(avg(value), 2) AS avg, round(min(value), 2) AS min, round(max(value), 2) AS max, round(list(value ORDER BY value)[greatest(1, CAST(ceil(0.5 * count(*)) AS INT))], 2) AS p50, round(list(value ORDER BY value)[greatest(1, CAST(ceil(0.95 * count(*)) AS INT))], 2) AS p95 FROM actions WHERE value IS NOT NULL GROUP BY action""",
)
def latency_percentiles(t: Tables):
    found = A.nearest_rank(t.actions, ["action"], "value", {"p50": 0.5, "p95": 0.95})
    return found.select("action", "n", *[F.round(c, 2).alias(c) for c in ("avg", "min", "max", "p50", "p95")])


@query("L4 T8 log pruning", "SELECT id FROM actions WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY id DESC LIMIT 500")
def log_prune(t: Tables):
    from ..operators.lifecycle import pruned_log

    return pruned_log(t.actions, F.lit("2024-02-09 00:00:00").cast("timestamp_ntz"), 30, 500).select("id")


@query("A25 A2 distinct languages a repository", "SELECT repo, count(DISTINCT language) AS languages, count(*) AS n FROM memories WHERE status = 'active' GROUP BY repo")
def repo_languages(t: Tables):
    return t.memories.where("status = 'active'").groupBy("repo").agg(F.countDistinct("language").alias("languages"), F.count("*").alias("n"))


@query("X14 totals", "SELECT (SELECT max(id) FROM actions) AS last_action, (SELECT count(*) FROM actions) AS actions, (SELECT count(DISTINCT repo) FROM memories) AS repos")
def global_totals(t: Tables):
    return t.actions.agg(F.max("id").alias("last_action"), F.count("*").alias("actions")).join(F.broadcast(t.memories.agg(F.countDistinct("repo").alias("repos"))))


_LIST = "coalesce(array_to_string({}, ','), '') AS {}"


@query(
    "R20 task detail with comments, children, dependants",
    f"""WITH c AS (SELECT l_orderkey AS id, list(l_returnflag || l_linenumber ORDER BY l_shipdate DESC, l_linenumber DESC, l_returnflag DESC) AS x FROM lineitem GROUP BY 1), k AS (SELECT parent_id AS id, list(task_code ORDER BY created_at, id) AS x FROM tasks WHERE parent_id IS NOT NULL GROUP BY 1),
d AS (SELECT depends_on AS id, list(task_code ORDER BY created_at, id) AS x FROM tasks WHERE depends_on IS NOT NULL GROUP BY 1)
SELECT t.id, {_LIST.format("k.x", "children")}, {_LIST.format("d.x", "depended_by")}, {_LIST.format("c.x", "comments")} FROM tasks t LEFT JOIN k USING (id) LEFT JOIN d USING (id) LEFT JOIN c USING (id) WHERE t.repo = 'repo4'""",
)
def task_detail(t: Tables):
    notes = t.table("lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_shipdate").alias("created_at"), F.col("l_linenumber").alias("id"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("comment"))
    found = A.task_detail(t.tasks, notes).where("repo = 'repo4'")
    return found.select("id", *[F.array_join(c, ",").alias(c) for c in ("children", "depended_by", "comments")])


@query("T4 dynamic sort", "SELECT id, title FROM memories ORDER BY created_at DESC NULLS LAST, id LIMIT 15")
def memory_sorted(t: Tables):
    return A.sorted_by(t.memories, "drop table", True, ["importance", "updated_at"]).limit(15).select("id", "title")

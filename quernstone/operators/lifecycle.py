"""State transitions as table transforms: decay, archiving, pruning, task rules, codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import numbered

# Statuses a task may not go straight from to completed, and those it may start in.
NOT_COMPLETABLE = ("backlog", "pending", "blocked")
STARTING = ("backlog", "pending")


def decayed(memories: DataFrame, as_of: Column, days: int = 7, least: float = 1.0, immune: list[str] | None = None) -> DataFrame:
    """Idle active rows without an immunising tag (case counts) lose half a point, rounded down, to 1; ``decayed`` marks them.

    Rows whose new importance is below ``least`` are archived.
    """
    idle = F.col("last_used_at").isNull() | (F.col("last_used_at") < as_of - F.expr(f"INTERVAL {days} DAYS"))
    safe = F.arrays_overlap("tags", F.array(*map(F.lit, immune))) if immune else F.lit(False)
    hit = (F.col("status") == "active") & idle & ~safe
    lowered = F.greatest(F.lit(1), F.floor(F.col("importance") - 0.5).cast("int"))
    out = memories.withColumn("decayed", hit).withColumn("importance", F.when(hit, lowered).otherwise(F.col("importance")))
    return out.withColumn("status", F.when(F.col("decayed") & (F.col("importance") < least), "archived").otherwise(F.col("status")))


def archived_expired(memories: DataFrame, as_of: Column) -> DataFrame:
    due = (F.col("status") == "active") & (F.col("expires_at") <= as_of)
    return memories.withColumn("status", F.when(due, "archived").otherwise(F.col("status")))


def archived_low_score(memories: DataFrame, as_of: Column, idle_days: int = 90) -> DataFrame:
    """Idle and unimportant, or often shown and never used."""
    last = F.coalesce("last_used_at", "created_at")
    idle = (last < as_of - F.expr(f"INTERVAL {idle_days} DAYS")) & (F.col("importance") < 3)
    unused = (F.col("hit_count") > 10) & (F.col("recall_count") == 0)
    return memories.withColumn("status", F.when((F.col("status") == "active") & (idle | unused), "archived").otherwise(F.col("status")))


def pruned_log(log: DataFrame, as_of: Column, days: int = 30, most: int = 10_000) -> DataFrame:
    from .analytics import keep_newest

    return keep_newest(log.where(F.col("created_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")), most)


def pruned_observations(observations: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return observations.where(F.col("created_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def transition_problem(old: Column, new: Column, comment: Column, open_children: Column) -> Column:
    """Why a task may not change its status; null if it may."""
    return (
        F.when(old == new, F.lit(None).cast("string"))
        .when(F.coalesce(F.trim(comment), F.lit("")) == "", "comment required")
        .when((new == "completed") & old.isin(*NOT_COMPLETABLE), F.concat(old, F.lit(" to completed")))
        .when((new == "completed") & (open_children > 0), "open children")
    )


def checked_transitions(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (id, new_status, comment) with ``problem``; a parent waits for its children."""
    children = tasks.where(F.col("parent_id").isNotNull() & ~F.col("status").isin("completed", "canceled")).groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("_open"))
    met = changes.join(tasks.select("id", "status"), "id").join(children, "id", "left")
    return met.withColumn("problem", transition_problem(F.col("status"), F.col("new_status"), F.col("comment"), F.coalesce("_open", F.lit(0)))).drop("_open")


def moved(tasks: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Tasks after the changes without a problem: status and the time stamp that goes with it."""
    good = checked_transitions(tasks, changes).where("problem IS NULL").select("id", F.col("new_status").alias("_new"))
    met = tasks.join(good, "id", "left")
    turned = F.col("_new").isNotNull() & (F.col("_new") != F.col("status"))
    out = met.withColumn("in_progress_at", F.when(turned & (F.col("_new") == "in_progress"), as_of).otherwise(F.col("in_progress_at")))
    out = out.withColumn("finished_at", F.when(turned & (F.col("_new") == "completed"), as_of).otherwise(F.col("finished_at")))
    return out.withColumn("updated_at", F.when(turned, as_of).otherwise(F.col("updated_at"))).withColumn("status", F.coalesce("_new", "status")).drop("_new")


def released(claims: DataFrame, finished: DataFrame, as_of: Column) -> DataFrame:
    """Claims after the release of all open ones of the finished tasks (column ``task_id``)."""
    done = finished.select("task_id").distinct().withColumn("_done", F.lit(True))
    met = claims.join(done, "task_id", "left")
    return met.withColumn("released_at", F.when(F.col("_done") & F.col("released_at").isNull(), as_of).otherwise(F.col("released_at"))).drop("_done")


def task_archive(tasks: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """A memory for each completed task: formatted content, importance one more than the priority, at most 5."""
    done = tasks.where("status = 'completed'")
    if comments is not None:
        notes = comments.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "comment"))).alias("_c")).select(F.col("task_id").alias("id"), F.concat_ws("\n", F.transform("_c", lambda x: F.concat(F.lit("- "), x["comment"]))).alias("_notes"))
        done = done.join(notes, "id", "left")
    else:
        done = done.withColumn("_notes", F.lit(None).cast("string"))
    content = F.concat_ws("\n", F.concat(F.lit("Task: "), "task_code", F.lit(" "), "title"), F.concat(F.lit("Phase: "), "phase"), "description", "_notes")
    return done.select("id", F.lit("task_archive").alias("type"), F.concat(F.lit("Completed Task: "), "title").alias("title"), content.alias("content"), F.least(F.lit(5), F.col("priority") + 1).alias("importance"), "repo", "owner")


def overflow(new: DataFrame, existing: DataFrame, most: int = 10) -> DataFrame:
    """New pending tasks beyond ``most`` a repository, those there are counted in, become backlog."""
    held = existing.where("status = 'pending'").groupBy("repo").agg(F.count("*").alias("_held"))
    met = numbered(new, ["repo", "status"], ["created_at", "id"]).join(held, "repo", "left")
    over = (F.col("status") == "pending") & (F.col("_n") + F.coalesce("_held", F.lit(0)) > most)
    return met.withColumn("status", F.when(over, "backlog").otherwise(F.col("status"))).drop("_n", "_held")


def unique_codes(df: DataFrame, code: str, by: list[str], order: list[str]) -> DataFrame:
    """Repeated codes get -2, -3, ... in order."""
    return numbered(df, [*by, code], order).withColumn(code, F.when(F.col("_n") > 1, F.concat(F.col(code), F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col(code))).drop("_n")


def first_observations(observations: DataFrame) -> DataFrame:
    """The smallest id of each entity and observation."""
    return observations.groupBy("entity_name", "observation").agg(F.min("id").alias("id"))


def next_codes(existing: DataFrame, new: DataFrame, prefix: str, by: list[str], order: list[str], code: str = "code") -> DataFrame:
    """``new`` with codes that go on from the largest number of each group, at least three digits."""
    number = lambda c: F.regexp_extract(c, rf"^{prefix}-(\d+)$", 1)
    last = existing.select(*by, F.nullif(number(F.col(code)), F.lit("")).cast("long").alias("_k")).groupBy(*by).agg(F.max("_k").alias("_last"))
    met = numbered(new, by, order).join(last, by, "left")
    k = F.coalesce("_last", F.lit(0)) + F.col("_n")
    digits = F.when(F.length(k.cast("string")) >= 3, k.cast("string")).otherwise(F.lpad(k.cast("string"), 3, "0"))
    return met.withColumn(code, F.concat(F.lit(f"{prefix}-"), digits)).drop("_n", "_last")


def gone_ids(gone: DataFrame, key: str = "id") -> DataFrame:
    """``_gone``: the keys once each, which a task holds as a hash table of its share, so that the rows they are sought in need no sort."""
    return gone.select(F.col(key).alias("_gone")).where("_gone IS NOT NULL").distinct().hint("shuffle_hash")


def purged(df: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among those gone; a null key stays."""
    ids = gone_ids(gone, key)
    return df.join(ids, F.col(key) == F.col("_gone"), "left_anti")


def detached(tasks: DataFrame, gone: DataFrame) -> DataFrame:
    """Tasks without those gone; children of these lose their parent."""
    left = purged(tasks, gone).join(gone_ids(gone), F.col("parent_id") == F.col("_gone"), "left")
    return left.withColumn("parent_id", F.when(F.col("_gone").isNull(), F.col("parent_id"))).drop("_gone")


def superseded(memories: DataFrame) -> DataFrame:
    """Rows that another row supersedes become archived."""
    old = memories.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("_old")).distinct()
    met = memories.join(old, F.col("id") == F.col("_old"), "left")
    return met.withColumn("status", F.when(F.col("_old").isNotNull(), "archived").otherwise(F.col("status"))).drop("_old")


def counted_hits(memories: DataFrame, shown: DataFrame, as_of: Column, recalled: bool = False) -> DataFrame:
    """Hit (or recall) counters after the rows shown (column ``id``, repeats count)."""
    column = "recall_count" if recalled else "hit_count"
    n = shown.groupBy("id").agg(F.count("*").alias("_n"))
    met = memories.join(n, "id", "left")
    out = met.withColumn(column, (F.col(column) + F.coalesce("_n", F.lit(0))).cast("int"))
    return out.withColumn("last_used_at", F.when(F.col("_n") > 0, as_of).otherwise(F.col("last_used_at"))).drop("_n")


def structured_content(**parts: Column) -> Column:
    """Labelled paragraphs of those parts that are not null."""
    return F.concat_ws("\n\n", *[F.when(c.isNotNull(), F.concat(F.lit(f"{name.capitalize()}: "), c)) for name, c in parts.items()])


def summaries(signals: DataFrame) -> DataFrame:
    """One text a repository: its signals in order, each a list item."""
    lists = signals.groupBy("owner", "repo").agg(F.array_sort(F.collect_list(F.struct("pos", "signal"))).alias("_s"))
    return lists.select("owner", "repo", F.concat(F.lit("- "), F.concat_ws("\n- ", F.transform("_s", lambda x: x["signal"]))).alias("summary"))


def due(last_run, as_of, hours: float = 24.0) -> bool:
    """Whether a job that ran last at a time (or never) may run again."""
    return last_run is None or (as_of - last_run).total_seconds() >= hours * 3600


def with_phase_tag(tasks: DataFrame) -> DataFrame:
    """Tags with the one phase tag of the task's phase in place of any other."""
    other = F.filter("tags", lambda t: ~F.lower(t).startswith("phase:"))
    mine = F.when(F.col("phase").isNotNull(), F.array(F.concat(F.lit("phase:"), F.lower("phase")))).otherwise(F.array().cast("array<string>"))
    return tasks.withColumn("tags", F.array_union(other, mine))


def new_memories(drafts: DataFrame, as_of: Column) -> DataFrame:
    """Draft rows as memories: ``ttl_days`` becomes ``expires_at``, the language joins the tags, counters start at 0."""
    expires = F.when(F.col("ttl_days").isNotNull(), F.timestamp_add("DAY", F.col("ttl_days"), as_of)).cast("timestamp_ntz")
    tags = F.when(F.col("language").isNotNull(), F.array_union("tags", F.array("language"))).otherwise(F.col("tags"))
    return drafts.withColumn("expires_at", expires).withColumn("tags", tags).withColumn("hit_count", F.lit(0)).withColumn("recall_count", F.lit(0)).withColumn("status", F.lit("active")).withColumn("created_at", as_of).drop("ttl_days")

"""Life cycles of records: creation, change and deletion of tasks, claims, handoffs, standards and graph rows.

Tables are immutable, so each operator gives the table after the change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import analytics, lifecycle


def created(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``base`` and ``new``; evaluating it fails with the key of a row that either repeats."""
    both = base.unionByName(new, allowMissingColumns=True)
    twice = F.count("*").over(Window.partitionBy(*key)) > 1
    named = F.concat_ws(", ", *(F.col(k).cast("string") for k in key))
    checked = both.withColumn("_twice", F.when(twice, F.raise_error(F.concat(F.lit("exists already: "), named))).otherwise(F.lit(None)))
    return checked.where("_twice IS NULL").drop("_twice")


def duplicates(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``base`` has."""
    return new.join(base.select(*key).distinct(), key, "left_semi")


def mixed_bulk(base: DataFrame, items: DataFrame, allowed: list[str], at: Column) -> DataFrame:
    """Items with a known id update these columns, items without an id are new rows; the others are left out."""
    from ..sources.tables import updated

    changed = updated(base, items.where("id IS NOT NULL"), "id", allowed)
    touched = items.where("id IS NOT NULL").select(F.col("id").alias("_touched")).distinct()
    met = changed.join(touched, F.col("id") == F.col("_touched"), "left").withColumn("updated_at", F.when(F.col("_touched").isNotNull(), at).otherwise(F.col("updated_at"))).drop("_touched")
    fresh = items.where("id IS NULL").drop("id").withColumn("updated_at", at)
    return met.unionByName(fresh, allowMissingColumns=True)


def listed_tasks(tasks: DataFrame, repo: str, statuses: list[str], text: str | None = None) -> DataFrame:
    """Tasks of a repository with one of the statuses and, if given, a text in title or description; the board's order."""
    from .retrieval import substring

    found = tasks.where((F.col("repo") == repo) & F.col("status").isin(statuses))
    found = found.where(substring(text, "title", "description")) if text else found
    return found.orderBy(*analytics.board_order())


def newest_comments(comments: DataFrame, repo: str, most: int) -> DataFrame:
    return comments.where(F.col("repo") == repo).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(most)


def expired_handoffs(handoffs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Pending handoffs of the tasks become expired."""
    ids = tasks.select(F.col("id").alias("_task")).distinct()
    met = handoffs.join(ids, F.col("task_id") == F.col("_task"), "left")
    gone = (F.col("status") == "pending") & F.col("_task").isNotNull()
    return met.withColumn("status", F.when(gone, "expired").otherwise(F.col("status"))).drop("_task")


def claimed(claims: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """The claims after new ones: the active claims of their tasks are released, then they are added."""
    tasks = new.select(F.col("task_id").alias("_task")).distinct()
    met = claims.join(tasks, F.col("task_id") == F.col("_task"), "left")
    released = F.when(F.col("released_at").isNull() & F.col("_task").isNotNull(), at).otherwise(F.col("released_at"))
    old = met.withColumn("released_at", released).drop("_task")
    return old.unionByName(new.withColumn("claimed_at", at), allowMissingColumns=True)


def without_entities(names: DataFrame, entities: DataFrame, relations: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and observations after some entities (``repo, name``) are deleted; other repositories keep theirs."""
    gone = names.select("repo", "name").distinct()
    less = lambda df, *columns: _without(df, gone, columns)
    return less(entities, "name"), less(relations, "from_entity", "to_entity"), less(observations, "entity_name")


def _without(df: DataFrame, gone: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    for c in columns:
        df = df.join(gone.withColumnRenamed("name", c), ["repo", c], "left_anti")
    return df


def commented(comments: DataFrame, new: DataFrame, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """The comments after new ones, changed texts (``id, comment``) and deletions (``id``)."""
    from ..sources.tables import updated

    left = comments.join(gone.select("id").distinct(), "id", "left_anti")
    return updated(left, changed, "id", ["comment"]).unionByName(new, allowMissingColumns=True)


def saved_batch(entities: DataFrame, relations: DataFrame, new: DataFrame) -> DataFrame:
    """``relations`` rows of a batch with ``outcome``: saved, or why a row alone is skipped.

    A row needs both ends among the entities and a type; what is there already, or earlier in the
    batch (by ``id``), is ignored.
    """
    key = ["repo", "from_entity", "to_entity", "relation_type"]
    ends = entities.select(F.col("repo"), F.col("name")).distinct()
    met = new
    for end in ("from", "to"):
        side = ends.select("repo", F.col("name").alias(f"{end}_entity"), F.lit(True).alias(f"_{end}"))
        met = met.join(side, ["repo", f"{end}_entity"], "left")
    known = relations.select(*key, F.lit(True).alias("_known")).distinct()
    met = met.join(known, key, "left")
    bad = F.col("relation_type").isNull() | (F.trim("relation_type") == "")
    lacking = F.col("_from").isNull() | F.col("_to").isNull()
    first = F.row_number().over(Window.partitionBy(*key).orderBy("id")) == 1
    outcome = F.when(bad, "invalid").when(lacking, "no entity").when(F.col("_known") | ~first, "ignored").otherwise("saved")
    return met.withColumn("outcome", outcome).drop("_from", "_to", "_known")


def enqueued(jobs: DataFrame, rows: DataFrame, kind: str, at: Column) -> DataFrame:
    """Pending jobs for the rows (``id``) that have no job of the kind yet."""
    ids = rows.select(F.lit(kind).alias("entity_kind"), F.col("id").cast("string").alias("entity_id")).distinct()
    fresh = ids.join(jobs.select("entity_kind", "entity_id").distinct(), ["entity_kind", "entity_id"], "left_anti")
    return fresh.withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0)).withColumn("created_at", at)


def coordination(handoffs: DataFrame, claims: DataFrame, tasks: DataFrame, agent: str) -> DataFrame:
    """Open tasks that an agent holds or is offered: ``task_id, task_code, held, offered``."""
    held = analytics.active_claims(claims).where(F.col("agent") == agent).select("task_id", F.lit(True).alias("held"))
    offered = analytics.latest(handoffs.where("status = 'pending'"), "task_id", "created_at", ["to_agent"]).where(F.col("to_agent") == agent).select("task_id", F.lit(True).alias("offered"))
    both = held.join(offered, "task_id", "full")
    open_ = tasks.where(~F.col("status").isin("completed", "canceled")).select(F.col("id").alias("task_id"), "task_code")
    return both.join(open_, "task_id").select("task_id", "task_code", F.coalesce("held", F.lit(False)).alias("held"), F.coalesce("offered", F.lit(False)).alias("offered"))


def deleted_tasks(tasks: DataFrame, comments: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks and comments after some tasks are deleted: children lose their parent, comments go too."""
    left = lifecycle.detached(tasks, gone)
    return left, comments.join(lifecycle.gone_ids(gone), F.col("task_id") == F.col("_gone"), "left_anti")

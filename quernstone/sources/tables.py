"""Merging changes into tables, and reading and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, folder: str, name: str, repo: str | None = None, owner: str | None = None) -> DataFrame:
    """A table, restricted to a scope; the filters reach the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if repo:
        df = df.where(F.col("repo") == repo)
    return df.where(F.col("owner") == owner) if owner else df


def upserted(base: DataFrame, changes: DataFrame, key: list[str], at: str) -> DataFrame:
    """Last write wins: of rows with one key the newest; a change beats a base row of equal time."""
    both = base.withColumn("_p", F.lit(0)).unionByName(changes.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    newest = Window.partitionBy(*key).orderBy(F.col(at).desc_nulls_last(), F.col("_p").desc())
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_p")


def inserted(base: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """Rows of ``new`` to append: keys that ``base`` lacks, the first of each by ``order``."""
    fresh = new.join(base.select(*key).distinct(), key, "left_anti")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def updated(base: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """``base`` with the non-null values of the allowed columns of ``changes``; of repeated keys the last id counts.

    A map column is merged, the change's entries winning.
    """
    columns = [c for c in allowed if c in changes.columns]
    one = changes.groupBy(key).agg(*[F.last(c, ignorenulls=True).alias(f"_{c}") for c in columns])
    met = base.join(one, key, "left")
    for c in columns:
        if base.schema[c].dataType.typeName() == "map":
            own, new = F.col(c), F.col(f"_{c}")
            kept = F.map_filter(own, lambda k, v: ~F.map_contains_key(new, k))  # noqa: B023
            met = met.withColumn(c, F.when(new.isNull(), own).otherwise(F.map_concat(kept, new)))
        else:
            met = met.withColumn(c, F.coalesce(f"_{c}", c))
    return met.select(*base.columns)


def renamed(df: DataFrame, moves: DataFrame, columns: list[str]) -> DataFrame:
    """Paths in these columns after the moves (``old_path, new_path``)."""
    for c in columns:
        step = moves.select(F.col("old_path").alias("_old"), F.col("new_path").alias("_new"))
        df = df.join(step, F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
    return df


def exported(df: DataFrame) -> DataFrame:
    """A row as one JSON text each, null members included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def imported(spark: SparkSession, lines: DataFrame, schema: str, required: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Rows of JSON texts (column ``json``); those that lack a required member go, defaults fill the rest."""
    df = lines.select(F.from_json("json", schema).alias("r")).select("r.*")
    for c in required:
        df = df.where(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    for c, value in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), value))
    return df


def merged_standards(base: DataFrame, new: DataFrame) -> DataFrame:
    """Import upsert: a new row replaces the base row of its id, else of its code, else is added."""
    by_id = new.join(base.select("id"), "id", "left_semi")
    rest = new.join(base.select("id"), "id", "left_anti")
    by_code = rest.join(base.select("code", F.col("id").alias("_id")).groupBy("code").agg(F.min("_id").alias("_id")), "code", "left").withColumn("id", F.coalesce("_id", "id")).drop("_id")
    changes = by_id.unionByName(by_code)
    return base.join(changes.select("id"), "id", "left_anti").unionByName(changes, allowMissingColumns=True)


def decoded(df: DataFrame) -> DataFrame:
    """Stored rows with defaults: title, type, counters, status, and lists and maps from JSON (invalid: empty)."""
    defaults = {"title": F.lit("Untitled"), "type": F.lit("unknown"), "hit_count": F.lit(0), "recall_count": F.lit(0), "status": F.lit("active")}
    for c, value in defaults.items():
        if c in df.columns:
            df = df.withColumn(c, F.coalesce(F.col(c), value))
    if "tags" in df.columns and df.schema["tags"].dataType.typeName() == "string":
        df = df.withColumn("tags", F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>")))
    if "metadata" in df.columns and df.schema["metadata"].dataType.typeName() == "string":
        df = df.withColumn("metadata", F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")))
    return df


def with_recall_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("recall_rate", F.when(F.col("hit_count") > 0, F.col("recall_count") / F.nullif(F.col("hit_count"), F.lit(0))).otherwise(0.0))


def public(df: DataFrame) -> DataFrame:
    """Without the columns that answers leave out."""
    return df.drop("hit_count", "recall_count", "last_used_at", "expires_at", "model", "recall_rate", "vector_version", "similarity")


def audited(response: Column) -> Column:
    """Number of results an audit row keeps: the first count there is in the response."""
    names = ("deletedCount", "createdCount", "canceledCount", "count")
    found = [F.get_json_object(response, f"$.{n}").cast("long") for n in names]
    listed = F.json_array_length(F.get_json_object(response, "$.results"))
    return F.coalesce(*found, listed.cast("long"), F.lit(0).cast("long"))


def action_rows(calls: DataFrame) -> DataFrame:
    """Audit rows of tool calls (``tool, args, response``, both JSON): ``action, repo, query, memory_id, task_id, result_count``.

    A plain id names a memory for memory tools, and a task for task, handoff and claim tools; an id
    of another kind never lands in the wrong column.
    """
    arg = lambda path: F.nullif(F.get_json_object("args", f"$.{path}"), F.lit(""))
    answer = lambda path: F.get_json_object("response", f"$.{path}")
    parts = F.split("tool", "-")
    domain = F.element_at(parts, 1)
    of_memory, of_task = domain == "memory", domain.isin("task", "handoff", "claim")
    memory = F.when(of_memory, F.coalesce(arg("id"), arg("memory_id"), answer("memory.id"), answer("id"))).otherwise(arg("memory_id"))
    task = F.when(of_task, F.coalesce(arg("id"), arg("task_id"), answer("task.id"), answer("handoff.id"), answer("claim.id"), answer("id"))).otherwise(arg("task_id"))
    return calls.select(
        F.coalesce(F.nullif(F.try_element_at(parts, F.lit(2)), F.lit("")), "tool").alias("action"),
        F.coalesce(arg("repo"), arg("scope.repo"), F.lit("unknown")).alias("repo"),
        F.coalesce(arg("query"), arg("title"), arg("task_code")).alias("query"),
        memory.alias("memory_id"),
        task.alias("task_id"),
        audited(F.col("response")).alias("result_count"),
    )


def paged(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page with ``total``: rows in all. The total is one grouped row, not a window over everything."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))

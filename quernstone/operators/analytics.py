"""Task, claim, activity and repository analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .prefix import runs

STATUSES = ("backlog", "pending", "in_progress", "completed", "canceled", "blocked")
DAY = 86_400_000_000


def counts(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def status_pivot(tasks: DataFrame, *by: str) -> DataFrame:
    """Total and one counter a status."""
    each = [F.sum((F.col("status") == s).cast("long")).alias(s) for s in STATUSES]
    return tasks.groupBy(*by).agg(F.count("*").alias("total"), *each)


def periods(as_of: Column) -> dict[str, Column]:
    """First instant of each reporting period; overall has none."""
    today = F.date_trunc("day", as_of)
    return {"overall": F.lit(None).cast("timestamp_ntz"), "daily": today, "weekly": as_of - F.expr("INTERVAL 7 DAYS"), "monthly": as_of - F.expr("INTERVAL 30 DAYS")}


def task_time_stats(tasks: DataFrame, as_of: Column) -> DataFrame:
    """A row a period: completed, tokens, average minutes from start to end, added. One pass."""
    aggregates, names = [], []
    for name, since in periods(as_of).items():
        start = since.cast("timestamp_ntz")
        ended = (F.col("status") == "completed") & (start.isNull() | (F.col("finished_at") >= start))
        added = start.isNull() | (F.col("created_at") >= start)
        minutes = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("in_progress_at").cast("timestamp"))) / 60e6
        parts = [F.count_if(ended).alias("completed"), F.coalesce(F.sum(F.when(ended, F.col("est_tokens"))), F.lit(0)).alias("tokens"), F.avg(F.when(ended & F.col("in_progress_at").isNotNull(), minutes)).alias("minutes"), F.count_if(added).alias("added")]
        aggregates += [p.alias(f"{name}_{i}") for i, p in enumerate(parts)]
        names.append(name)
    row = tasks.agg(*aggregates)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("period"), *[F.col(f"{n}_{i}").alias(c) for i, c in enumerate(("completed", "tokens", "avg_minutes", "added"))]) for n in names]))
    return row.select(rows.alias("r")).select("r.*")


def week_label(day: Column) -> Column:
    """W and the week of the year with Monday first, 00 before the first Monday."""
    number = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7).cast("int")
    return F.concat(F.lit("W"), F.lpad(number.cast("string"), 2, "0"))


LABELS = {
    "daily": lambda c: F.date_format(c, "HH:00"),
    "weekly": lambda c: F.date_format(c, "yyyy-MM-dd"),
    "monthly": week_label,
    "overall": lambda c: F.date_format(c, "yyyy-MM"),
}


def task_series(tasks: DataFrame, period: str, since: Column | None, most: int = 100) -> DataFrame:
    """``label, created, completed`` of the period, the first ``most`` labels."""
    label = LABELS[period]
    one = lambda c, created: tasks.where(F.col(c).isNotNull() & (F.lit(True) if since is None else F.col(c) >= since)).select(label(F.col(c)).alias("label"), F.lit(int(created)).cast("long").alias("created"), F.lit(int(not created)).cast("long").alias("completed"))
    both = one("created_at", True).unionByName(one("finished_at", False))
    return both.groupBy("label").agg(F.sum("created").alias("created"), F.sum("completed").alias("completed")).orderBy("label").limit(most)


def board_order() -> list[Column]:
    """Completed tasks last and by last change; the rest by status, priority and age."""
    done = F.col("status") == "completed"
    place = F.when(F.col("status") == "in_progress", 0).when(F.col("status") == "pending", 1).when(F.col("status") == "backlog", 2).when(F.col("status") == "blocked", 3).otherwise(4)
    return [done.cast("int").asc(), F.when(done, F.col("updated_at")).desc_nulls_last(), F.when(~done, place).asc_nulls_last(), F.col("priority").desc_nulls_last(), F.col("created_at").asc(), F.col("id").asc()]


def latest(df: DataFrame, by: str, at: str, columns: list[str], tie: str = "id") -> DataFrame:
    """The newest row of each key: one grouped pass instead of correlated subqueries.

    Rows of equal time and tie are told apart by the columns themselves, so that runs agree.
    """
    return df.groupBy(by).agg(F.max_by(F.struct(*columns), F.struct(at, tie, *(c for c in columns if c not in (at, tie)))).alias("_r")).select(by, *[F.col(f"_r.{c}") for c in columns])


def active_claims(claims: DataFrame) -> DataFrame:
    return latest(claims.where("released_at IS NULL"), "task_id", "claimed_at", ["agent", "claimed_at"])


def children(tasks: DataFrame) -> DataFrame:
    """Each parent's children in order of creation."""
    each = tasks.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "task_code"))).alias("_c"))
    return each.select("parent_id", F.transform("_c", lambda x: x["task_code"]).alias("children"))


def bursts(actions: DataFrame, minutes: int, within: list[str]) -> DataFrame:
    """Runs of equal actions one after another, each within so many minutes of the one before, as one row.

    The row keeps the first id, takes the last time, and counts the run as ``burst``. Runs lie within
    one value of the columns ``within``, whose rows are put in order.
    """
    same = ["action", "query", "memory_id"]

    def starts(now: Column, last: Column) -> Column:
        changed = F.lit(False)
        for c in same:
            changed = changed | ~now[c].eqNullSafe(last[c])
        micros = lambda x: F.unix_micros(x["created_at"].cast("timestamp"))
        return changed | (micros(now) - micros(last) > minutes * 60_000_000)

    found = runs(actions, within, ["created_at", "id"], starts, [*same, "created_at"])
    return found.groupBy(*within, "_run", *same).agg(F.min("id").alias("id"), F.max("created_at").alias("created_at"), F.count("*").alias("burst")).drop("_run")


def nearest_rank(df: DataFrame, by: list[str], value: str, shares: dict[str, float], ranges: int = 64) -> DataFrame:
    """Exact percentiles by nearest rank, with average, least and most.

    Values are counted into ranges cut at approximate quantiles, which find the range that holds a
    rank; only the distinct values of those ranges are put in order, so no task sorts a whole group.
    """
    known = df.where(F.col(value).isNotNull())
    whole = known.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    facts = whole.select(*by, "n", "_cuts")
    ranged = known.groupBy(*by, value).agg(F.count("*").alias("_k")).join(facts, by).withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    counts = ranged.groupBy(*by, "n", "_r").agg(F.sum("_k").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))  # a row a range
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("n") * q)).alias("rank")) for name, q in shares.items())))
    placed = counts.withColumn("_upto", upto).withColumn("_w", wanted).where((F.col("_w.rank") <= F.col("_upto")) & (F.col("_w.rank") > F.col("_upto") - F.col("_k")))
    places = placed.select(*by, "_r", F.col("_w.name").alias("_name"), (F.col("_w.rank") - F.col("_upto") + F.col("_k")).alias("_rest"))
    inside = Window.partitionBy(*by, "_name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    met = ranged.join(places, [*by, "_r"]).withColumn("_upto", F.sum("_k").over(inside)).where(F.col("_upto") >= F.col("_rest"))
    picks = met.groupBy(*by).agg(*(F.min(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in shares))
    return whole.drop("_cuts").join(picks, by)


def top_per_group(df: DataFrame, by: list[str], order: list, caps: dict[str, int] | int, group: str | None = None) -> DataFrame:
    """The first rows of each group, with ``place``; caps may differ by the value of ``group``."""
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    if isinstance(caps, int):
        return placed.where(F.col("place") <= caps)
    limit = F.lit(0)
    for name, n in caps.items():
        limit = F.when(F.col(group) == name, n).otherwise(limit)
    return placed.where(F.col("place") <= limit)


def repo_navigation(memories: DataFrame, tasks: DataFrame, claims: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Counts a repository, its last change, and its pressure."""
    counted = [
        memories.groupBy("repo").agg(F.count("*").alias("memories"), F.max("updated_at").alias("changed")),
        tasks.groupBy("repo").agg(F.count("*").alias("tasks"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "in_progress", "blocked")], F.max("updated_at").alias("changed")),
        claims.where("released_at IS NULL").groupBy("repo").agg(F.count("*").alias("claims")),
        handoffs.where("status = 'pending'").groupBy("repo").agg(F.count("*").alias("handoffs")),
    ]
    whole = counted[0]
    for other in counted[1:]:
        whole = whole.unionByName(other, allowMissingColumns=True)
    numbers = ["memories", "tasks", "pending", "in_progress", "blocked", "claims", "handoffs"]
    merged = whole.groupBy("repo").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers], F.max("changed").alias("changed"))
    pressure = F.col("blocked") * 5 + F.col("in_progress") * 3 + F.col("pending") * 2 + F.col("handoffs") * 2 + F.col("claims")
    return merged.withColumn("pressure", pressure)


def dashboard_stats(memories: DataFrame, as_of: Column, *by: str) -> DataFrame:
    """Count, mean importance to one place, hits, and how many expire within a week."""
    soon = F.col("expires_at").between(as_of, as_of + F.expr("INTERVAL 7 DAYS"))
    return memories.groupBy(*by).agg(F.count("*").alias("total"), F.round(F.avg("importance"), 1).alias("avg_importance"), F.sum("hit_count").alias("hits"), F.count_if(soon).alias("expiring"))


def keep_newest(log: DataFrame, most: int) -> DataFrame:
    """The rows with the ``most`` largest ids: a bounded top-k finds the cut, no global sort."""
    cut = log.select("id").orderBy(F.col("id").desc()).limit(most).agg(F.min("id").alias("_cut"))
    return log.join(F.broadcast(cut)).where(F.col("id") >= F.col("_cut")).drop("_cut")


def task_detail(tasks: DataFrame, comments: DataFrame) -> DataFrame:
    """Tasks with children and dependants (codes in order of creation) and comments, newest first."""
    dependants = tasks.where("depends_on IS NOT NULL").groupBy("depends_on").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "task_code"))).alias("_d"))
    dependants = dependants.select(F.col("depends_on").alias("id"), F.transform("_d", lambda x: x["task_code"]).alias("depended_by"))
    notes = comments.groupBy("task_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "id", "comment")))).alias("_c"))
    notes = notes.select(F.col("task_id").alias("id"), F.transform("_c", lambda x: x["comment"]).alias("comments"))
    kids = children(tasks).withColumnRenamed("parent_id", "id")
    met = tasks
    none = F.array().cast("array<string>")
    for part, column in ((kids, "children"), (dependants, "depended_by"), (notes, "comments")):
        met = met.join(part, "id", "left").withColumn(column, F.coalesce(column, none))
    return met


def sorted_by(df: DataFrame, column: str, descending: bool, allowed: list[str], default: str = "created_at") -> DataFrame:
    """Ordered by an allowed column, else by the default; ties by id."""
    key = F.col(column if column in allowed else default)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "id")

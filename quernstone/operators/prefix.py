"""Numbers along ordered groups without a task that holds a group.

Rows are cut into ranges by group and order and stored with their range, so a group of any size lies in as
many ranges as it needs. Each range gives one small state a group (how many rows, the last row), the states
of a group's few ranges are added up in order, and rows are numbered inside their range from what is
carried in. Orders end in a column that tells all rows of a group apart; a null is a value of its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import staged


def ranged(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` stored with ``_range``: ranges that follow one another in order of group and ``order``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *by, *order)
    return staged(cut.withColumn("_range", F.spark_partition_id()), "ranges")


def carried_in(states: DataFrame, by: list[str], sums: list[str], lasts: list[str]) -> DataFrame:
    """States of ranges with, for each sum, that of the ranges before it, and the last row of the one just before."""
    ahead = Window.partitionBy(*by).orderBy("_range")  # of one group's ranges: at most as many as tasks
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    return states.select(*by, "_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums), *(F.lag(c).over(ahead).alias(c) for c in lasts))


def met_by_range(df: DataFrame, carry: DataFrame, by: list[str]) -> DataFrame:
    """Rows with what their range of their group carries in; there are few such states, and each group has its own."""
    named = carry.withColumnsRenamed({c: f"_of_{c}" for c in [*by, "_range"]})
    same = F.col("_range") == F.col("_of__range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return df.join(named, same).drop(*(f"_of_{c}" for c in [*by, "_range"]))


def numbered(df: DataFrame, by: list[str], order: list[str], out: str = "_n") -> DataFrame:
    """``df`` with the number of each row of its group in order, from 1."""
    cut = ranged(df, by, order)
    carry = carried_in(cut.groupBy(*by, "_range").agg(F.count("*").alias("_before")), by, ["_before"], [])
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return met_by_range(cut.withColumn(out, inside), carry, by).withColumn(out, F.col(out) + F.col("_before")).drop("_before", "_range")


def runs(df: DataFrame, by: list[str], order: list[str], starts, columns: list[str], out: str = "_run") -> DataFrame:
    """``df`` with the number of each row's run in its group; ``starts(now, last)`` tells whether a row starts one after the row before it.

    Both are structs of ``columns``; ``last`` is null at the first row of a group.
    """
    now = F.struct(*(F.col(c) for c in columns))
    cut = ranged(df, by, order).withColumn("_now", now)
    place = Window.partitionBy(*by, "_range").orderBy(*order)
    tails = cut.groupBy(*by, "_range").agg(F.max_by("_now", F.struct(*order)).alias("_tail"))
    met = met_by_range(cut.withColumn("_lag", F.lag("_now").over(place)), carried_in(tails, by, [], ["_tail"]), by)
    last: Column = F.coalesce("_lag", "_tail")
    marked = met.withColumn("_new", F.when(last.isNull(), 1).otherwise(F.coalesce(starts(F.col("_now"), last), F.lit(True)).cast("int"))).drop("_lag", "_tail")
    counts = marked.groupBy(*by, "_range").agg(F.sum("_new").alias("_before"))
    inside = marked.withColumn(out, F.sum("_new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    return met_by_range(inside, carried_in(counts, by, ["_before"], []), by).withColumn(out, F.col(out) + F.col("_before")).drop("_before", "_range", "_now", "_new")

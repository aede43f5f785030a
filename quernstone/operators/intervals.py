"""Stabbing joins by a sweep: points and spans of a key in order of line, never points times spans.

Spans are cut at bins of lines, so that a key of many lines is swept by several tasks; a span stands in
every bin that it reaches into. Within a bin the starts of spans and the points come in order of line,
and the spans that are open lie in a heap, or in order of start, from which the wanted one is read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BIN = 4096  # lines


class Innermost:
    """Open spans by length, start and id; the first that still reaches the point is the innermost."""

    def __init__(self):
        self.heap: list[tuple] = []

    def open(self, start: int, end: int, span: object) -> None:
        heapq.heappush(self.heap, (end - start, start, span, end))

    def at(self, line: int, until: int, own: object) -> object:
        while self.heap and self.heap[0][3] < line:
            heapq.heappop(self.heap)
        return self.heap[0][2] if self.heap else None


class Closest:
    """Open spans in order of start; the last one around the whole of another span is the closest.

    Of equal starts the one that ends first, then that with the larger id, is last.
    """

    def __init__(self):
        self.open_: list[tuple] = []
        self.closed = 0

    def open(self, start: int, end: int, span: object) -> None:
        self.open_.append((start, -end, span))
        if len(self.open_) > 1 and self.open_[-2] > self.open_[-1]:
            self.open_.sort()

    def at(self, line: int, until: int, own: object) -> object:
        for start, end, span in reversed(self.open_):
            if -end >= until and span != own:
                return span
            self.closed += -end < line
        if self.closed > 2 * len(self.open_) + 64:
            self.open_ = [x for x in self.open_ if -x[1] >= line]
            self.closed = 0
        return None


def stabbed(points: DataFrame, spans: DataFrame, keys: list[str], order: Callable[[], object] = Innermost, width: int = BIN) -> DataFrame:
    """``_point, _span``: each point with the id of the span chosen, null if there is none.

    Points: ``keys, _point, _line, _until, _own`` (a span that it may not choose); spans: ``keys, _span,
    _start, _end``. Points with a null key or line, or nowhere inside, have no span; spans with a null
    key or end have no point.
    """
    whole = lambda df, *columns: df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, *columns)))
    kind, point = spans.schema["_span"].dataType, points.schema["_point"].dataType
    bin_ = lambda c: F.floor(F.col(c) / width).cast("int")
    none = lambda t: F.lit(None).cast(t)
    known = whole(points, "_line")
    left = known.select(*keys, bin_("_line").alias("_bin"), F.col("_line").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.coalesce("_until", "_line").cast("long").alias("_to"), none(kind).alias("_span"), "_point", F.col("_own").cast(kind).alias("_own"))
    reach = whole(spans, "_start", "_end").where("_start <= _end").withColumn("_bin", F.explode(F.sequence(bin_("_start"), bin_("_end"))))
    right = reach.select(*keys, "_bin", F.col("_start").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col("_end").cast("long").alias("_to"), "_span", none(point).alias("_point"), none(kind).alias("_own"))
    group = [*keys, "_bin"]
    n = len(group)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, order()
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != here:
                    here, state = row[:n], order()
                at, what, to, span, key, own = row[n:]
                if what == 0:
                    state.open(at, to, span)
                else:
                    out.append((key, state.at(at, to, own)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], to_arrow_type(t)) for i, t in enumerate((point, kind))], ["_point", "_span"])

    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = left.unionByName(right).repartition(parts, *group).sortWithinPartitions(*group, "_at", "_kind")
    return both.mapInArrow(sweep, f"_point {point.simpleString()}, _span {kind.simpleString()}")

"""Nearest vectors by an inverted file: rows stored by cell, some cells probed, exact re-ranking.

Centroids are fitted by cosine k-means to a sample of at most ``sample`` rows (those with the least
hashes of their ids, so a rerun takes the same); every row is put in the cell of its nearest centroid
and stored in order of cell. A search deals queries and rows by cell, in blocks of bounded size, to tasks
that multiply them as matrices and keep each query's best; probing all cells is the exact mode.

Cases: rows whose vector is null, has a null or non-finite entry, has another length than the first
centroid, or is zero have no direction and are no one's neighbours; queries without a direction find
nothing. Ties (to nine places) go to the smaller id. A row is not its own neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import staged


@dataclass(frozen=True)
class VectorIndex:
    """``rows`` (cell, id, vector), stored in order of cell, and the unit ``centroids``, a row each."""

    rows: DataFrame
    centroids: np.ndarray


def directed(vectors: DataFrame) -> DataFrame:
    """Rows ``id, vector`` (doubles) that have a direction."""
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def nearest_cells(df: DataFrame, centroids: np.ndarray, most: int) -> DataFrame:
    """``cell, id, vector``: each row with its ``most`` nearest cells, unit vectors."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = np.array([len(v) == centroids.shape[1] for v in batch.column(1)], bool)
            kept = batch.filter(pa.array(fits))
            if kept.num_rows:
                v = kept.column(1).flatten().to_numpy(zero_copy_only=False).reshape(kept.num_rows, -1)
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                cells = np.argsort(-(v @ centroids.T), axis=1, kind="stable")[:, :most]
                again = np.repeat(np.arange(len(v)), cells.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), kept.column(0).take(pa.array(again)), pa.array(list(v[again]), pa.list_(pa.float64()))], ["cell", "id", "vector"])

    return df.select("id", "vector").mapInArrow(run, f"cell int, id {kind}, vector array<double>")


def build(vectors: DataFrame, cells: int = 64, sample: int = 20_000, seed: int = 7) -> VectorIndex:
    """The index of all rows of ``vectors`` (id, vector)."""
    rows = directed(vectors)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample)
    length = some.groupBy(F.size("vector").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    if length is None:
        return VectorIndex(staged(rows.select(F.lit(0).alias("cell"), "id", "vector"), "cells"), np.zeros((0, 0)))
    some = some.where(F.size("vector") == length["n"])
    model = KMeans(k=max(1, min(cells, length["count"])), seed=seed, distanceMeasure="cosine", maxIter=15, featuresCol="v").fit(some.select(array_to_vector("vector").alias("v")))
    centroids = np.array([c for c in model.clusterCenters()])
    centroids = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-300)
    placed = nearest_cells(rows, centroids, 1).repartitionByRange("cell").sortWithinPartitions("cell", "id")
    return VectorIndex(staged(placed, "cells"), centroids)


def search(index: VectorIndex, queries: DataFrame, k: int, probe: int | None = None, block: int = 4096) -> DataFrame:
    """``query, id, similarity, rank``: the k nearest rows of each query (id, vector) in its ``probe`` nearest cells; None: in all."""
    cells = len(index.centroids)
    kind = index.rows.schema["id"].dataType.simpleString()
    asked = nearest_cells(directed(queries), index.centroids, cells if probe is None else min(probe, cells)) if cells else index.rows.where("false")
    sizes = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    n = sizes(index.rows, "rows").join(sizes(asked, "queries"), "cell")  # a row a cell
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asked.join(n, "cell").withColumn("q", part("queries")).withColumn("r", every("rows")).withColumn("asks", F.lit(True))
    right = index.rows.join(n, "cell").withColumn("r", part("rows")).withColumn("q", every("queries")).withColumn("asks", F.lit(False))
    dealt = left.unionByName(right).select("cell", "q", "r", "asks", "id", "vector")

    def best(group: list[tuple]) -> pa.RecordBatch:
        ask, have = [g for g in group if g[0]], [g for g in group if not g[0]]
        out = []
        if ask and have:
            near = np.round(np.stack([g[2] for g in ask]) @ np.stack([g[2] for g in have]).T, 9)
            ids = [g[1] for g in have]
            for i, (_, key, _) in enumerate(ask):
                least = np.partition(near[i], -(k + 1))[-(k + 1)] if len(ids) > k + 1 else -2
                found = sorted(((-near[i, j], ids[j]) for j in np.nonzero(near[i] >= least)[0].tolist() if ids[j] != key))
                out += [(key, other, -float(s)) for s, other in found[:k]]
        types = (batch_type, batch_type, pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], ["query", "id", "similarity"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(index.rows.schema["id"].dataType)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for batch in batches:
            v = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else []
            for i, (*place, asks, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)):
                if place != at and group:
                    yield best(group)
                    group = []
                at = place
                group.append((asks, key, v[i]))
        if group:
            yield best(group)

    parts = int(index.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = dealt.repartition(parts, "cell", "q", "r").sortWithinPartitions("cell", "q", "r").mapInArrow(walk, f"query {kind}, id {kind}, similarity double")
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

"""Embedding whitening by singular vectors of the centred rows.

Entries are put on an integer grid: x = floor(steps * c) + offset. The model is fitted to each distinct
grid vector once: n of them, with sums S a dimension. A centred row is (n * x - S) / n, whose numerator
is exact; MLlib's ``computeSVD`` takes the centred rows, distributed, and gives singular values s and
right singular vectors. The covariance with divisor n has eigenvalues s * s / n. The total variance
comes from the exact deviations, apart from the decomposition.

The driver holds S, the components and, inside ``computeSVD``, one matrix of dimensions by dimensions.

Cases: a null vector, or one that holds a null or a non-finite entry, gives no row. Vectors of each
length are a space of their own, with its own fit list and components. A component whose eigenvalue is
zero to double precision is left out, so rows that are all alike, a table without rows and empty
vectors give none. Entries of which 64 * c passes 2 ** 62 count as that bound; a deviation that 64 bits
can't hold is null. Repeated rows are rows of their own, fitted once. A null id is kept. Extra columns
of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


@dataclass(frozen=True)
class Whitening:
    """Up to ``components`` components of vectors whose entries have ``steps`` grid steps a unit, shifted by ``offset``."""

    components: int = 16
    steps: int = 64
    offset: int = 1_000_000
    bound: int = 2**62


@dataclass(frozen=True)
class Model:
    """One length's fit: n distinct grid vectors with sums ``sums``; ``axes`` (dimensions by components), their ``values`` (eigenvalues), the ``total`` variance, and ``error``, the whitened fit list's largest difference from unit covariance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    total: float
    error: float = 0.0


def on_grid(df: DataFrame, how: Whitening, key: str, vector: str) -> DataFrame:
    """``_key, x``: the rows whose vectors are whole, on the grid."""
    whole = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    inside = lambda c: F.greatest(F.least(F.floor(c * how.steps), F.lit(how.bound)), F.lit(-how.bound))
    return rows.where(F.col("v").isNotNull() & F.forall("v", whole)).select("_key", F.transform("v", lambda c: inside(c) + how.offset).alias("x"))


def _grid(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in 64 bits where they hold it, else in Python's integers."""
    largest = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if n * largest + max(map(abs, sums), default=0) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squared(d: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact."""
    largest = max(abs(int(d.max())), abs(int(d.min()))) if d.size else 0
    if d.dtype != object and largest * largest * d.shape[1] < 2**62:
        return (d * d).sum(axis=1).tolist()
    return [sum(int(v) * int(v) for v in row) for row in d]


def grid_sums(rows: DataFrame, dims: int) -> list[int]:
    """The sum of each dimension: a row a dimension and task is merged, the driver gets one a dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * dims
        for batch in batches:
            if batch.num_rows:
                x = _grid(batch.column(0), dims)
                small = max(abs(int(x.max())), abs(int(x.min()))) * len(x) < 2**62
                totals = [a + int(b) for a, b in zip(totals, (x if small else x.astype(object)).sum(axis=0), strict=True)]
        # as two halves, so that sums of any size are exact
        high, low = [t >> 40 for t in totals], [t & (1 << 40) - 1 for t in totals]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["at", "high", "low"])

    parts = rows.select("x").mapInArrow(add, "at int, high bigint, low bigint")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = {r["at"]: (int(r["high"]) << 40) + int(r["low"]) for r in parts.groupBy("at").agg(exact("high"), exact("low")).collect()}
    return [found.get(i, 0) for i in range(dims)]


def total_deviation(rows: DataFrame, dims: int, n: int, sums: list[int]) -> float:
    """The sum of the exact squared deviations of all rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(squared(deviations(_grid(b.column(0), dims), n, sums))) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([float(total)])], ["total"])

    return rows.select("x").mapInArrow(add, "total double").agg(F.sum("total")).first()[0] or 0.0


def centred(rows: DataFrame, dims: int, n: int, sums: list[int]) -> DataFrame:
    """``c``: the centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = deviations(_grid(batch.column(0), dims), n, sums).astype(np.float64) / n
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.list_(pa.float64()))], ["c"])

    return rows.select("x").mapInArrow(run, "c array<double>")


def whitened(x: np.ndarray, model: Model) -> tuple[np.ndarray, list[int]]:
    """Rows projected on the components and scaled to unit variance, and their squared deviations."""
    d = deviations(x, model.n, model.sums)
    return d.astype(np.float64) / model.n @ model.axes / np.sqrt(model.values), squared(d)


def identity_error(rows: DataFrame, dims: int, model: Model) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, divisor n; whitened rows are centred."""
    k = len(model.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((k, k))
        for batch in batches:
            w, _ = whitened(_grid(batch.column(0), dims), model)
            products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(products.ravel())], ["at", "product"])

    got = rows.select("x").mapInArrow(add, "at int, product double").groupBy("at").agg(F.sum("product").alias("product")).collect()
    covariance = np.zeros(k * k)
    for r in got:
        covariance[r["at"]] = r["product"] / model.n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())


def fit(distinct: DataFrame, dims: int, how: Whitening = Whitening()) -> Model | None:
    """The model of distinct grid vectors ``x`` of one length; None if nothing varies."""
    n = distinct.count()
    sums = grid_sums(distinct, dims)
    total = total_deviation(distinct, dims, n, sums) / n**3  # squares have n * n in them
    if not total > 0:
        return None
    vectors = MLUtils.convertVectorColumnsFromML(centred(distinct, dims, n, sums).select(array_to_vector("c").alias("c")), "c")
    # All components of up to 15,000 dimensions: then MLlib decomposes the Gramian directly, to double precision.
    k = dims if dims <= 15_000 else min(dims, how.components)
    svd = RowMatrix(vectors, n, dims).computeSVD(k, rCond=float(np.sqrt(dims * np.finfo(float).eps)))
    values = np.array(svd.s.toArray())[: how.components] ** 2 / n
    model = Model(n, sums, svd.V.toArray()[:, : len(values)].copy(), values, total)
    return Model(n, sums, model.axes, values, total, identity_error(distinct, dims, model))


def transformed(rows: DataFrame, dims: int, model: Model, key: str) -> DataFrame:
    """A row a vector and component."""
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, squares = whitened(_grid(batch.column(1), dims), model)
            deviation = pa.array([s if s < 2**63 else None for s in squares], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.array(list(w), pa.list_(pa.float64()))], ["_key", "deviation", "w"])

    each = rows.select("_key", "x").mapInArrow(run, f"_key {kind}, deviation bigint, w array<double>")
    share = F.array(*(F.lit(float(v / model.total)) for v in model.values))
    out = each.select("_key", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        F.col("_key").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(model.error).alias("identity_error")
    )


def whiten(df: DataFrame, how: Whitening = Whitening(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: the whitened coordinates of every row, fitted to the distinct vectors of all rows."""
    rows = on_grid(df, how, key, vector)
    distinct = staged(rows.select("x").distinct(), "fit_list")
    lengths = sorted(r[0] for r in distinct.select(F.size("x")).distinct().collect())
    several = len(lengths) > 1
    of = lambda d, dims: d.where(F.size("x") == dims) if several else d
    found = [transformed(of(rows, dims), dims, model, key) for dims in lengths if dims and (model := fit(of(distinct, dims), dims, how))]
    if not found:
        none = Model(0, [], np.zeros((0, 0)), np.zeros(0), 1.0)
        found = [transformed(rows.where("false"), 0, none, key)]
    return reduce(DataFrame.unionByName, found)

"""Helpers the corpus operators share: durable staging, id ranges, Feistel permutations."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch holds; documents are long, so far fewer than Spark's 10,000. Functions take
#: Arrow arrays, not pandas, which would cost each worker 46 MB.
ARROW_ROWS = 512
MIN_LONG = -(2**63)


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by rows unless the session already sets something smaller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``; a temporary one if unset, where all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quernstone-"))
        root = context._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends."""
    path = f"{shared_root(spark)}/quernstone/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be gone when the interpreter ends
        return


_files: set[tuple[str, str]] = set()


def ship_file(spark: SparkSession, path: str) -> None:
    """Send a file of the driver to the executors, once an application; ``local_file`` finds it there."""
    context = spark.sparkContext
    if not context.master.startswith("local") and (context.applicationId, path) not in _files:
        _files.add((context.applicationId, path))
        context.addFile(path)


def local_file(path: str) -> str:
    """Where a task finds a file: at its path, or where ``ship_file`` put it."""
    from pyspark import SparkFiles

    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut durably. In zstd, as texts lie there twice or more."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """Ascending cut points splitting ``column`` (long, nulls lowest) into about equal ranges; an id that fills several ranges comes as often.

    The driver gets at most ``parts - 1`` numbers.
    """
    if parts < 2:
        return []
    fractions = [i / parts for i in range(1, parts)]
    key = F.coalesce(F.col(f"`{column}`").cast("long"), F.lit(MIN_LONG))
    row = df.agg(F.percentile_approx(key, fractions, max(10_000, 20 * parts)).alias("q")).first()
    return sorted(row["q"] or [])


def range_of(bounds: list[int]):
    """Arrow function: the range of an id and a hash. Ids of a range that ends where another starts are told by the id; an id of several ranges is cut by its hash."""
    ids, times = np.unique(np.array(bounds, dtype=np.int64), return_counts=True)
    ahead = np.concatenate(([0], np.cumsum(times)))

    @F.arrow_udf("int")
    def number(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        key, hash_ = keys.to_numpy(zero_copy_only=False), hashes.to_numpy(zero_copy_only=False)
        at = np.searchsorted(ids, key, side="left")
        out = ahead[at]
        hit = at < len(ids)
        hit[hit] = ids[at[hit]] == key[hit]
        share = (hash_[hit].astype(np.float64) + 2.0**63) / 2.0**64
        out[hit] += 1 + np.minimum((share * times[at[hit]]).astype(np.int64), times[at[hit]] - 1)
        return pa.array(out.astype(np.int32))

    return number


def with_columns(df: DataFrame, column: str, more: str, names: list[str], types: list[pa.DataType], rows) -> DataFrame:
    """``df`` with further columns (DDL ``more``) that ``rows`` derives from one column.

    ``rows()`` gives a function from a batch's values to a list of tuples, made once a task. A map
    over Arrow batches: all operators share one kind of Python worker, and so its memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        derive = rows()
        for batch in batches:
            got = derive(batch.column(batch.schema.get_field_index(column)).to_pylist())
            added = [pa.array([r[i] for r in got], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    kept = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kept}, {more}")


def scanned(items: str, zero: Column, after: Callable, out: Callable, kind: str) -> Column:
    """``out(state, x)`` of each item of an array column from the left; the state after it is ``after(state, x)``.

    Arrays can't grow in place, so each step copies what its block has put out: that is numbers (of
    type ``kind``), to be zipped with the items, and blocks of about the square root of the number of
    items keep it short. ``items`` is a column, as an expression would be evaluated anew for each block.
    """
    n = F.size(items)
    side = F.ceil(F.sqrt(n)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / side).cast("int") - 1), lambda b: F.slice(items, b * side + 1, side))
    none = lambda t: F.array().cast(t)

    def block(seen: Column, part: Column) -> Column:
        start = F.struct(seen["state"].alias("state"), none(f"array<{kind}>").alias("out"))
        step = lambda s, x: F.struct(after(s["state"], x).alias("state"), F.array_append(s["out"], out(s["state"], x)).alias("out"))
        return F.aggregate(part, start, step, lambda s: F.struct(s["state"].alias("state"), F.array_append(seen["outs"], s["out"]).alias("outs")))

    whole = F.struct(zero.alias("state"), none(f"array<array<{kind}>>").alias("outs"))
    return F.when(n > 0, F.aggregate(blocks, whole, block, lambda s: F.flatten(s["outs"]))).otherwise(none(f"array<{kind}>"))


def _mix(x: np.ndarray, key: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit finaliser of ``x`` xor ``key``."""
    with np.errstate(over="ignore"):
        z = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _half(size: np.ndarray) -> np.ndarray:
    """Half of the smallest even number of bits, two at least, that holds each ``size - 1``."""
    top, bits = np.maximum(size, np.uint64(2)) - np.uint64(1), np.zeros(size.shape, np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        more = (top >> np.uint64(step)) > 0
        bits[more] += np.uint64(step)
        top = np.where(more, top >> np.uint64(step), top)
    return (bits + np.uint64(2)) // np.uint64(2)


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Keyed bijection of ``range(size)``: a balanced Feistel network with cycle-walking.

    The network works on the smallest even number of bits that holds ``size``, so fewer than four
    applications are expected before an index falls inside the range again. All arguments are
    arrays of one length (or scalars); ``index < size``, which is at most 2 ** 62.
    """
    index = np.asarray(index, np.uint64)
    size = np.broadcast_to(np.asarray(size, np.uint64), index.shape)
    key = np.broadcast_to(np.asarray(key, np.uint64), index.shape)
    half = _half(size)
    out = index.copy()
    todo = np.arange(len(out))
    while len(todo):
        h, k = half[todo], key[todo]
        mask = (np.uint64(1) << h) - np.uint64(1)
        left, right = out[todo] >> h, out[todo] & mask
        for i in range(rounds):
            salt = _mix(k, np.uint64(i + 1))
            left, right = right, left ^ (_mix(right, salt) & mask)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def unpermuted(place: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """The inverse of ``permuted``."""
    place = np.asarray(place, np.uint64)
    size = np.broadcast_to(np.asarray(size, np.uint64), place.shape)
    key = np.broadcast_to(np.asarray(key, np.uint64), place.shape)
    half = _half(size)
    out = place.copy()
    todo = np.arange(len(out))
    while len(todo):
        h, k = half[todo], key[todo]
        mask = (np.uint64(1) << h) - np.uint64(1)
        left, right = out[todo] >> h, out[todo] & mask
        for i in range(rounds - 1, -1, -1):
            salt = _mix(k, np.uint64(i + 1))
            left, right = right ^ (_mix(left, salt) & mask), left
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)

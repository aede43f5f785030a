"""Derived tables stored once an application, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_kept: dict[tuple, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one if unset, where all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    key = (spark.sparkContext.applicationId, "root")
    if key not in _kept:
        _kept[key] = tempfile.mkdtemp(prefix="quernstone-")
        atexit.register(_removed, spark, _kept[key])
    return _kept[key]


def _removed(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be gone when the interpreter ends
        return


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read back: computed once, and its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/quernstone/{name}-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, name: str, column: str, tasks: int | None = None) -> DataFrame:
    """As ``staged``, in one folder a value of a column, each written by one of so many tasks: a reader of some values skips the rest."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/quernstone/{name}-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, path)
    (df.repartition(tasks, column) if tasks else df.repartition(column)).write.option("compression", "zstd").partitionBy(column).parquet(path)
    last = [c for c in df.columns if c != column] + [column]
    return spark.read.schema(df.select(*last).schema).parquet(path).select(*df.columns)


def _at(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _at(spark, path)
    return system.exists(target)


def dropped(spark: SparkSession, path: str) -> None:
    target, system = _at(spark, path)
    system.delete(target, True)


def child_folders(spark: SparkSession, path: str) -> list[str]:
    target, system = _at(spark, path)
    return [x.getPath().getName() for x in system.listStatus(target) if x.isDirectory()] if system.exists(target) else []


def file_marks(spark: SparkSession, path: str) -> tuple:
    """Path, size and time of each file of a table: what tells whether it was written anew."""
    target, system = _at(spark, path)
    found, files = [], system.listFiles(target, True)
    while files.hasNext():
        x = files.next()
        found.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return tuple(sorted(found))


def stored(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of ``make``, written at the first call for a key in an application and read from then on.

    A key names the columns that it is made of and the source with ``file_marks``, so that of a source
    that was written anew nothing old is read.
    """
    full = (spark.sparkContext.applicationId, *key)
    if full not in _kept:
        path = f"{shared_root(spark)}/quernstone/stored-{uuid.uuid4().hex}"
        make().write.parquet(path)
        atexit.register(_removed, spark, path)
        _kept[full] = path
    return spark.read.parquet(_kept[full])

"""Entry points of packages, from their manifests."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members that name files, in order, and the kind of entry each gives.
MEMBERS = (("main", "manifest"), ("browser", "manifest"), ("bin", "bin"), ("exports", "manifest"))


def _strings(value) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from _strings(v)


def entry_points(manifest: str) -> list[tuple[str, str]]:
    """Path and kind of each file a JSON manifest names; of repeats the first kind counts. Empty if it is invalid."""
    try:
        package = json.loads(manifest)
    except (TypeError, ValueError):
        return []
    found: dict[str, str] = {}
    for member, kind in MEMBERS:
        for path in _strings(package.get(member)) if isinstance(package, dict) else ():
            path = re.sub(r"^(?:\./|/+)", "", path.strip())
            if path:
                found.setdefault(path, kind)
    return list(found.items())


def manifest_entries(files: DataFrame) -> DataFrame:
    """``repo, file_path, kind`` of the files that the package.json of each repository names."""

    @F.arrow_udf("array<struct<path:string,kind:string>>")
    def entries(contents: pa.Array) -> pa.Array:
        found = [[{"path": p, "kind": k} for p, k in entry_points(x)] for x in contents.to_pylist()]
        return pa.array(found, pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string())])))

    manifests = files.where(F.col("file_path") == "package.json")
    return manifests.select("repo", F.explode(entries("content")).alias("e")).select("repo", F.col("e.path").alias("file_path"), F.col("e.kind"))


def entry_kind(symbols: DataFrame, manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with ``entry_kind``: public-api if exported, else manifest or bin of their file, else shebang, else null."""
    first = files.where(F.col("content").startswith("#!")).select("repo", "file_path", F.lit(True).alias("_shebang"))
    named = manifests.groupBy("repo", "file_path").agg(F.min("kind").alias("_manifest"))
    met = symbols.join(named, ["repo", "file_path"], "left").join(first, ["repo", "file_path"], "left")
    kind = F.when(F.col("exported"), "public-api").when(F.col("_manifest").isNotNull(), F.col("_manifest")).when(F.col("_shebang"), "shebang")
    return met.withColumn("entry_kind", kind).drop("_manifest", "_shebang")

"""Document fingerprints: a canonical exact digest.

The canonical form of a text is its NFKC normalisation, case-folded and normalised again, with each
run of white space one space and none at the ends. Its 128-bit xxh3 digest is the fingerprint.
Inside a bucket of equal digests rows are grouped by their canonical bytes themselves, so a collision
never joins two texts; partial groups in each task leave one row a task of a hot bucket.

Cases: a null text counts as empty, and empty texts share one fingerprint. A null key orders
first. Rows with equal keys are taken in the order of a hash of their texts, then of the texts; an id
that fills several ranges is cut by that hash. Texts of any length are read whole. An empty table
gives an empty result. With one row, the next document is the row itself. Extra columns of any name are
ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import MIN_LONG, id_bounds, n_partitions, range_of, staged, tune


def canonical(text: str | None) -> bytes:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8")


def digest(form: bytes) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(form)


def fingerprinted(text: Column) -> Column:
    """The text's fingerprint, 32 hexadecimal digits."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([digest(canonical(x)) for x in texts.to_pylist()], pa.string())

    return of(F.coalesce(text, F.lit("")))


def formed(text: Column) -> Column:
    """The text's canonical bytes."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([canonical(x) for x in texts.to_pylist()], pa.binary())

    return of(F.coalesce(text, F.lit("")))


#: Rows of a bucket that meet its groups in one task.
SALT_ROWS = 10_000


def named_groups(rows: DataFrame) -> DataFrame:
    """``rows`` (``key, fingerprint, form`` and more) without form, with ``group_id``: the smallest key of rows with the same bytes.

    Groups are formed on the bytes. Rows then meet their bucket's group by the digest alone, salted by
    the bucket's size; only where a bucket holds several groups, by the bytes too.
    """
    groups = staged(rows.groupBy("fingerprint", "form").agg(F.min("key").alias("group_id"), F.count("*").alias("n")), "groups")
    buckets = groups.groupBy("fingerprint").agg(F.count("*").alias("several"), F.sum("n").alias("n"), F.first("group_id").alias("group_id"))
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    single = buckets.where("several = 1").select("fingerprint", "group_id", salts.alias("salts"))
    hot = staged(single.where("salts > 1").select("fingerprint", "salts"), "hot")  # at most a row for SALT_ROWS rows
    apart = groups.join(buckets.where("several > 1").select("fingerprint"), "fingerprint", "left_semi").select("fingerprint", "form", "group_id")
    slim = [c for c in rows.columns if c != "form"]
    spread = single.select("fingerprint", "group_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    known = rows.select(*slim).join(hot, "fingerprint", "left")
    salted = known.withColumn("salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    met = salted.join(spread, ["fingerprint", "salt"]).drop("salt").select(*slim, "group_id")
    if apart.isEmpty():
        return met
    return met.unionByName(rows.join(apart, ["fingerprint", "form"]).select(*slim, "group_id"))


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fingerprint`` and ``group_id``: the smallest key among rows with the same canonical form."""
    tune(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").alias("key"), fingerprinted(F.col(f"`{text}`")).alias("fingerprint"), formed(F.col(f"`{text}`")).alias("form"))
    return named_groups(rows).select(F.col("key").alias(key), "fingerprint", "group_id")


_DEALT = ("at", "tail", "order", "tie", "kind", "key", "text")


def dealt(df: DataFrame, shared: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows dealt by ranges of key and tie, and sorted, for use in one pass a task; columns of _DEALT.

    ``tie`` is a hash of the text. The first row of each range appears once more with ``tail`` true at
    the end of the range before it (the first of all after the last of all). Rows of ``shared``
    (order, tie) come with kind 0 before the texts, of kind 1, that they are about. Only the bounds and
    each range's smallest key and tie come to the driver.
    """
    spark = df.sparkSession
    parts = n_partitions(spark)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(MIN_LONG)).alias("order"), F.xxhash64(body).alias("tie"), F.lit(1).alias("kind"), F.col(f"`{key}`").cast("long").alias("key"), body.alias("text"))
    bounds = id_bounds(df, key, parts)
    number = range_of(bounds)
    ids = rows.select("order", "tie").withColumn("at", number("order", "tie"))
    firsts = sorted((r["at"], tuple(r["first"])) for r in ids.groupBy("at").agg(F.min(F.struct("order", "tie")).alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    @F.arrow_udf("int")
    def tail(order: pa.Array, tie: pa.Array) -> pa.Array:
        return pa.array([before.get(x) for x in zip(order.to_pylist(), tie.to_pylist(), strict=True)], pa.int32())

    if shared is not None:
        rows = rows.unionByName(shared.select("order", "tie", F.lit(0).alias("kind")), allowMissingColumns=True)
    places = rows.withColumn("at", number("order", "tie")).withColumn("to", F.when(F.col("kind") == 1, tail("order", "tie")))
    own, extra = F.struct(F.col("at"), F.lit(False).alias("tail")), F.struct(F.col("to").alias("at"), F.lit(True).alias("tail"))
    spread = places.withColumn("place", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, extra))))
    found = spread.select("place.at", "place.tail", "order", "tie", "kind", "key", "text").repartitionById(len(bounds) + 1, F.col("at"))
    return found.sortWithinPartitions("at", "tail", "order", "tie", "kind", "text")


_REPORT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_report(df: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """A row a document: its fingerprint, its edited text's, and their likeness (1.0: same canonical bytes, else 0.0).

    With ``shared`` (order, tie) also ``form``: the canonical bytes of the documents that it names, else null.
    """
    tune(df.sparkSession)

    def row(key, text: str, form: bytes, own: str, wanted: bool, following: str, after: bytes, its: str) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        changed = canonical(edited)
        print_ = digest(changed)
        return key, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), own, print_, float(print_ == own and changed == form), float(its == own and after == form), form if wanted else None

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done, named = None, None, False, None
        for batch in batches:
            out = []
            for at, tail, order, tie, kind, key, text in zip(*(batch.column(i).to_pylist() for i in range(len(_DEALT))), strict=True):
                if at != now:
                    now, held, done = at, None, False
                if kind == 0:
                    named = (order, tie)
                    continue
                if done:
                    continue
                form = canonical(text)
                own = digest(form)
                if held is not None:
                    out.append(row(*held, text, form, own))
                held, done = (key, text, form, own, named == (order, tie)), tail
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    names = [*(x.split()[0] for x in _REPORT.split(", ")), "form"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary()]
    found = dealt(df, shared).mapInArrow(walk, f"{_REPORT}, form binary")
    return found if shared is not None else found.drop("form")


def grouped_report(df: DataFrame) -> DataFrame:
    """``edit_report`` with ``group_id``: the smallest ``doc_id`` of rows with the same canonical form.

    Digests are counted first. The rows of buckets with more than one are named in the pass that makes
    the report, so texts are moved once, and only the canonical bytes of those rows once more.
    """
    tune(df.sparkSession)
    body = F.coalesce(F.col("text"), F.lit(""))
    prints = staged(df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(MIN_LONG)).alias("order"), F.xxhash64(body).alias("tie"), fingerprinted(F.col("text")).alias("fingerprint")), "prints")
    several = prints.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    shared = prints.join(several, "fingerprint", "left_semi").select("order", "tie").distinct()
    report = staged(edit_report(df, shared), "report")
    found = named_groups(report.where("form IS NOT NULL").withColumnRenamed("doc_id", "key")).withColumnRenamed("key", "doc_id")
    alone = report.where("form IS NULL").drop("form").withColumn("group_id", F.col("doc_id"))
    return alone.unionByName(found)

"""Stored text indexes: trigram postings that prune substring search, and term postings that follow changes.

Trigrams. Texts are stored in parts (folders) of about ``rows`` rows, with the ids of the texts that hold each
distinct three characters, lower-cased: a row a gram, part and batch, sorted by gram in each batch. A substring query reads the postings of
its rarest grams, then only the parts that hold rows with all of them, and verifies these rows on their
whole texts. A query without three characters between wildcards reads everything.

Terms. An ``IndexStore`` holds generations: a base, and deltas with the postings and lengths of rows that
came or changed and the ids that went or changed (tombstones). A row counts if no later generation names
its id, so document frequencies and lengths are always those of the rows there are. Compaction writes
a new base. A generation counts once its marker is written, and a change applied again under its number
replaces itself: a lost job or a restarted stream repeats a step without harm.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import child_folders, dropped, exists, staged, staged_by
from .retrieval import Index, inverted, lengths, packed_postings, repacked, substring, unpacked

# trigrams


@dataclass(frozen=True)
class Trigrams:
    """``texts`` (id, the columns, part), stored by part, ``grams`` (gram, id, part), in order of gram in each batch of texts, and ``counts`` (gram, n), stored by gram."""

    texts: DataFrame
    grams: DataFrame
    counts: DataFrame
    columns: tuple[str, ...]


def grams_of(text: Column) -> Column:
    """The distinct three-character pieces of a text, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def trigram_index(df: DataFrame, columns: list[str], rows: int = 4096, keep: list[str] | None = None) -> Trigrams:
    """The index of some text columns of all rows of ``df`` (with ``id``); ``keep``: further columns stored with the texts."""
    parts = max(1, -(-df.count() // rows))
    placed = df.select("id", *columns, *(keep or [])).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    texts = staged_by(placed, "texts", "part", parts)
    each = texts.select("id", grams_of(F.concat_ws("\n", *columns)).alias("words"), "part")
    grams = staged(inverted(each, "gram", "part").drop("tfs"), "grams")
    counts = staged(grams.groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram"), "gram_counts")
    return Trigrams(texts, grams.select("gram", F.explode("ids").alias("id"), "part"), counts, tuple(columns))


def query_grams(spark: SparkSession, query: str) -> list[str]:
    """Grams that a text with the query must have: of the stretches between wildcards and escapes."""
    pieces = [p for p in re.split(r"\\.|[%_]", query) if len(p) >= 3]
    found = [spark.range(1).select(grams_of(F.lit(p)).alias("g")).first()["g"] for p in pieces]
    return sorted({g for piece in found for g in piece})


def may_hold(index: Trigrams, query: str, most: int = 4) -> DataFrame:
    """The stored rows that hold the rarest ``most`` grams of the query; of other parts nothing is read."""
    wanted = query_grams(index.texts.sparkSession, query)
    if not wanted:
        return index.texts
    known = {r["gram"]: r["n"] for r in index.counts.where(F.col("gram").isin(wanted)).collect()}  # a row a gram of the query
    if len(known) < len(wanted):
        return index.texts.where("false")
    rare = sorted(wanted, key=lambda g: (known[g], g))[:most]
    hits = index.grams.where(F.col("gram").isin(rare)).groupBy("id", "part").agg(F.count("*").alias("n")).where(F.col("n") == len(rare))
    hits = staged(hits.select("id", "part"), "hits")
    parts = [r["part"] for r in hits.select("part").distinct().collect()]  # numbers of parts
    return index.texts.where(F.col("part").isin(parts)).join(hits.select("id"), "id", "left_semi") if parts else index.texts.where("false")


def substring_search(index: Trigrams, query: str) -> DataFrame:
    """The rows of which a column holds the query, without regard to case; as ``substring`` finds them."""
    return may_hold(index, query).where(substring(query, *index.columns)).drop("part")


# terms


class IndexStore:
    """Postings of ``id, body`` rows in a folder, in generations."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def generations(self) -> list[tuple[int, str]]:
        """Numbers and kinds of the generations that count: the last base and the deltas after it."""
        names = sorted(n for n in child_folders(self.spark, self.path) if re.fullmatch(r"\d{12}-(base|delta)", n) and exists(self.spark, f"{self.path}/{n}/done"))
        found = [(int(n[:12]), n[13:]) for n in names]
        first = max((n for n, kind in found if kind == "base"), default=0)
        return [(n, kind) for n, kind in found if n > first or (n == first and kind == "base")]

    def _folder(self, number: int, kind: str) -> str:
        return f"{self.path}/{number:012d}-{kind}"

    def _write(self, number: int, kind: str, parts: dict[str, DataFrame]) -> None:
        folder = self._folder(number, kind)
        dropped(self.spark, folder)  # what a lost attempt of the same step left
        for name, df in parts.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{folder}/done")

    def create(self, rows: DataFrame) -> None:
        self._write(0, "base", {"postings": packed_postings(rows), "lengths": lengths(rows)})

    def apply(self, changed: DataFrame, gone: DataFrame, number: int | None = None) -> int:
        """Rows that came or changed (id, body) and ids that went; ``number`` names the step, so that it may be repeated."""
        known = self.generations()
        number = max((n for n, _ in known), default=-1) + 1 if number is None else number
        if any(n > number or (n == number and kind == "base") for n, kind in known):
            return number  # a later step, or a base that holds this one, is there: this is a repetition
        new = staged(changed.dropDuplicates(["id"]), "changed")
        ids = new.select("id").unionByName(gone.select("id")).distinct()
        self._write(number, "delta", {"postings": packed_postings(new), "lengths": lengths(new), "gone": ids})
        return number

    def _read(self, part: str) -> DataFrame | None:
        out = None
        for n, kind in self.generations():
            if part == "gone" and kind == "base":
                continue
            one = self.spark.read.parquet(f"{self._folder(n, kind)}/{part}")
            one = (unpacked(one) if part == "postings" else one).withColumn("generation", F.lit(n).cast("long"))
            out = one if out is None else out.unionByName(one)
        return out

    def index(self) -> Index:
        """The index of the rows there are: readers see postings and lengths that no later generation replaces."""
        gone = self._read("gone")
        last = None if gone is None else gone.groupBy("id").agg(F.max("generation").alias("_last"))

        def there(df: DataFrame) -> DataFrame:
            if last is None:
                return df.drop("generation")
            met = df.join(last, "id", "left")
            return met.where(F.col("_last").isNull() | (F.col("_last") <= F.col("generation"))).select(*(c for c in df.columns if c != "generation"))

        return Index(there(self._read("postings")), there(self._read("lengths")))

    def compact(self) -> None:
        """All generations as one base, under the number of the last."""
        known = self.generations()
        if len(known) > 1:
            whole = self.index()
            self._write(known[-1][0], "base", {"postings": repacked(whole.postings), "lengths": whole.lengths})


def follow(store: IndexStore, changes: DataFrame, compact_after: int = 16):
    """A stream writer that keeps the store up with ``changes`` (id, body, deleted, version): of an id's changes in a batch the latest version counts."""

    def step(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("id").agg(F.max_by(F.struct("body", "deleted"), "version").alias("m")).select("id", "m.*")
        store.apply(latest.where("NOT deleted").select("id", "body"), latest.where("deleted").select("id"), number + 1)
        if len(store.generations()) > compact_after:
            store.compact()

    return changes.writeStream.foreachBatch(step)

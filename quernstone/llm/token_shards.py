"""Token-ID output in training order.

A text becomes token ids, ended by the end-of-text id, cut into sequences of a fixed length; what is
left at the end of a document is its tail. Sequence j of document d goes to place P_j(d), P_j a keyed
Feistel permutation with cycle-walking of the range of all ids, another one for each j: the order of
(place, j) is a keyed permutation of all sequences, and depends on the documents and the key alone, not
on how the table is split. Equal ranges of places make shards: files of records of one fixed stride.
Whole sequences are records in order of place; tails are joined in that order and make a record
whenever they fill one, so only a shard's last record is filled up. Ids have gaps, so a shard holds
about, not exactly, as many records as asked for, and a record's global slot is the number of records
before it. So tokens are made once and moved once, and no count of them is needed first. A reader
finds slot s by the sizes of the files, resumes there, and reads training order as it reads the files.

A record is a little-endian 32-bit count of real tokens followed by ``length`` 16-bit ids.

Cases: a null or empty text gives the end-of-text id alone. Documents without an id, and rows of an id
that comes more than once, take their places by a hash of the text and the number of the copy, so any
number of them spreads over all shards; copies are counted and numbered, as rows alike are interchangeable.
Sequences of one place are ordered by number, id and a hash of the text.
Extra columns of any name are ignored. An empty table gives no shard. A text of any length spreads over
as many sequences as it needs. A retried task replaces its shard by one with the same bytes. Ids of
65,536 or more raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import local_file, n_partitions, permuted, shared_folder, ship_file, staged, tune


@dataclass(frozen=True)
class Layout:
    """``length`` ids a sequence, about ``shard`` sequences a file, ``key`` of the permutations, ``bytes_a_token``: a guess that sizes the shards; ``task_bytes`` that a task writes."""

    path: str
    pattern: str
    length: int = 512
    shard: int = 4096
    key: int = 0x5EED5EED
    end: int = 50256
    bytes_a_token: float = 2.5
    task_bytes: int = 256 << 20

    @property
    def stride(self) -> int:
        return 4 + 2 * self.length


_encoders: dict = {}


def encoder(layout: Layout):
    """The tokenizer, one a Python worker."""
    if layout.path not in _encoders:
        import tiktoken

        with open(local_file(layout.path), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _encoders[layout.path] = tiktoken.Encoding("own", pat_str=layout.pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[layout.path]


def place_of(offset: np.ndarray, number: np.ndarray, span: int, layout: Layout) -> np.ndarray:
    """Places of sequences ``number`` of the documents at ``offset`` in the range of ids."""
    keys = np.array([int.from_bytes(hashlib.blake2b(f"{layout.key}:{j}".encode(), digest_size=8).digest(), "big") for j in number.tolist()], np.uint64)
    return permuted(offset, span, keys)


COPIES = 1024  # of one row that a task numbers at once


def spread_rows(df: DataFrame) -> DataFrame:
    """``doc_id, text, spread``: the rows; ``spread`` is a hash that places those whose id is null or comes more than once, else null."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    several = staged(rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id")), "several")
    plain = rows.withColumn("spread", F.lit(None).cast("long"))
    if several.isEmpty():
        return plain
    mine = F.col("doc_id").eqNullSafe(F.col("_id"))
    counted = rows.join(several, mine, "left_semi").groupBy("doc_id", "text").count()
    parts = counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(COPIES).cast("long"))))
    dealt = parts.repartition(n_partitions(df.sparkSession), F.xxhash64("doc_id", "text", "first"))
    copies = dealt.withColumn("copy", F.explode(F.sequence(F.col("first"), F.least(F.col("count"), F.col("first") + COPIES) - 1)))
    return plain.join(several, mine, "left_anti").unionByName(copies.select("doc_id", "text", F.xxhash64("text", "doc_id", "copy").alias("spread")))


def sequences(df: DataFrame, layout: Layout, low: int, span: int, shards: int, shift: int = 0) -> DataFrame:
    """``shard, place, number, tie, doc_id, ids`` of each sequence; ids are packed, fewer than ``length`` in a tail."""
    tune(df.sparkSession)
    ship_file(df.sparkSession, layout.path)
    names = ["shard", "place", "number", "tie", "doc_id", "ids"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for key, tie, text, spread in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.append(encoder(layout).encode_to_numpy(text or "", disallowed_special=()), layout.end)
                if int(ids.max()) > 65535:
                    raise ValueError("an id needs more than 16 bits")
                packed, step = ids.astype("<u2").tobytes(), 2 * layout.length
                offset = (key - low >> shift) + 1 if spread is None else spread % span
                for at in range(0, len(packed), step):
                    rows.append((offset, at // step, tie, key, packed[at : at + step]))
                    size += 1
                    if size == 4096:
                        yield sealed(rows)
                        rows, size = [], 0
            yield sealed(rows)

    def sealed(rows: list[tuple]) -> pa.RecordBatch:
        offset, number = (np.array([r[i] for r in rows], np.uint64) for i in (0, 1))
        place = place_of(offset, number, span, layout) if rows else np.zeros(0, np.int64)
        shard = np.minimum((place / span * shards).astype(np.int64), shards - 1)
        columns = [shard, place, number.astype(np.int64), *([r[i] for r in rows] for i in (2, 3, 4))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    rows = spread_rows(df).select("doc_id", F.xxhash64("text").alias("tie"), "text", "spread")
    return rows.mapInArrow(cut, "shard bigint, place bigint, number bigint, tie bigint, doc_id bigint, ids binary")


class Shard:
    """Records of one shard from its sequences in order."""

    def __init__(self, layout: Layout):
        self.layout, self.docs, self.ids = layout, [], b""

    def record(self, ids: bytes) -> bytes:
        end = np.array([self.layout.end], "<u2").tobytes()
        return np.array([len(ids) // 2], "<u4").tobytes() + ids + end * (self.layout.length - len(ids) // 2)

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple[list, int, bytes]]:
        """Documents, number of real tokens and bytes of each record that is complete now."""
        step = 2 * self.layout.length
        if len(ids) == step:
            yield [doc], len(ids) // 2, self.record(ids)
            return
        self.docs.append(doc)
        self.ids += ids
        if len(self.ids) >= step:
            yield list(dict.fromkeys(self.docs)), step // 2, self.record(self.ids[:step])
            self.ids = self.ids[step:]
            self.docs = self.docs[-1:] if self.ids else []

    def last(self) -> Iterator[tuple[list, int, bytes]]:
        if self.ids:
            yield list(dict.fromkeys(self.docs)), len(self.ids) // 2, self.record(self.ids)


def materialise(df: DataFrame, layout: Layout, folder: str | None = None) -> DataFrame:
    """Write the shards at once; return a row a record: where it lies and what it holds.

    Each sequence is shuffled once, to the task of its shard. The driver gets one row: the range of ids
    and the bytes of all texts.
    """
    spark = df.sparkSession
    root = folder or shared_folder(spark, "tokens")
    key = F.col("doc_id").cast("long")
    facts = df.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.sum(F.octet_length("text")).alias("bytes")).first()
    low, span = facts["low"] or 0, (facts["high"] or 0) - (facts["low"] or 0)
    shift = max(0, span.bit_length() - 61)  # of ids spread wider than that, neighbours share a place
    span = (span >> shift) + 2
    shards = max(1, round((facts["bytes"] or 0) / layout.bytes_a_token / layout.length / layout.shard))
    span = max(span, 1024 * shards)  # so that hashed places reach all shards, however few the ids
    found = sequences(df, layout, low, span, shards, shift)
    # how many shards a task writes changes no byte of them
    some = max(1, min(layout.task_bytes // (layout.shard * layout.stride), shards // (4 * n_partitions(spark))))
    dealt = found.repartitionById(-(-shards // some), F.floor(F.col("shard") / some).cast("int")).sortWithinPartitions("shard", "place", "number", "doc_id", "tie")
    names, types = ["doc_ids", "n_tokens", "shard", "record_no", "ids_sha256"], [pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.string()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(root)
        system.create_dir(place, recursive=True)
        shard, out, temporary, count, state = None, None, None, 0, None

        def put(records: Iterator[tuple]) -> list[tuple]:
            nonlocal count
            rows = []
            for keys, real, body in records:
                out.write(body)
                rows.append((keys, real, shard, count, hashlib.sha256(body[4:]).hexdigest()))
                count += 1
            return rows

        def close() -> list[tuple]:
            if out is None:
                return []
            rows = put(state.last())
            out.close()
            target = f"{place}/tokens-{shard:08d}.bin"
            if system.get_file_info(target).type != fs.FileType.NotFound:  # of an attempt that was lost
                system.delete_file(target)
            system.move(temporary, target)
            return rows

        def batched(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            rows = []
            for mine, doc, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "doc_id", "ids")), strict=True):
                if mine != shard:
                    rows += close()
                    shard, count, state = mine, 0, Shard(layout)
                    temporary = f"{place}/.tokens-{shard:08d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary)
                rows += put(state.add(doc, ids))
            yield batched(rows)
        yield batched(close())

    index = staged(dealt.mapInArrow(write, "doc_ids array<bigint>, n_tokens int, shard bigint, record_no bigint, ids_sha256 string"), "token-index")
    # the records before each shard: sums of groups of shards, then of the shards of a group
    counts = index.groupBy("shard").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("shard") / 4096))
    groups = counts.groupBy("group").agg(F.sum("n").alias("n"))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = groups.select("group", ahead(Window.orderBy("group")).alias("base"))  # a row 4,096 shards
    inside = counts.select("group", "shard", ahead(Window.partitionBy("group").orderBy("shard")).alias("inside"))
    first = inside.join(bases, "group").select("shard", (F.col("base") + F.col("inside")).alias("first"))
    met = index.join(first, "shard")
    return met.select("doc_ids", "n_tokens", (F.col("first") + F.col("record_no")).alias("slot"), "shard", (F.col("record_no") * layout.stride).alias("byte_offset"), "ids_sha256")


def read_from(folder: str, layout: Layout, slot: int = 0) -> Iterator[np.ndarray]:
    """The ids of each sequence from a slot on, in training order."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(folder)
    files = sorted((f for f in system.get_file_info(fs.FileSelector(place)) if f.base_name.startswith("tokens-")), key=lambda f: f.base_name)
    for info in files:
        if slot >= info.size // layout.stride:
            slot -= info.size // layout.stride
            continue
        with system.open_input_file(info.path) as file:
            body = file.read_at(info.size - slot * layout.stride, slot * layout.stride)
        slot = 0
        for at in range(0, len(body), layout.stride):
            real = int(np.frombuffer(body, "<u4", 1, at)[0])
            yield np.frombuffer(body, "<u2", real, at + 4)

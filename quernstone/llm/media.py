"""Media columns: content-addressed payloads in tar shards.

Writing: every task streams its rows into tar shards of bounded size in a shared folder. A payload
becomes one 8-bit greyscale PNG (lossless) named by its SHA-256; a payload that a shard holds
already is not stored in it again. Rows carry digest, shard, offset and length, never the bytes.
Reading: metadata columns come from range reads of a header alone (33 bytes); payloads from range
reads of their own bytes, in the order of the index, which is the order of the shards.

The index is dealt by shard and stretch of a shard before it is read by, so a read task has so many
bytes to read, however small the index is.

A task that is retried writes shards of its own name; rows name the shards of the attempt that
succeeded, and the rest is garbage that no row names.

Cases: a null text counts as empty; an empty payload becomes one block of 576 bytes 255. Equal
texts, repeated rows among them, have equal digests, stored forms and features, whatever their shards.
A payload of any length is one image of 576 columns. An empty table writes no shard and gives an empty
result. Extra columns of any name are ignored. Bytes that no longer match their digest raise ValueError.
"""

from __future__ import annotations

import binascii
import hashlib
import math
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_folder, staged, tune

BLOCK = 576
HEADER = 33
INDEX = "n_bytes bigint, payload_bytes bigint, digest string, shard string, offset bigint, length bigint"


@dataclass(frozen=True)
class Shards:
    """``shard_bytes``: size after which a task starts its next shard; ``level``: PNG compression; ``read_bytes`` that a task reads back."""

    shard_bytes: int = 256 << 20
    level: int = 1
    read_bytes: int = 16 << 20


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", binascii.crc32(kind + body))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """A greyscale image, 8 bits a sample, 576 columns: a sample a byte."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    lines = np.zeros((len(rows), BLOCK + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", BLOCK, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first 33 bytes."""
    if len(head) < HEADER or head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR":
        raise ValueError("no PNG header here")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def from_png(stored: bytes) -> bytes:
    """The samples of an image that ``to_png`` made."""
    width, height, _ = png_header(stored)
    at, body = 8, []
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        part = stored[at + 8 : at + 8 + size]
        if binascii.crc32(kind + part) != struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk of the image is damaged")
        if kind == b"IDAT":
            body.append(part)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


class _Writer:
    """Appends members to one tar shard after another through an Arrow file system."""

    def __init__(self, folder: str, part: int, how: Shards):
        from pyarrow import fs

        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.folder, self.name, self.how, self.number = folder, f"shard-{part:06d}-{uuid.uuid4().hex[:12]}", how, 0
        self.system.create_dir(self.root, recursive=True)
        self.out, self.at, self.seen = None, 0, {}

    def add(self, payload: bytes) -> tuple[str, str, int, int]:
        digest = hashlib.sha256(payload).hexdigest()
        if digest in self.seen:
            return digest, *self.seen[digest]
        if self.out is None or self.at >= self.how.shard_bytes:
            self.close()
            self.shard = f"{self.name}-{self.number:04d}.tar"
            self.out = self.system.open_output_stream(f"{self.root}/{self.shard}")
            self.number, self.at, self.seen = self.number + 1, 0, {}
        stored = to_png(payload, self.how.level)
        member = tarfile.TarInfo(f"{digest}.png")
        member.size = len(stored)
        self.out.write(member.tobuf(tarfile.USTAR_FORMAT) + stored + b"\0" * (-len(stored) % 512))
        self.seen[digest] = (f"{self.folder}/{self.shard}", self.at + 512, len(stored))
        self.at += 512 + len(stored) + -len(stored) % 512
        return digest, *self.seen[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()


def write_shards(df: DataFrame, folder: str, how: Shards = Shards(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of the stored payloads: ``key`` and the columns of INDEX, one row a row of ``df``.

    Lazy: each evaluation writes the shards anew, so store the result (``staged``) before use.
    """
    tune(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = _Writer(folder, TaskContext.get().partitionId(), how)
        for batch in batches:
            rows = []
            for body in batch.column(1).to_pylist():
                payload = padded(body)
                digest, shard, offset, length = writer.add(payload)
                rows.append((len((body or "").encode("utf-8")), len(payload), digest, shard, offset, length))
            columns = [pa.array(x) for x in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"])
        writer.close()

    return df.select(key, text).mapInArrow(write, f"key {kind}, {INDEX}").withColumnRenamed("key", key)


class _Reader:
    def __init__(self):
        self.path, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        from pyarrow import fs

        if shard != self.path:
            if self.file is not None:
                self.file.close()
            system, path = fs.FileSystem.from_uri(shard)
            self.path, self.file = shard, system.open_input_file(path)
        return self.file.read_at(length, offset)


def _joined(batch: pa.RecordBatch, names: list[str], rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])


def with_header(index: DataFrame) -> DataFrame:
    """``index`` with ``width``, ``height`` and ``bits``, from range reads of the headers alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            at = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset")), strict=True)
            rows = [png_header(reader.read(shard, offset, HEADER)) for shard, offset in at]
            yield _joined(batch, ["width", "height", "bits"], rows, [pa.int32()] * 3)

    return index.mapInArrow(read, f"{_ddl(index)}, width int, height int, bits int")


def feature_of(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit hash of which of 64 stretches are brighter than the mean."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    n = len(samples)
    total, squares = int(counts @ np.arange(256)), int(counts @ np.arange(256) ** 2)
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    sums = np.add.reduceat(samples.astype(np.int64), np.arange(64) * n // 64)
    sizes = np.diff(np.append(np.arange(64) * n // 64, n))
    bits = 0
    for one in sums * n > total * sizes:
        bits = bits * 2 + int(one)
    return f"{total / n:.4f}:{math.sqrt(max(0.0, squares / n - (total / n) ** 2)):.4f}:{entropy:.4f}:{bits:016x}"


def with_payload_features(index: DataFrame) -> DataFrame:
    """``index`` with what the stored bytes, read back, say: digests, checksums and ``feature``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            rows = []
            for shard, offset, length, digest in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length", "digest")), strict=True):
                stored = reader.read(shard, offset, length)
                payload = from_png(stored)
                found = hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"{shard} at {offset}: the bytes don't match their digest")
                rows.append((found, binascii.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload)))
            yield _joined(batch, ["payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], rows, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])

    return index.mapInArrow(read, f"{_ddl(index)}, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def media_columns(df: DataFrame, how: Shards = Shards(), key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Store every text of ``df``; return the index with header metadata. Writes at once."""
    spark = df.sparkSession
    index = staged(write_shards(df, folder or shared_folder(spark, "media"), how, key, text), "media-index")
    return with_header(dealt(index, how))


def dealt(index: DataFrame, how: Shards = Shards()) -> DataFrame:
    """The index with the rows of each stretch of a shard in one task, in order; repeated payloads lie in one place and are read in one."""
    size = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(1, -(-size // how.read_bytes))
    stretch = F.floor(F.col("offset") / how.read_bytes)
    return index.repartition(tasks, "shard", stretch).sortWithinPartitions("shard", "offset")


def media_report(df: DataFrame, how: Shards = Shards()) -> DataFrame:
    """A row a document: sizes, digests and features of what was stored and read back."""
    found = with_payload_features(media_columns(df, how))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", F.col("bits").alias("bits_per_sample"), "shard", "offset", "length")

"""Near-duplicate documents by SimHash fingerprints and the general pigeonhole principle.

A fingerprint bit is set if it is set in over half of the hashes of a text's word shingles, repeats
included. Fingerprints that differ in at most ``distance`` bits are linked. The 64 bits are cut into
parts, correlated bits together, and each part i gets a threshold t_i of -1 or more, where the t_i + 1
sum to distance + 1: then two linked fingerprints differ by at most t_i bits in some part i. A
fingerprint stands at home in the bucket of its value of a part and visits those of the values that
differ by up to t_i bits; pairs with one side at home are verified. The thresholds come from dynamic
programming: a part's cost at a threshold is the rows it puts out and the pairs that it is estimated to
compare, from the collisions counted over all fingerprints and the bits' frequencies. A part whose
values are common gets a lower threshold, -1 (not probed) if need be.

Copies are one fingerprint. A bucket is compared in one task by walking from linked fingerprint to
linked fingerprint, so g members give at most g - 1 links. A bucket of more than ``block`` members is
first cut again: its pairs differ by at most ``distance`` bits in the bits not yet used, so one of
distance + 1 parts of those is equal; this is repeated until buckets are small. Nothing is left out.

The driver holds counts of the 64 bits and of their pairs, and the thresholds.

Cases: a null or empty text, or one without words, has the fingerprint zero and is linked like any
other. With fewer words than a shingle has, the whole sequence is the one shingle. Texts of any length
are read whole; an empty table gives an empty result. Repeated rows, and texts that tie, share a
fingerprint. A null id is a row of its class and never the smallest; ``component_id`` is null where no
id is reached. Extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import components
from .shared import n_partitions, staged, tune

BITS = 64


@dataclass(frozen=True)
class Hashing:
    """Shingles of ``words`` words, hashed with ``seed``; links of up to ``distance`` bits; buckets of more than ``block`` members are cut again; a row counts as ``row`` comparisons in the choice of thresholds."""

    words: int = 3
    distance: int = 3
    seed: int = 42
    block: int = 8192
    row: float = 50.0


def fingerprint(text: bytes, how: Hashing) -> int:
    """The fingerprint of a UTF-8 text, unsigned."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    n = len(words) - how.words + 1
    if not words:
        return 0
    counts, total = np.zeros(BITS, np.int64), max(1, n)
    for at in range(0, total, 1 << 16):
        parts = [b" ".join(words[i : i + how.words]) for i in range(at, min(at + (1 << 16), total))]
        hashes = np.array([xxhash.xxh64_intdigest(p, how.seed) for p in parts], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.nonzero(2 * counts > total)[0]))


def fingerprints(df: DataFrame, how: Hashing = Hashing(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_key, fp``: the fingerprint of every row as a signed number."""
    tune(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or b"", how) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["_key", "fp"])

    return df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("binary").alias("_body")).mapInArrow(run, f"_key {kind}, fp bigint")


def _bits(column: pa.Array) -> np.ndarray:
    """Fingerprints of a column, a row of 64 bits each."""
    return np.unpackbits(column.to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both bits of each pair set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            bits = _bits(batch.column(0)).astype(np.float32)
            both += np.rint(bits.T @ bits).astype(np.int64)  # a batch has fewer rows than a float counts exactly
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), pa.array([n] * BITS, pa.int64()), pa.array(both.tolist(), pa.list_(pa.int64()))], ["at", "n", "both"])

    each = fps.select("fp").mapInArrow(run, "at int, n bigint, both array<bigint>")
    found = each.groupBy("at").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("both")[i]) for i in range(BITS))).alias("both")).orderBy("at").collect()
    return (found[0]["n"], np.array([r["both"] for r in found], np.float64)) if found else (0, np.zeros((BITS, BITS)))


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` parts of about equal size: each part grows by the bit that is most correlated with it."""
    ones = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    like = np.abs((both / max(n, 1) - np.outer(ones, ones)) / np.outer(spread, spread))
    np.fill_diagonal(like, 0)
    left, out = list(range(BITS)), []
    for i in range(parts):
        size = -(-len(left) // (parts - i))
        own = [max(left, key=lambda b: (like[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            best = max(left, key=lambda b: (like[b, own].mean(), -b))
            own.append(best)
            left.remove(best)
        out.append(sorted(own))
    return out


def within(ones: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """The chance that two fingerprints differ by at most 0..most of some bits, were these independent."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for b in bits:
        differ = 2 * ones[b] * (1 - ones[b])
        chance[1:] = chance[1:] * (1 - differ) + chance[:-1] * differ
        chance[0] *= 1 - differ
    return np.cumsum(chance)


def part_costs(n: int, ones: np.ndarray, bits: list[int], how: Hashing, collisions: float | None = None) -> list[float]:
    """A part's cost at the thresholds -1, 0 .. distance; ``collisions``: pairs of equal values, where counted."""
    near = within(ones, bits, how.distance)
    pairs = n * (n - 1) / 2
    scale = 1.0 if collisions is None else max(collisions, 1.0) / max(pairs * near[0], 1e-300)
    costs, rows = [0.0], 0
    for t in range(how.distance + 1):
        rows += comb(len(bits), t)
        costs.append(how.row * n * rows + min(pairs, pairs * near[t] * scale))
    return costs


def allocated(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """The thresholds of least total cost whose t + 1 sum to distance + 1, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for more in range(distance + 2 - used):
                x = (cost + own[more], [*chosen, more - 1])
                if used + more not in after or x < after[used + more]:
                    after[used + more] = x
        best = after
    return best[distance + 1]


def _mask(bits) -> int:
    return sum(1 << int(b) for b in bits)


def _bucket(values: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """A bucket's number. Buckets that share one are compared together, which adds no link."""
    with np.errstate(over="ignore"):
        x = (values ^ np.asarray(salt, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def signatures(fps: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """``part, bucket, fp, home, free``: the buckets of each fingerprint; ``free`` has the bits that a bucket leaves open."""
    whole = (1 << BITS) - 1
    probes = []
    for i, (bits, most) in enumerate(zip(parts, thresholds, strict=True)):
        flips = [_mask(c) for t in range(most + 1) for c in combinations(bits, t)]
        if flips:
            probes.append((i, _mask(bits), np.array(flips, np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i, mask, flips in probes:
                step = max(1, (1 << 18) // len(flips))
                for at in range(0, len(fp), step):
                    own = fp[at : at + step]
                    values = ((own & np.uint64(mask))[:, None] ^ flips).ravel()
                    n = len(values)
                    home = np.tile(np.arange(len(flips)) == 0, len(own))
                    free = np.full(n, whole & ~mask, np.uint64)
                    yield _rows(np.full(n, i, np.int32), _bucket(values, mask), np.repeat(own, len(flips)), home, free)

    return fps.select("fp").mapInArrow(run, SIGNATURE)


SIGNATURE = "part int, bucket bigint, fp bigint, home boolean, free bigint"


def _rows(part: np.ndarray, bucket: np.ndarray, fp: np.ndarray, home: np.ndarray, free: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part), pa.array(bucket.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(home), pa.array(free.view(np.int64))], ["part", "bucket", "fp", "home", "free"])


def cut_again(members: DataFrame, distance: int) -> DataFrame:
    """Members of large buckets in buckets of more bits: of each of distance + 1 parts of the bits left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, fp, free = (batch.column(i).to_numpy().view(np.uint64) for i in (1, 2, 4))
            home = batch.column(3).to_numpy(zero_copy_only=False)
            for left in np.unique(free):
                some = free == left
                bits = [b for b in range(BITS) if int(left) >> b & 1]
                for i in range(distance + 1):
                    mask = _mask(bits[i :: distance + 1])
                    inside = _bucket(fp[some] & np.uint64(mask), bucket[some] ^ np.uint64(i + 1))
                    yield _rows(np.full(len(inside), i, np.int32), inside, fp[some], home[some], np.full(len(inside), int(left) & ~mask, np.uint64))

    return members.select("part", "bucket", "fp", "home", "free").mapInArrow(run, SIGNATURE)


def forest(fps: np.ndarray, home: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links (places) that join what is linked in a bucket, at most one fewer than its members."""
    first, second = [], []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            at = stack.pop()
            near = (np.bitwise_count(fps[rest] ^ fps[at]) <= distance) & (home[rest] | home[at])
            if near.any():
                found = rest[near].tolist()
                first += [at] * len(found)
                second += found
                stack += found
                rest = rest[~near]
    return first, second


def bucket_links(members: DataFrame, how: Hashing) -> DataFrame:
    """``a, b``: links inside buckets, a task holding one bucket at a time."""

    def links(fps: list[np.ndarray], home: list[np.ndarray]) -> pa.RecordBatch | None:
        fp, own = np.concatenate(fps), np.concatenate(home)
        if len(fp) < 2 or not own.any():
            return None
        first, second = forest(fp, own, how.distance)
        value = fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(value[first]), pa.array(value[second])], ["a", "b"]) if first else None

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fps, home, out = None, [], [], []
        for batch in batches:
            bucket, fp, own = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.nonzero(np.diff(bucket))[0] + 1).tolist(), len(bucket)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start < end:
                    if at is not None and bucket[start] != at:
                        if (sum(map(len, fps)) > 1) and (found := links(fps, home)):
                            out.append(found)
                        fps, home = [], []
                    at = bucket[start]
                    fps.append(fp[start:end])
                    home.append(own[start:end])
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if fps and (found := links(fps, home)):
            yield found

    spark = members.sparkSession
    dealt = members.select("bucket", "fp", "home").repartition(n_partitions(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(walk, "a bigint, b bigint")


def probed(fps: DataFrame, how: Hashing) -> tuple[list[list[int]], list[int]]:
    """The parts and thresholds of least estimated cost for these fingerprints."""
    n, both = bit_counts(fps)
    ones = np.diag(both) / max(n, 1)
    choices = []
    for m in range(1, how.distance + 2):
        parts = grouped_bits(n, both, m)
        choices.append((allocated([part_costs(n, ones, bits, how) for bits in parts], how.distance)[0], parts))
    parts = min(choices)[1]
    counts = signatures(fps, parts, [0] * len(parts)).groupBy("part", "bucket").count().where("count > 1")
    met = {r["part"]: float(r["pairs"]) for r in counts.groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    costs = [part_costs(n, ones, bits, how, met.get(i, 0.0)) for i, bits in enumerate(parts)]
    return parts, allocated(costs, how.distance)[1]


def links(fps: DataFrame, how: Hashing = Hashing()) -> DataFrame:
    """``a, b``: links that join all fingerprints ``fp`` (distinct) within the distance."""
    parts, thresholds = probed(fps, how)
    members = signatures(fps, parts, thresholds)
    found = None
    while True:
        large = staged(members.groupBy("bucket").count().where(F.col("count") > how.block).select(F.col("bucket").alias("large")), "large")
        hot = not large.isEmpty()
        inside = F.col("bucket") == F.col("large")
        more = bucket_links(members.join(large, inside, "left_anti") if hot else members, how)
        found = more if found is None else found.unionByName(more)
        if not hot:
            return found
        again = staged(members.join(large, inside, "left_semi"), "hot")
        # with few bits left open a bucket has few values more: it is compared as it is
        few = F.bit_count("free") <= 2 * (how.distance + 1)
        found = found.unionByName(bucket_links(again.where(few), how))
        members = cut_again(again.where(~few), how.distance)


def near_duplicates(df: DataFrame, how: Hashing = Hashing(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: ``key, fingerprint`` (16 hex digits) and ``component_id``, the smallest key reachable."""
    found = staged(fingerprints(df, how, key, text), "fingerprints")
    distinct = staged(found.groupBy("fp").agg(F.min("_key").alias("first")), "distinct")
    roots = components(links(distinct, how))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    out = found.join(named, F.col("fp") == F.col("of"))
    return out.select(F.col("_key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

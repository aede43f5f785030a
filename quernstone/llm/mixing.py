"""Mixing sources to target weights.

Each source's documents, in a pseudorandom order, form one stream of words, packed into blocks of
fixed length. The mix is a row of slots dealt over output shards of equal size. A keyed Feistel
permutation of all slots says which source each slot of a shard takes, and which of that source's
slots it is: the counts of the sources in a shard are a multinomial draw, conditioned on each
source's total so that the totals are exact, at any number of slots, and a task finds the draws of
its shards alone. Source slot j of epoch e takes block P(j), P a keyed permutation of the source's
block numbers, another one each epoch; slots and blocks are joined by block number. A source's last
slot is cut so that its words come to the whole part of its target.

Cases: a null text has size 0; such documents take 0 words. A text of any length spreads over as many
blocks as it needs. A null source is one source, ordered last. Rows with a null or repeated
``doc_id`` are rows of their own; rows alike in id, source, size and text are interchangeable and are
placed as one stretch. A source without words has target 0. An empty table gives an empty mix.
Extra columns of any name are ignored, or pass through ``apply_mix`` untouched. Only one row a source
comes to the driver; more than ``max_sources`` raise ValueError. Reruns agree, however the rows are
split over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import permuted, staged, tune, unpermuted

WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in order of name; ``share`` of all words is mixed; ``most`` times its words is all a source gives; ``block`` words; ``shard_slots`` blocks a shard."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: Fraction = Fraction(3, 2)
    most: int = 2
    block: int = 256
    shard_slots: int = 4096
    seed: int = 11
    max_sources: int = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[int], mix: Mix) -> list[Fraction]:
    """Words wanted of each source: by weight, none above its bound, the excess shared by weight anew."""
    weight = [mix.weights[i % len(mix.weights)] for i in range(len(sizes))]
    bound = [Fraction(mix.most * s) for s in sizes]
    out = [Fraction(0)] * len(sizes)
    left, open_ = mix.share * sum(sizes), [i for i, s in enumerate(sizes) if s]
    while open_:
        total = sum(weight[i] for i in open_)
        full = [i for i in open_ if left * weight[i] / total > bound[i]]
        if not full:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in full:
            out[i] = bound[i]
        left -= sum(bound[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _key(mix: Mix, source: int, epoch: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{mix.seed}:{source}:{epoch}".encode(), digest_size=8).digest(), "big")


@dataclass(frozen=True)
class Source:
    size: int
    target: float
    blocks: int
    slots: int  # whole slots; the one that is cut comes on top
    cut_block: int  # -1: none is cut
    cut_words: int


def planned(size: int, target: Fraction, number: int, mix: Mix) -> Source:
    """How many slots give the whole part of the target, and what the last one takes."""
    blocks, words = -(-size // mix.block), int(target)
    if not size:
        return Source(0, 0.0, 0, 0, -1, 0)
    epoch, rest = divmod(words, size)
    short = size - (blocks - 1) * mix.block
    place = int(unpermuted(np.array([blocks - 1]), blocks, _key(mix, number, epoch))[0])
    given = lambda n: n * mix.block - (mix.block - short if place < n else 0)
    n = rest // mix.block
    while n < blocks and given(n + 1) <= rest:
        n += 1
    cut = rest - given(n)
    at = int(permuted(np.array([n]), blocks, _key(mix, number, epoch))[0]) if cut else -1
    return Source(size, float(target), blocks, epoch * blocks + n, at, cut)


def drawn(shard: int, totals: np.ndarray, mix: Mix, at_once: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Source, and number among the source's slots, of each slot of a shard."""
    ends = np.cumsum(totals)
    total = int(ends[-1]) if len(ends) else 0
    last = min(total, (shard + 1) * mix.shard_slots)
    for low in range(shard * mix.shard_slots, last, at_once):
        place = permuted(np.arange(low, min(last, low + at_once)), total, _key(mix, -1, 0))
        source = np.searchsorted(ends, place, side="right")
        yield source, place - (ends - totals)[source]


def source_table(sized: DataFrame, mix: Mix) -> tuple[list[str | None], list[Source]]:
    """The sources in order of name, nulls last, with their plans."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(mix.max_sources + 1).collect()
    if len(rows) > mix.max_sources:
        raise ValueError(f"more than {mix.max_sources} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in rows]
    wanted = targets(sizes, mix)
    return [r["source"] for r in rows], [planned(s, t, i, mix) for i, (s, t) in enumerate(zip(sizes, wanted, strict=True))]


def block_uses(sized: DataFrame, plans: list[Source], mix: Mix) -> DataFrame:
    """``sid, block, times``: how often the whole slots of the mix take each block."""
    spark = sized.sparkSession
    totals = np.array([p.slots for p in plans], np.int64)
    blocks = np.array([p.blocks for p in plans], np.int64)
    shards = -(-int(totals.sum()) // mix.shard_slots)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                for sid, j in drawn(shard, totals, mix):
                    epoch = j // blocks[sid]
                    which, back = np.unique(np.stack([sid, epoch]), axis=1, return_inverse=True)
                    keys = np.array([_key(mix, s, e) for s, e in which.T.tolist()], np.uint64)
                    block = permuted(j % blocks[sid], blocks[sid], keys[back.ravel()])
                    yield pa.RecordBatch.from_pydict({"sid": sid.astype(np.int32), "block": block})

    taken = spark.range(0, shards, 1, max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(slots, "sid int, block bigint")
    return taken.groupBy("sid", "block").agg(F.count("*").alias("times"))


#: Rows alike that one array holds while they are spread.
ALIKE = 4096


def positions(sized: DataFrame, names: list[str | None], plans: list[Source], mix: Mix) -> DataFrame:
    """``doc_id, size, alike, sid, start``: each document's place in its source's stream of words.

    Rows alike are counted first, with partial sums, so a hot row is one row a task. Then two levels of
    sums: chunks of about 8,192 blocks by hash, then the stretches of a chunk.
    """
    spark = sized.sparkSession
    table = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "sid int, name string")
    known = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name")))  # a row a source, at most max_sources
    kinds = known.groupBy("sid", "doc_id", "size", "alike").agg(F.count("*").alias("n"))
    chunks = [(i, max(1, -(-p.blocks // 8192))) for i, p in enumerate(plans)]  # of some 8,192 blocks
    counts = spark.createDataFrame(chunks, "sid int, chunks bigint")
    chunked = kinds.withColumn("hash", F.xxhash64(F.lit(mix.seed), "doc_id", "size", "alike")).join(F.broadcast(counts), "sid").withColumn("chunk", F.pmod("hash", "chunks"))
    words = F.col("size") * F.col("n")
    sums = chunked.groupBy("sid", "chunk").agg(F.sum(words).alias("words"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("sid", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "chunk").orderBy("hash", "doc_id", "size", "alike").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunked.join(starts, ["sid", "chunk"]).withColumn("start", F.col("base") + F.coalesce(F.sum(words).over(inside), F.lit(0)))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / ALIKE)))
    some = placed.withColumn("piece", piece)
    copy = F.explode(F.sequence(F.col("piece") * ALIKE, F.least(F.col("n"), (F.col("piece") + 1) * ALIKE) - 1))
    return some.withColumn("copy", copy).select("doc_id", "size", "alike", "sid", "copy", (F.col("start") + F.col("copy") * F.col("size")).alias("start"))


def _sized(doc_id: Column, source: Column, text: Column) -> list[Column]:
    return [doc_id.alias("doc_id"), source.cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("alike")]


def _parts(sized: DataFrame, names: list[str | None], plans: list[Source], mix: Mix) -> DataFrame:
    """``doc_id, size, alike, sid, copy, start, source_size, target`` and, of each block that holds words of it, ``block, low, high, times, extra``.

    ``low`` and ``high``: the document's words in the block; ``extra``: the first so many of them once more.
    """
    spark = sized.sparkSession
    facts = spark.createDataFrame([(i, p.size, p.target, p.cut_block, p.cut_words) for i, p in enumerate(plans)], "sid int, source_size bigint, target double, cut_block bigint, cut_words bigint")
    placed = staged(positions(sized, names, plans, mix), "positions").join(F.broadcast(facts), "sid")  # a row a source
    uses = block_uses(sized, plans, mix)
    b, end = F.lit(mix.block).cast("long"), F.col("start") + F.col("size")
    block = F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))))
    parts = placed.withColumn("block", block)
    low, high = F.greatest("start", F.col("block") * b), F.least(end, (F.col("block") + 1) * b)
    cut = F.when(F.col("block") == F.col("cut_block"), F.greatest(F.lit(0), F.least(high, F.col("block") * b + F.col("cut_words")) - low)).otherwise(0)
    parts = parts.select("*", (low - F.col("start")).alias("low"), (high - F.col("start")).alias("high"), cut.cast("long").alias("extra"))
    met = parts.join(uses.hint("merge"), ["sid", "block"], "left")  # its size is not known from its plan: never broadcast
    return met.withColumn("times", F.coalesce("times", F.lit(0)))


def mixed(df: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """A row a document: ``doc_id, size, source_size, target, taken``."""
    tune(df.sparkSession)
    sized = staged(df.select(*_sized(F.col("doc_id"), F.col("source"), F.col("text"))), "sizes")
    words = F.coalesce((F.col("high") - F.col("low")) * F.col("times") + F.col("extra"), F.lit(0)).cast("long")
    done = _parts(sized, *source_table(sized, mix), mix).groupBy("sid", "doc_id", "size", "alike", "copy", "source_size", "target").agg(F.sum(words).alias("taken"))
    return done.select("doc_id", "size", "source_size", "target", "taken")


def runs(parts: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Stretches of words from a document's parts (low, high, times, extra); what lies between parts is not taken.

    Neighbouring blocks that are both taken once more give one stretch, so a document whose blocks are
    all taken twice comes whole, twice.
    """
    flat = []
    for low, high, times, extra in sorted(parts):
        flat += [x for x in ((low, low + extra, times + 1), (low + extra, high, times)) if x[0] < x[1]]
    out = []
    for level in range(1, max((t for _, _, t in flat), default=0) + 1):
        taken: list[list[int]] = []
        for low, high, times in flat:
            if times >= level and taken and taken[-1][1] == low:
                taken[-1][1] = high
            elif times >= level:
                taken.append([low, high])
        out += [tuple(x) for x in taken]
    return out


def cut_words(text: str, stretches: list[tuple[int, int]]) -> list[str]:
    """Words low..high-1 of a text, with the white space between them and after them, of each stretch; a whole text is itself."""
    import re

    bounds = [0, *[m.start() for m in re.finditer(WORDS, text)][1:], len(text)]
    return [text[bounds[low] : bounds[high]] for low, high in stretches]


def apply_mix(df: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The drawn blocks as documents: a row for each stretch of a document that the mix takes, as often as it takes it.

    A stretch is as long as the drawn blocks that follow one another; ``text`` holds its words, and
    ``n_chars``, if there, is counted anew; the other columns are the document's. So each source
    comes to the whole part of its target in words. Documents without words are in no block and go.
    The rows are stored once with a number each; rows alike take turns by it.
    """
    spark = df.sparkSession
    tune(spark)
    fields = [F.col(f"`{c}`") for c in df.columns]
    rows = staged(df.select(F.struct(*fields).alias("row"), F.monotonically_increasing_id().alias("rid")), "rows")
    own = lambda c: F.col("row")[c]
    sized = staged(rows.select(*_sized(own("doc_id"), own("source"), own("text")), "rid"), "sizes").where("size > 0")
    names, plans = source_table(sized, mix)
    table = spark.createDataFrame(list(enumerate(names)), "sid int, name string")
    parts = _parts(sized.drop("rid"), names, plans, mix).where("times > 0 OR extra > 0")
    takings = parts.groupBy("doc_id", "sid", "size", "alike", "copy").agg(F.collect_list(F.struct("low", "high", "times", "extra")).alias("parts"))  # of one document
    # rows alike are numbered by input task, then within it: no group of them meets in one task
    key, task = ["sid", "doc_id", "size", "alike"], F.shiftright("rid", 33)
    known = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).select(*key, "rid", task.alias("task"))
    counts = known.groupBy(*key, "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*key, "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = known.withColumn("inside", F.row_number().over(Window.partitionBy(*key, "task").orderBy("rid")) - 1).alias("k").join(bases.alias("b"), [F.col(f"k.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*key, "task")])
    numbered = placed.select(*(F.col(f"k.{c}") for c in key), "k.rid", (F.col("b.base") + F.col("k.inside")).alias("copy"))
    wanted = numbered.alias("n").join(takings.alias("t"), [F.col(f"n.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*key, "copy")]).select(F.col("n.rid"), F.col("t.parts"))
    met = rows.join(wanted, "rid").select("row", own("text").alias("text"), "parts")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, texts = [], []
            for i, (text, drawn_parts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                got = cut_words(text, runs([tuple(p[c] for c in ("low", "high", "times", "extra")) for p in drawn_parts]))
                index += [i] * len(got)
                texts += got
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), pa.array(texts, pa.string())], ["row", "text"])

    kind = rows.schema["row"].dataType.simpleString()
    out = met.mapInArrow(emit, f"row {kind}, text string")
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return out.select(*((new[c].cast(df.schema[c].dataType) if c in new else own(c)).alias(c) for c in df.columns))

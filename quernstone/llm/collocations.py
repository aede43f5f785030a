"""Phrases whose words stand together more often than chance, with hash-bucket pruning.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and pieces into words.
Phrases of each length are counted in a pass of their own over all texts. A pass counts the phrases of
its length exactly and, in buckets of a hash, the phrases one word longer. The next pass counts a phrase
only if its bucket reached the least count and (Apriori) both of its parts that are one word shorter did.
Both tests read bitmaps of a fixed size, which the tasks get by broadcast: they let through every phrase
that may be frequent, and the exact counts decide. Bucket counts stop at the least count, so a task's
are one byte a bucket, and buckets are summed in tasks that each hold a range of them.

A task interns words; the phrases of a batch are numbers, counted by sorting, and leave the task as
(language, phrase, count), so a phrase of any frequency costs a row a task. Counts, products and scores
are exact decimals (a * a * 1,000,000 below 10 ** 38: counts up to 10 ** 15).

Cases: a null or empty text has no words; a null language is ``und``. Texts are read whole, whatever
their length. Repeated rows count as often as they come. Of phrases that tie in score and count the one
with the smaller UTF-8 bytes comes first. An empty table gives no row. Extra columns of any name are
ignored; ids are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import n_partitions, staged, tune

UNKNOWN = "und"
SPLIT = 1 << 16  # buckets of a range: a task's counts of it are one row
STRETCH = 1 << 17  # words that are counted at once; longer texts are cut, and phrases counted where they start


@dataclass(frozen=True)
class Mining:
    """Phrases of up to ``longest`` words with ``least`` occurrences, none that a longer one covers by ``percent``; the best ``top`` a language; ``buckets`` (a power of two) of a bitmap; ``words`` and ``phrases`` a task holds before it puts out its counts."""

    longest: int = 3
    least: int = 10
    percent: int = 50
    top: int = 2000
    buckets: int = 1 << 24
    words: int = 1 << 19
    phrases: int = 1 << 19


BOUNDARY = b"\n"
_PLAIN = bytes(ord("\n") if chr(i) in ".,;:!?\n\v\f\r" else ord(" ") if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words and boundaries of pieces, in order."""
    return [w for w in text.translate(_PLAIN).replace(BOUNDARY, b" \n ").split(b" ") if w]


class Words(dict):
    """Numbers of the words of one language; a number stands for language and word."""

    def __init__(self, owner: Interned, seed: int):
        super().__init__({BOUNDARY: 0})
        self.owner, self.seed = owner, seed

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = number = len(self.owner.words)
        self.owner.words.append(word)
        self.owner.new.append(xxhash.xxh3_64_intdigest(word, self.seed))
        return number


class Interned:
    """The words of a task by number, and their hashes, which are the same in all tasks."""

    def __init__(self):
        self.words: list[bytes] = [BOUNDARY]
        self.new: list[int] = []
        self.hashes = np.zeros(1, np.uint64)
        self.langs: dict[str, Words] = {}

    def numbers(self, lang: str, words: list[bytes]) -> list[int]:
        import xxhash

        known = self.langs.get(lang)
        if known is None:
            known = self.langs[lang] = Words(self, xxhash.xxh3_64_intdigest(lang.encode()))
        return [known[w] for w in words]

    def hash(self) -> np.ndarray:
        if self.new:
            self.hashes = np.concatenate((self.hashes, np.array(self.new, np.uint64)))
            self.new = []
        return self.hashes

    def lang_of(self) -> list[str]:
        """The language of each number."""
        out = [""] * len(self.words)
        for lang, known in self.langs.items():
            for number in known.values():
                out[number] = lang
        return out


def joined(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hashes of phrases and of the words after them: of the phrases one word longer."""
    with np.errstate(over="ignore"):
        x = (hashes * np.uint64(0x9E3779B97F4A7C15)) ^ more
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def phrase_hash(words: list[bytes], lang: str) -> int:
    import xxhash

    seed = xxhash.xxh3_64_intdigest(lang.encode())
    out = np.array([xxhash.xxh3_64_intdigest(words[0], seed)], np.uint64)
    for word in words[1:]:
        out = joined(out, np.array([xxhash.xxh3_64_intdigest(word, seed)], np.uint64))
    return int(out[0])


def has(bits: np.ndarray, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Whether the buckets of hashes are set in a packed bitmap."""
    at = hashes & np.uint64(buckets - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Pass:
    """Counts of phrases of ``length`` words and buckets of those one longer, of one task."""

    def __init__(self, length: int, how: Mining, shorter: np.ndarray | None, bucketed: np.ndarray | None):
        self.length, self.how, self.shorter, self.bucketed = length, how, shorter, bucketed
        self.bits = 63 // how.longest  # of a word in a phrase's number
        self.stretch, self.most = min(STRETCH, 1 << self.bits - 2), min(how.words, 1 << self.bits - 2)
        self.counts = np.zeros(how.buckets, np.uint8) if length < how.longest else None
        self.clear()

    def clear(self) -> None:
        self.known, self.keys, self.times, self.held, self.numbers = Interned(), [], [], 0, []

    def text(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        """Count the phrases of a text; puts out counts when many are held."""
        words = words_of(text)
        words.append(BOUNDARY)
        for at in range(0, len(words), self.stretch):
            part = words[at : at + self.stretch + self.length]
            if len(self.known.words) + len(part) > self.most + self.stretch or self.held > 4 * self.how.phrases:
                yield from self.flushed()
            if len(words) > self.stretch:
                self.add_pending()
                self.add(self.known.numbers(lang, part), self.stretch)
            else:
                self.numbers += self.known.numbers(lang, part)
                if len(self.numbers) >= self.stretch:
                    self.add_pending()

    def add_pending(self) -> None:
        if self.numbers:
            self.add(self.numbers, len(self.numbers))
            self.numbers = []

    def flushed(self) -> Iterator[pa.RecordBatch]:
        """Put out the counts if there are many words or, once equal phrases are one, many phrases."""
        self.add_pending()
        if self.keys:
            self.merged()
        if len(self.known.words) > self.most or self.held > self.how.phrases:
            yield from self.put_out()

    def add(self, numbers: list[int], starts: int) -> None:
        """Count the phrases of a stretch of words and boundaries that start at its first ``starts`` places."""
        ids, how = np.array(numbers, np.int64), self.how
        hashes, key, whole = self.known.hash()[ids], ids, ids > 0
        for length in range(1, self.length + 2):
            if length > 1:  # of places whose phrase one shorter may be frequent, as may the one that starts a word later
                longer = whole[:-1] & whole[1:]
                whole, hashes, key = longer, joined(hashes[:-1], word_hashes[length - 1 :]), (key[:-1] << self.bits) | ids[length - 1 :]
            else:
                word_hashes = hashes
            if length == self.length:
                if self.shorter is not None:
                    whole = whole & has(self.bucketed, hashes, how.buckets)
                found, times = np.unique(key[:starts][whole[:starts]], return_counts=True)
                self.keys.append(found)
                self.times.append(times)
                self.held += len(found)
                if self.counts is None:
                    break
            elif length == self.length - 1 and self.shorter is not None:
                whole = whole & has(self.shorter, hashes, how.buckets)
            elif length == self.length + 1:
                at, times = np.unique(hashes[:starts][whole[:starts]] & np.uint64(how.buckets - 1), return_counts=True)
                at = at.astype(np.int64)
                self.counts[at] = np.minimum(self.counts[at] + np.minimum(times, how.least), how.least).astype(np.uint8)

    def merged(self) -> None:
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        found, at = np.unique(keys, return_inverse=True)
        self.keys, self.times, self.held = [found], [np.bincount(at, times, len(found)).astype(np.int64)], len(found)

    def put_out(self) -> Iterator[pa.RecordBatch]:
        self.add_pending()
        if self.keys:
            self.merged()
            words, langs, mask = self.known.words, self.known.lang_of(), (1 << self.bits) - 1
            for at in range(0, self.held, 8192):
                keys, times = self.keys[0][at : at + 8192], self.times[0][at : at + 8192]
                parts = [((keys >> (self.bits * (self.length - 1 - i))) & mask).tolist() for i in range(self.length)]
                phrases = [b" ".join([words[n] for n in row]) for row in zip(*parts, strict=True)]
                yield self.rows([langs[n] for n in parts[0]], phrases, times, None, None)
        self.clear()

    def buckets(self) -> Iterator[pa.RecordBatch]:
        """A row a range of buckets that the task has met: the counts, compressed, as most are none or one."""
        if self.counts is None:
            return
        for at in range(0, len(self.counts), SPLIT):
            own = self.counts[at : at + SPLIT]
            if own.any():
                yield self.rows(None, None, None, [at // SPLIT], [zlib.compress(own.tobytes(), 1)])

    @staticmethod
    def rows(langs, phrases, times, chunk, packed) -> pa.RecordBatch:
        n = len(phrases or chunk)
        of = lambda v, t: pa.nulls(n, t) if v is None else pa.array(v, t)
        text = pa.nulls(n, pa.string()) if phrases is None else pa.array(phrases, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([of(langs, pa.string()), text, of(times, pa.int64()), of(chunk, pa.int32()), of(packed, pa.binary())], ["lang", "phrase", "n", "chunk", "packed"])


def counted(docs: DataFrame, length: int, how: Mining, shorter, bucketed) -> DataFrame:
    """One pass: ``lang, phrase, n`` of each task's phrases and ``chunk, packed`` of its buckets, staged."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pass(length, how, shorter and np.frombuffer(shorter.value, np.uint8), bucketed and np.frombuffer(bucketed.value, np.uint8))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from own.text(lang, text)
        yield from own.put_out()
        yield from own.buckets()

    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return staged(texts.mapInArrow(run, "lang string, phrase string, n bigint, chunk int, packed binary"), f"phrases{length}")


def _packed_bits(chunks: DataFrame, how: Mining) -> bytes:
    """The driver's bitmap from rows ``chunk, bits``: how.buckets / 8 bytes, whatever the corpus."""
    out = np.zeros((how.buckets + 7) // 8, np.uint8)
    width = min(SPLIT, how.buckets) // 8
    for r in chunks.collect():
        out[r["chunk"] * width : (r["chunk"] + 1) * width] |= np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def bucket_bitmap(found: DataFrame, how: Mining) -> bytes:
    """Which buckets reach the least count: each task sums some ranges of buckets."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(zlib.decompress(packed), np.uint8)
                before = totals.get(chunk)
                totals[chunk] = more if before is None else np.minimum(before.astype(np.uint16) + more, how.least).astype(np.uint8)
        for chunk, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(total >= how.least, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    parts = found.where("chunk IS NOT NULL").select("chunk", "packed").repartition(n_partitions(found.sparkSession), "chunk")
    return _packed_bits(parts.mapInArrow(add, "chunk int, bits binary"), how)


def phrase_bitmap(frequent: DataFrame, how: Mining) -> bytes:
    """The buckets of phrases: each task marks ranges of a bitmap, ranges are merged on the executors."""
    width = min(SPLIT, how.buckets)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(how.buckets, bool)
        for batch in batches:
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own[phrase_hash(phrase.split(b" "), lang) & (how.buckets - 1)] = True
        for at in range(0, how.buckets, width):
            if (some := own[at : at + width]).any():
                yield pa.RecordBatch.from_arrays([pa.array([at // width], pa.int32()), pa.array([np.packbits(some, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(bits, np.uint8)
                totals[chunk] = more if chunk not in totals else totals[chunk] | more
        for chunk, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "bits"])

    kind = "chunk int, bits binary"
    marked = frequent.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInArrow(mark, kind)
    return _packed_bits(marked.repartition(n_partitions(frequent.sparkSession), "chunk").mapInArrow(merge, kind), how)


def frequent_phrases(docs: DataFrame, how: Mining = Mining()) -> tuple[DataFrame, DataFrame]:
    """``lang, length, phrase, n`` of the phrases of up to ``longest`` words that come ``least`` times or more; and ``lang, total``, the words of each language."""
    context = docs.sparkSession.sparkContext
    shorter = bucketed = totals = None
    kept = []
    for length in range(1, how.longest + 1):
        found = counted(docs, length, how, shorter, bucketed)
        each = found.where("phrase IS NOT NULL")
        if length == 1:
            totals = each.groupBy("lang").agg(F.sum("n").alias("total"))
        frequent = staged(each.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= how.least).select("lang", F.lit(length).alias("length"), "phrase", "n"), "frequent")
        kept.append(frequent)
        if length < how.longest:
            shorter, bucketed = context.broadcast(phrase_bitmap(frequent, how)), context.broadcast(bucket_bitmap(found, how))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out, totals


def scored(frequent: DataFrame, how: Mining) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the phrases of two words or more that no longer one covers."""
    several = frequent.where("length > 1")
    words = F.split("phrase", " ")
    part = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    cuts = several.withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = cuts.select("lang", "length", "phrase", F.col("n").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("length")).alias("rest"))
    counts = frequent.select("lang", "phrase", "n")
    side = lambda n: counts.select(F.col("lang").alias(f"{n}_lang"), F.col("phrase").alias(f"{n}_phrase"), F.col("n").alias(n))
    on = lambda key, n: (F.col("lang") == F.col(f"{n}_lang")) & (F.col(key) == F.col(f"{n}_phrase"))
    met = cuts.join(side("l"), on("first", "l")).join(side("r"), on("rest", "r"))
    whole = lambda c, p: F.col(c).cast(f"decimal({p},0)")
    met = met.withColumn("top", (F.lit(1_000_000).cast("decimal(7,0)") * (whole("a", 15) * whole("a", 15))).cast("decimal(38,0)")).withColumn("below", (whole("l", 18) * whole("r", 18)).cast("decimal(38,0)"))
    met = met.withColumn("score", F.expr("top div below"))
    lowest = met.groupBy("lang", "length", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = several.where("length > 2").withColumn("words", words).withColumn("m", F.explode(F.sequence(F.lit(2), F.col("length") - 1)))
    inside = inside.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("m") + 1))).groupBy(F.col("lang").alias("in_lang"), part(F.col("at"), F.col("m")).alias("in_phrase")).agg(F.max("n").alias("longer"))
    own = lowest.join(inside, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")), "left")
    covered = F.col("longer").cast("decimal(38,0)") * 100 >= F.col("a").cast("decimal(34,0)") * how.percent
    return own.where(F.col("longer").isNull() | ~covered).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def ranked(scores: DataFrame, how: Mining) -> DataFrame:
    """The first ``top`` of each language with their ``rank``: first of each of many parts of a language, then of what these leave."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = n_partitions(scores.sparkSession)
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    first = scores.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= how.top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= how.top).drop("part")


def collocations(docs: DataFrame, how: Mining = Mining()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases."""
    frequent, totals = frequent_phrases(docs, how)
    best = ranked(scored(frequent, how), how)
    named = totals.select(F.col("lang").alias("of"), F.col("total").alias("n"))
    return best.join(named, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

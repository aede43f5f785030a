"""Near-duplicate documents by SetSketch registers.

A document is the set of its word shingles. Documents with equal sets form one class. A class's
sketch has registers K_i = floor(1 - log_b m_i), truncated to 0..q+1, where m_i is the smallest of
exponential variates of rate a that hash i gives the shingles: sketches merge by the larger
register. Bands of registers are hashed; classes that share a band's value are candidates. The joint
likelihood of the registers that are larger, smaller and equal, with the known set sizes, estimates
the Jaccard similarity; candidates that could reach the bound are verified on their full sets.

A bucket of g classes gives no g * g pairs. First each member meets the bucket's centre, the class
that shares most buckets. Links found are joined into components. Then, only in buckets that still
hold more than one component, members of different components are compared by the likelihood of
finer sketches (more registers, of which the first are the ones of the bands), in blocks of bounded
size, each pair in the first bucket that it shares. Blocks hold sets of about one size: those of sizes
too far apart to be linked never meet. What may be linked is verified on its full sets in the block,
which joins components as it goes, so n members give at most n - 1 links.
So every candidate pair is verified, or ruled out by size or likelihood, or inside one component.

A class is named by 64 bits of the digest of its set; 64 further bits tell apart sets that share a
name, and such a set gets another name. So sets are one class if 128 bits agree.

Cases: a null or empty text, or one without words, has no shingle and is linked with nothing; it is
kept. With fewer words than a shingle has, the whole sequence is the one shingle. A text of any length
is read whole; an empty table gives an empty result. Repeated rows, and texts that tie, are one class.
Extra columns of any name are ignored, or pass through ``deduplicated`` untouched. A null id is a row of
its class and never the smallest; a class of null ids alone is represented by one of its texts and
compared like any other, and its ``component_id`` is null if nothing it reaches has an id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import n_partitions, staged, tune


@dataclass(frozen=True)
class Sketching:
    """Shingles of ``words`` words; links of ``percent`` or more; ``bands`` of ``rows`` registers; base, rate and limit of the registers; ``slack``: likelihood estimates this far below the bound are verified too; ``fine`` registers and ``fine_slack`` of the second comparison; ``block``: members compared at once, fewer if their sets pass ``block_bytes``."""

    words: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    limit: int = 65534
    slack: float = 0.1
    fine: int = 560
    fine_slack: float = 0.09  # over 5 standard deviations of 560 registers at 0.80
    block: int = 512
    block_bytes: int = 16 << 20
    seed: int = 7
    remembered: int = 4 << 20  # bytes of words whose hashes are kept

    @property
    def registers(self) -> int:
        return self.bands * self.rows


class Sketcher:
    """Shingle hashes, class ids, sketches and band values of texts."""

    def __init__(self, how: Sketching):
        self.how = how
        rng = np.random.default_rng(how.seed)
        self.factor = rng.integers(0, 2**31, max(how.registers, how.fine), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.known: dict[bytes, int] = {}
        self.held = 0

    def shingles(self, text: str | None) -> np.ndarray:
        """Distinct 64-bit hashes of the text's shingles, ascending."""
        import xxhash

        words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z only, and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if self.held > self.how.remembered:
            known.clear()
            self.held = 0
        hashes = []
        for word in words:
            value = known.get(word)
            if value is None:
                value = xxhash.xxh3_64_intdigest(word)
                if len(word) <= 64:  # longer ones rarely come again
                    known[word] = value
                    self.held += len(word) + 64
            hashes.append(value)
        h = np.array(hashes, np.uint64)
        width = min(self.how.words, len(h))
        with np.errstate(over="ignore"):
            total = np.full(len(h) - width + 1, width, np.uint64)
            for i in range(width):
                total = (total ^ h[i : i + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
                total ^= total >> np.uint64(29)
            total *= np.uint64(0xBF58476D1CE4E5B9)
            total ^= total >> np.uint64(32)
        return np.unique(total)

    def least(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """The smallest 32-bit hash of each of the first n registers."""
        low, high = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.full(n, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 256):
            mixed = low[at : at + 256, None] * self.factor[:n] + high[at : at + 256, None]
            np.minimum(out, mixed.min(axis=0), out=out)
        return out

    def registers(self, hashes: np.ndarray, n: int | None = None) -> np.ndarray:
        share = (self.least(hashes, n or self.how.registers).astype(np.float64) + 0.5) / 2.0**32
        smallest = -np.log1p(-share) / self.how.rate
        return np.clip(np.floor(1 - np.log(smallest) / np.log(self.how.base)), 0, self.how.limit + 1).astype(np.uint16)

    def bands(self, registers: np.ndarray) -> np.ndarray:
        parts = registers.reshape(self.how.bands, self.how.rows).astype(np.uint64)
        key = np.arange(1, self.how.bands + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
        with np.errstate(over="ignore"):
            for i in range(self.how.rows):
                key = (key ^ parts[:, i]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
        return key.view(np.int64)


def class_id(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of the digest of a full set, as two signed numbers: the class's name, and what tells namesakes apart."""
    import xxhash

    value = xxhash.xxh3_128_intdigest(hashes.astype("<u8").tobytes())
    high, low = value >> 64, value & (1 << 64) - 1
    return tuple(x - (1 << 64) if x >> 63 else x for x in (low, high))


def sketches(df: DataFrame, how: Sketching, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_key, _text, cid, tell, n_shingles, registers``: cid is null and registers empty without shingles; _text is a hash of the text."""
    tune(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketcher(how)
        for batch in batches:
            ids, tells, sizes, registers = [], [], [], []
            for body in batch.column(2).to_pylist():
                hashes = own.shingles(body)
                cid, tell = class_id(hashes) if len(hashes) else (None, None)
                sizes.append(len(hashes))
                ids.append(cid)
                tells.append(tell)
                registers.append(own.registers(hashes).tobytes() if len(hashes) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(tells, pa.int64()), pa.array(sizes, pa.int64()), pa.array(registers, pa.binary())], ["_key", "_text", "cid", "tell", "n_shingles", "registers"])

    rows = df.select(F.col(f"`{key}`").alias("_key"), F.xxhash64(f"`{text}`").alias("_text"), F.col(f"`{text}`").alias("_body"))
    return rows.mapInArrow(sketch, f"_key {kind}, _text bigint, cid bigint, tell bigint, n_shingles bigint, registers binary")


def told_apart(found: DataFrame) -> DataFrame:
    """``found`` with another ``cid`` for sets that share one with a set of a smaller ``tell``, until none do."""
    while True:
        shared = staged(found.where("cid IS NOT NULL").groupBy("cid").agg(F.min("tell").alias("_low"), F.max("tell").alias("_high")).where("_low != _high").select(F.col("cid").alias("_cid"), "_low"), "namesakes")
        if shared.isEmpty():
            return found
        other = F.when(F.col("_low").isNotNull() & (F.col("tell") != F.col("_low")), F.xxhash64("cid", "tell")).otherwise(F.col("cid"))
        met = found.join(shared, F.col("cid") == F.col("_cid"), "left")
        found = staged(met.withColumn("cid", other).select(*found.columns), "sketches")


def log_likelihood(j: np.ndarray, equal: np.ndarray, larger: np.ndarray, smaller: np.ndarray, u: np.ndarray, base: float) -> np.ndarray:
    """Joint log-likelihood of a Jaccard similarity; u: the first set's share of both sizes."""
    v = 1 - u
    share = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (base - 1) / base) / np.log(base)
    up, down = share(u - v * j), share(v - u * j)
    return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))


def estimate(one: np.ndarray, two: np.ndarray, a: float, b: float, base: float) -> float:
    """Maximum-likelihood similarity of two sketches of sets of a and b members."""
    u = a / (a + b)
    j = np.linspace(0, min(a, b) / max(a, b), 2001)
    value = log_likelihood(j, np.sum(one == two), np.sum(one > two), np.sum(one < two), np.full(len(j), u), base)
    return float(j[np.argmax(value)])


def may_link(one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray, how: Sketching, slack: float) -> np.ndarray:
    """Whether the estimates of pairs of sketches (rows) lie at most ``slack`` below the bound.

    The likelihood has one peak, so the estimate is above a point if the likelihood rises there.
    """
    bound, n = how.percent / 100, one.shape[1]
    equal = (one == two).sum(axis=1)
    out = (np.minimum(a, b) * 100 >= how.percent * np.maximum(a, b)) & (equal >= (bound - 3 * slack) * n)
    if out.any():
        e, l = equal[out], (one[out] > two[out]).sum(axis=1)
        x, y = a[out].astype(np.float64), b[out].astype(np.float64)
        u, at = x / (x + y), bound - slack
        sides = [log_likelihood(np.full(len(u), at + d), e, l, n - e - l, u, how.base) for d in (-0.004, 0.004)]
        out[out] = sides[1] >= sides[0]
    return out


def _rows(column: pa.Array) -> np.ndarray:
    """Sketches of a column, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def central_pairs(members: DataFrame) -> DataFrame:
    """``a, b``: each member of a bucket with the bucket's centre; no pair twice."""
    weights = members.groupBy("cid").agg(F.sum("n").alias("weight"))
    centres = members.join(weights, "cid").groupBy("band").agg(F.max(F.struct("weight", "cid"))["cid"].alias("centre"))
    met = members.join(centres, "band").where("cid != centre")
    return met.select(F.least("cid", "centre").alias("a"), F.greatest("cid", "centre").alias("b")).distinct()


def likely(pairs: DataFrame, classes: DataFrame, how: Sketching) -> DataFrame:
    """The pairs whose registers may reach the bound."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r_a, r_b, n_a, n_b = batch.columns[2:]
                good = may_link(_rows(r_a), _rows(r_b), n_a.to_numpy(), n_b.to_numpy(), how, how.slack)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "r_a", "r_b", "n_a", "n_b")
    return met.mapInArrow(may, "a bigint, b bigint")


def linked_sets(p: np.ndarray, q: np.ndarray, how: Sketching) -> bool:
    """Whether two full sets reach the bound."""
    if 100 * min(len(p), len(q)) < how.percent * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= how.percent * (len(p) + len(q) - both)


def verified(pairs: DataFrame, sets: DataFrame, how: Sketching) -> DataFrame:
    """The pairs whose full sets reach the bound."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                good.append(linked_sets(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), how))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda x: sets.select(F.col("cid").alias(x), F.col("hashes").alias(f"h_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "h_a", "h_b")
    return met.mapInArrow(linked, "a bigint, b bigint")


def full_sets(df: DataFrame, classes: DataFrame, wanted: DataFrame, how: Sketching, key: str, text: str, fine: bool = False) -> DataFrame:
    """``cid, n_shingles, hashes`` of the wanted classes, from the whole text of one document of each; with ``fine``, finer sketches too.

    The document is the class's first: by its key, or, if no key of the class is known, by the hash
    of its text; rows without a key that share a text are one before they meet. Repeated rows of a
    document meet in one task, so a class comes once; were it to come twice, only links would repeat.
    """
    first = classes.join(wanted.select("cid").distinct(), "cid").select("first", "text", "cid", "tell", F.col("name").alias("_name"))
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_body"))
    keyed = rows.join(first, F.col("_key") == F.col("first")).select("cid", "tell", "_name", "_body")
    nameless = rows.where("_key IS NULL AND _body IS NOT NULL").groupBy(F.xxhash64("_body").alias("_hash")).agg(F.min("_body").alias("_body"))
    keyless = nameless.join(first.where("first IS NULL"), F.col("_hash") == F.col("text")).select("cid", "tell", "_name", "_body")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Sketcher(how), set()  # the classes of one task
        for batch in batches:
            out = []
            for cid, tell, name, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if cid in seen:
                    continue
                hashes = own.shingles(body)
                if len(hashes) and class_id(hashes) == (name, tell):  # another text may share the document's id
                    seen.add(cid)
                    out.append((cid, len(hashes), hashes.tobytes(), own.registers(hashes, how.fine).tobytes() if fine else b""))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["cid", "n_shingles", "hashes", "registers"])

    return staged(keyed.unionByName(keyless).mapInArrow(gather, "cid bigint, n_shingles bigint, hashes binary, registers binary"), "sets")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of an edge (a, b): root is its component's smallest node.

    Alternating large-star and small-star steps; each round is written to the shared folder.
    """
    current = staged(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    # edges are distinct, so their number and two sums of hashes tell whether any changed
    mark = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(7), "a", "b"))).first()
    seen = mark(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b").where("a != b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        met = large.join(low, "b")
        small = met.select(F.col("low").alias("a"), "b").union(met.select(F.col("low").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
        after = staged(small, "edges")
        before, seen = seen, mark(after)
        if seen == before:
            break
        current = after
    roots = current.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def remaining_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``band, number, cid, root, large, n, m``: members of buckets that hold more than one component; whether theirs is the bucket's largest, which has m of n."""
    rooted = members.drop("n").join(roots, F.col("cid") == F.col("node"), "left").select("band", "number", "cid", F.coalesce("root", "cid").alias("root"))
    sizes = rooted.groupBy("band", "root").agg(F.count("*").alias("size"))
    split = sizes.groupBy("band").agg(F.max(F.struct("size", "root")).alias("most"), F.sum("size").alias("n"), F.count("*").alias("several")).where("several > 1")
    met = rooted.join(split.select("band", "n", "most"), "band")
    return met.select("band", "number", "cid", "root", (F.col("root") == F.col("most.root")).alias("large"), "n", F.col("most.size").alias("m"))


def size_class(how: Sketching) -> Column:
    """The class of a set's size: sets that may be linked are of one class or of neighbouring ones."""
    return F.floor(F.log("n_shingles") / math.log(100 / how.percent) + 1e-9).cast("int")


def dealt_members(inside: DataFrame, how: Sketching) -> DataFrame:
    """``band, number, x, y, mine, cid, root``: the members of each two blocks of a bucket that are compared; ``inside`` has ``n_shingles``.

    Members of the largest component meet only those outside it, so one stray costs a row a member,
    whatever the bucket's size. A block holds members of one size class, on one side of that border.
    """
    most = F.floor(how.block_bytes / (8 * F.pow(F.lit(100 / how.percent), F.col("size") + 1) + 2 * how.fine))
    limit = F.greatest(F.lit(1), F.least(F.lit(how.block), most))
    mine = inside.withColumn("size", size_class(how))
    groups = mine.groupBy("band", "size", "large").agg(F.count("*").alias("of")).withColumn("blocks", F.ceil(F.col("of") / limit).cast("int"))
    side = lambda x: groups.select("band", F.col("size").alias(f"{x}_size"), F.col("large").alias(f"{x}_large"), F.col("blocks").alias(f"{x}_blocks"))
    meet = side("own").join(side("other"), "band").where("abs(own_size - other_size) <= 1 AND NOT (own_large AND other_large)")
    name = lambda size, large, at: F.shiftleft(size.cast("long") * 2 + large.cast("long"), 32) + at
    met = mine.join(meet.withColumnsRenamed({"own_size": "size", "own_large": "large"}), ["band", "size", "large"])
    dealt = met.withColumn("mine", name(F.col("size"), F.col("large"), F.pmod(F.xxhash64("cid"), F.col("own_blocks")))).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    dealt = dealt.withColumn("other", name(F.col("other_size"), F.col("other_large"), F.col("at")))
    return dealt.select("band", "number", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "cid", "root")


def in_blocks(rows: DataFrame, handle, kind: str) -> DataFrame:
    """``handle`` of the rows of each two blocks that meet: a group has at most two blocks, a task holds one at a time.

    Rows are ``band, number, x, y, mine, ..``; ``handle`` gets them without the band, with the band apart.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []
        for batch in batches:
            for band, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (band, row[1], row[2])
                if key != at and group:
                    yield handle(at[0], group)
                    group = []
                at = key
                group.append(tuple(row))
        if group:
            yield handle(at[0], group)

    dealt = rows.repartition(n_partitions(rows.sparkSession), "band", "x", "y").sortWithinPartitions("band", "x", "y")
    return dealt.mapInArrow(walk, kind)


def sides(group: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """The members of both blocks, in order of class."""
    group.sort(key=lambda r: r[4])
    return [r for r in group if r[3] == r[1]], [r for r in group if r[3] == r[2]]


def likely_in_block(left: list[tuple], right: list[tuple], how: Sketching) -> Iterator[tuple[tuple, np.ndarray]]:
    """Each member with the places of those of another component that it may be linked to and first meets in this bucket."""
    if not left or not right:
        return
    number, x, y = left[0][:3]
    table = np.frombuffer(b"".join(r[7] for r in right), np.uint16).reshape(len(right), -1)
    ids, n, roots = (np.array([r[i] for r in right], np.int64) for i in (4, 6, 5))
    for row in left:
        cid, root, size, sketch = row[4:8]
        some = np.nonzero((roots != root) & ((ids > cid) if x == y else True))[0]
        if len(some):
            one = np.frombuffer(sketch, np.uint16)
            near = some[may_link(np.broadcast_to(one, (len(some), len(one))), table[some], np.full(len(some), size), n[some], how, how.fine_slack)]
            shared = (table[near, : how.registers] == one[: how.registers]).reshape(len(near), how.bands, how.rows).all(axis=2)
            if (first := near[shared.argmax(axis=1) == number]).size:
                yield row, first


def remaining_links(inside: DataFrame, sets: DataFrame, how: Sketching) -> DataFrame:
    """``a, b``: links between members of one bucket and different components, as many as join what is linked.

    Sketches are dealt first, and say which members of a block have a likely pair there; only these
    meet again in it with their full sets.
    """
    dealt = staged(dealt_members(inside.join(sets.select("cid", "n_shingles"), "cid"), how), "dealt")
    sketched = ["band", "number", "x", "y", "mine", "cid", "root", "n_shingles", "registers"]

    def marked(band: int, group: list[tuple]) -> pa.RecordBatch:
        left, right = sides(group)
        found = set()
        for row, others in likely_in_block(left, right, how):
            found.add(row[4])
            found.update(right[at][4] for at in others.tolist())
        number, x, y = group[0][:3]
        n = len(found)
        return pa.RecordBatch.from_arrays([pa.array([v] * n, pa.int64()) for v in (band, x, y)] + [pa.array(sorted(found), pa.int64())], ["band", "x", "y", "cid"])

    def linked(band: int, group: list[tuple]) -> pa.RecordBatch:
        left, right = sides(group)
        first, second, above = [], [], {}

        def top(root: int) -> int:
            while root in above:
                root = above[root]
            return root

        for row, others in likely_in_block(left, right, how):
            own = np.frombuffer(row[8], np.uint64)
            for other in (right[at] for at in others.tolist()):
                one, two = top(row[5]), top(other[5])
                if one != two and linked_sets(own, np.frombuffer(other[8], np.uint64), how):
                    first.append(row[4])
                    second.append(other[4])
                    above[one] = two
        return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["a", "b"])

    with_sketches = dealt.join(sets.select("cid", "n_shingles", "registers"), "cid").select(*sketched)
    chosen = staged(in_blocks(with_sketches, marked, "band bigint, x bigint, y bigint, cid bigint"), "chosen")
    again = dealt.join(chosen, ["band", "x", "y", "cid"], "left_semi").join(sets.select("cid", "n_shingles", "registers", "hashes"), "cid").select(*sketched, "hashes")
    return in_blocks(again, linked, "a bigint, b bigint")


def _components(df: DataFrame, how: Sketching, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and ``cid, first, name, tell, root, component_id`` of their classes."""
    found = told_apart(staged(sketches(df, how, key, text).withColumn("name", F.col("cid")), "sketches"))
    real = found.where("cid is not null")
    same = [F.first(c).alias(c) for c in ("name", "tell", "n_shingles", "registers")]  # equal in all rows of a class
    classes = staged(real.groupBy("cid").agg(F.min("_key").alias("first"), F.min("_text").alias("text"), *same), "classes")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = Sketcher(how), np.arange(how.bands, dtype=np.int32)
        for batch in batches:
            if batch.num_rows:
                values = np.concatenate([own.bands(x) for x in _rows(batch.column(1))])
                cid = np.repeat(batch.column(0).to_numpy(), how.bands)
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(np.tile(number, batch.num_rows)), pa.array(values)], ["cid", "number", "band"])

    each = classes.select("cid", "registers").mapInArrow(bands, "cid bigint, number int, band bigint")
    shared = each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(each.join(shared, "band"), "members")
    central = staged(central_pairs(members), "central")  # so that the joins below may split a hot centre
    pairs = staged(likely(central, classes, how), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cid"))
    links = staged(verified(pairs, full_sets(df, classes, ends, how, key, text), how), "links")
    roots = staged(components(links), "roots")
    inside = staged(remaining_members(members, roots), "remaining")
    if not inside.isEmpty():
        sets = full_sets(df, classes, inside, how, key, text, fine=True)
        roots = staged(components(links.unionByName(remaining_links(inside, sets, how))), "roots")
    own = ["cid", "first", "name", "tell"]
    rooted = classes.select(*own).join(roots, F.col("cid") == F.col("node"), "left").select(*own, F.coalesce("root", "cid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return found, rooted.join(least, "root").select(*own, "root", "component_id")


def near_duplicates(df: DataFrame, how: Sketching = Sketching(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: ``key, n_shingles, component_id`` (smallest key linked, itself included) and ``kept``."""
    found, named = _components(df, how, key, text)
    out = found.join(named.select("cid", "component_id"), "cid", "left").withColumn("component_id", F.coalesce("component_id", "_key"))
    return out.select(F.col("_key").alias(key), "n_shingles", "component_id", F.col("_key").eqNullSafe(F.col("component_id")).alias("kept"))


def class_of(text: Column, how: Sketching) -> Column:
    """The class of a text, both parts of its name in one string; null without shingles."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        own = Sketcher(how)
        sets = map(own.shingles, texts.to_pylist())
        return pa.array(["{}:{}".format(*class_id(hashes)) if len(hashes) else None for hashes in sets], pa.string())

    return of(text)


def deduplicated(df: DataFrame, how: Sketching = Sketching(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``df`` for each component, with the component's smallest key; texts without shingles stay, repeated rows once.

    A key whose texts differ may stand for several components. Such keys and null ones alone are met by their class too.
    Rows travel as one struct, so columns of any name keep their values.
    """
    found, named = _components(df, how, key, text)
    class_ = F.when(F.col("cid").isNotNull(), F.concat_ws(":", F.col("name").cast("string"), F.col("tell").cast("string")))
    first = named.where(F.col("first").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("cid", "first", "name", "tell")).alias("m")).select("m.*")
    blank = found.where("cid IS NULL").select(F.col("_key").alias("kept"), class_.alias("class")).distinct()
    kept = staged(first.select(F.col("first").alias("kept"), class_.alias("class")).unionByName(blank), "kept")
    several = staged(found.groupBy("_key").count().where("count > 1 OR _key IS NULL").select(F.col("_key").alias("several")), "several")
    fields = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(F.struct(*fields).alias("row"), F.col(f"`{key}`").alias("key"))
    if several.isEmpty():
        return rows.join(kept, F.col("key") == F.col("kept"), "left_semi").select("row.*")
    mine = F.col("key").eqNullSafe(F.col("several"))
    alone = rows.join(several, mine, "left_anti").join(kept, F.col("key") == F.col("kept"), "left_semi").select("row")
    some = rows.join(several, mine, "left_semi").select("row", "key", class_of(F.col("row")[text], how).alias("mine"))
    met = some.join(kept, F.col("key").eqNullSafe(F.col("kept")) & F.col("mine").eqNullSafe(F.col("class")), "left_semi")
    unknown = F.col("key").isNull() & F.col("mine").isNull()  # may be any documents without words
    body = F.when(F.col("mine").isNull(), F.col("row")[text])
    once = met.where(~unknown).withColumn("body", body).dropDuplicates(["key", "mine", "body"]).select("row")
    return alone.unionByName(once).unionByName(met.where(unknown).select("row")).select("row.*")

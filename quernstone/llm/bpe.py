"""Byte-level BPE encoding and decoding.

The text is cut by the pre-tokenisation pattern; each piece is merged on its own. A segment tree
over a piece's byte positions holds the leftmost smallest rank of a mergeable neighbour pair. One
merge reads the root, walks down to the leftmost leaf with that rank, and updates two or three
leaves and the paths above them; live neighbours are linked lists. Pieces of up to 64 bytes are
merged many at a time in arrays of trees (one step of every tree at once); longer ones one tree
each, in n log n.

Cases: a null text encodes as an empty one: no ids. Decoding null gives null; ids outside the
vocabulary raise ValueError. Repeated rows are encoded alike; texts of any length are read whole. An
empty table gives an empty result. Extra columns of any name pass through, but for the result's own
names, which are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import local_file, ship_file, tune, with_columns

NONE = np.int32(2**31 - 1)
SHORT = 64


@dataclass(frozen=True)
class Vocabulary:
    """``path``: a rank file (base64 token, rank); ``pattern``: pre-tokenisation; ``remembered``: pieces whose ids are kept, of at most 64 characters each."""

    path: str
    pattern: str
    remembered: int = 100_000


_codecs: dict = {}


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary = vocabulary
        with open(local_file(vocabulary.path), "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.find = regex.compile(vocabulary.pattern).findall
        self.known: dict[str, bytes] = {}
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.slots = 1 << max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(self.slots, -1, np.int64)
        self.values = np.full(self.slots, NONE, np.int32)
        left = np.array([*pairs], np.int64)
        ranks = np.array([*pairs.values()], np.int32)
        place = self._home(left)
        while len(left):  # open addressing, a probe of all that are left a round
            free = self.keys[place] < 0
            self.keys[place[free]] = left[free]
            won = self.keys[place] == left
            self.values[place[won]] = ranks[won]
            left, ranks, place = left[~won], ranks[~won], (place[~won] + 1) & (self.slots - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - self.slots.bit_length())).astype(np.int64) & (self.slots - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it can't merge."""
        key = left << 32 | right
        place = self._home(key)
        out = np.full(len(key), NONE, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            seen = self.keys[place[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.values[place[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
            place[todo] = (place[todo] + 1) & (self.slots - 1)
        return out

    def merge_short(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """Ids (little-endian 32-bit) of pieces of at most ``leaves`` bytes: one tree a row."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        flat = np.frombuffer(b"".join(x.ljust(leaves, b"\0") for x in pieces), np.uint8).reshape(n, leaves)
        ids = self.single[flat]
        place = np.arange(leaves)
        following = np.where(place + 1 < lengths[:, None], place + 1, -1)
        before = np.broadcast_to(place - 1, (n, leaves)).copy()
        tree = np.full((n, 2 * leaves), NONE, np.int32)
        rows, cols = np.nonzero(following >= 0)
        tree[rows, leaves + cols] = self.rank(ids[rows, cols], ids[rows, cols + 1])
        for level in range(leaves.bit_length() - 2, -1, -1):
            at = slice(1 << level, 2 << level)
            below = tree[:, 2 << level : 4 << level]
            tree[:, at] = np.minimum(below[:, ::2], below[:, 1::2])
        alive = place < lengths[:, None]
        work = np.nonzero(tree[:, 1] != NONE)[0]
        while len(work):
            best = tree[work, 1]
            node = np.ones(len(work), np.int64)
            for _ in range(leaves.bit_length() - 1):
                node *= 2
                node += tree[work, node] != best
            at = node - leaves
            gone = following[work, at]
            after = following[work, gone]
            ids[work, at] = best
            alive[work, gone] = False
            following[work, at] = after
            has = after >= 0
            before[work[has], after[has]] = at[has]
            self._set(tree, leaves, work, gone, NONE)
            value = np.full(len(work), NONE, np.int32)
            value[has] = self.rank(ids[work[has], at[has]], ids[work[has], after[has]])
            self._set(tree, leaves, work, at, value)
            left = before[work, at]
            some = left >= 0
            w, a, b = work[some], left[some], at[some]
            self._set(tree, leaves, w, a, self.rank(ids[w, a], ids[w, b]))
            work = work[tree[work, 1] != NONE]
        out = ids[alive].astype("<u4").tobytes()
        ends = np.concatenate(([0], np.cumsum(alive.sum(axis=1)) * 4)).tolist()
        return [out[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    @staticmethod
    def _set(tree: np.ndarray, leaves: int, rows: np.ndarray, place: np.ndarray, value) -> None:
        """Point update of one leaf in each of these trees."""
        node = place + leaves
        tree[rows, node] = value
        while leaves > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            leaves >>= 1

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one piece of any length."""
        n = len(piece)
        leaves = 1 << max(1, (n - 1).bit_length())
        none, pairs = int(NONE), self.pairs
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        following, before = [*range(1, n), -1], list(range(-1, n - 1))
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = pairs.get(ids[i] << 32 | ids[i + 1], none)
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(place: int, value: int) -> None:
            node = place + leaves
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        while (best := tree[1]) != none:
            node = 1
            while node < leaves:
                node *= 2
                node += tree[node] != best
            at = node - leaves
            gone = following[at]
            after = following[gone]
            ids[at], ids[gone], following[at] = best, -1, after
            put(gone, none)
            if after >= 0:
                before[after] = at
                put(at, pairs.get(best << 32 | ids[after], none))
            else:
                put(at, none)
            if (left := before[at]) >= 0:
                put(left, pairs.get(ids[left] << 32 | best, none))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def merged(self, pieces: list[str]) -> dict[str, bytes]:
        raw = [x.encode("utf-8") for x in pieces]
        out: dict[str, bytes] = {}
        low = 0
        for leaves in (8, 16, 32, SHORT):
            chosen = [i for i, x in enumerate(raw) if low < len(x) <= leaves]
            for at in range(0, len(chosen), 1 << 13):
                part = chosen[at : at + (1 << 13)]
                for i, ids in zip(part, self.merge_short([raw[i] for i in part], leaves), strict=True):
                    out[pieces[i]] = ids
            low = leaves
        for i, x in enumerate(raw):
            if len(x) > SHORT:
                out[pieces[i]] = self.merge_long(x)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        out: list[bytes] = []
        start, size = 0, 0
        for at, text in enumerate(texts):
            size += len(text)
            if size >= 1 << 21 or at + 1 == len(texts):
                out += self._encode(texts[start : at + 1])
                start, size = at + 1, 0
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.find(x) for x in texts]
        known = self.known
        new = self.merged([*{p for c in cut for p in c if p not in known}])
        if len(known) + len(new) > self.vocabulary.remembered:
            done = [b"".join([known[p] if p in known else new[p] for p in c]) for c in cut]
            self.known = {p: ids for p, ids in new.items() if len(p) <= SHORT} if len(new) <= self.vocabulary.remembered else {}
            return done
        done = [b"".join([known[p] if p in known else new[p] for p in c]) for c in cut]
        known.update((p, ids) for p, ids in new.items() if len(p) <= SHORT)
        return done

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        if len(ids) and int(ids.max()) >= len(self.tokens):
            raise ValueError("an id lies outside the vocabulary")
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def codec(vocabulary: Vocabulary) -> Codec:
    """One codec a Python worker."""
    if vocabulary not in _codecs:
        _codecs[vocabulary] = Codec(vocabulary)
    return _codecs[vocabulary]


def encoded(text: Column, vocabulary: Vocabulary) -> Column:
    """Binary: the text's ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(vocabulary)
        for batch in batches:
            yield pa.array(own.encode(batch.to_pylist()), pa.binary())
        own.known = {}  # a worker lives on when its task ends

    return encode(F.coalesce(text, F.lit("")))


def decoded(ids: Column, vocabulary: Vocabulary) -> Column:
    """Binary: the bytes that packed ids stand for."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(vocabulary)
        for batch in batches:
            yield pa.array([None if x is None else own.decode(x) for x in batch.to_pylist()], pa.binary())

    return decode(ids)


def encode_documents(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (packed) and ``n_tokens``; columns of these names are replaced."""
    tune(df.sparkSession)
    ship_file(df.sparkSession, vocabulary.path)
    kept = [c for c in df.columns if c not in ("ids", "n_tokens")]
    return df.select(*kept, encoded(F.col(text), vocabulary).alias("ids")).select("*", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


def round_trip(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (packed), ``n_tokens`` and ``decoded`` (bytes): both ways in one Python worker a task."""
    tune(df.sparkSession)
    ship_file(df.sparkSession, vocabulary.path)
    kept = [c for c in df.columns if c not in ("ids", "n_tokens", "decoded")]

    def task():
        own = codec(vocabulary)
        own.known = {}  # what the task before on this worker remembered

        def both(texts: list) -> list[tuple]:
            ids = own.encode([x or "" for x in texts])
            return [(x, own.decode(x)) for x in ids]

        return both

    done = with_columns(df.select(*(F.col(f"`{c}`") for c in kept)), text, "ids binary, decoded binary", ["ids", "decoded"], [pa.binary(), pa.binary()], task)
    return done.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))

"""Token counts by batch encoding: only lengths leave the Arrow function.

A text is cut at safe boundaries, before a space that follows a character that is no white space, and
long pieces before any white space that does: byte-level pre-tokenisation never spans such a place,
and no special string of the vocabulary holds white space, so the counts of the pieces add up to the
count of the text. Counts of pieces are remembered in a bounded table; the rest goes to the library in
batches bounded by bytes, so a very long text and many short ones cost memory alike; a run without
white space is one piece, as it may be one word. A vocabulary whose special strings hold spaces, or
that has a normaliser or a pre-tokeniser other than byte-level, is encoded text by text.

Cases: a null text counts as empty, with 0 tokens and 0 bytes. Repeated rows count alike. An empty table
gives an empty result. Extra columns of any name pass through, but for ``n_tokens``, which is replaced.
Special strings in a text become their one token, as the library does by default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import local_file, ship_file, tune


@dataclass(frozen=True)
class Counting:
    """``path``: a tokenizers .json; ``batch_bytes``: text in one library call; ``remembered``: pieces whose count is kept, of at most 64 characters each."""

    path: str
    batch_bytes: int = 1 << 20
    remembered: int = 300_000


_AFTER_SPACE = re.compile(r"\s ")
_SAFE = re.compile(r"(?<=\S)(?= )")
_SAFE_TOO = re.compile(r"(?<=\S)(?=\s)")
LONG = 4096
SHORT = 64
_counters: dict = {}


class Counter:
    """Counts tokens of texts with one vocabulary; one a Python worker."""

    def __init__(self, how: Counting):
        from tokenizers import Tokenizer

        self.how, self.known = how, {}
        self.tokenizer = Tokenizer.from_file(local_file(how.path))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(local_file(how.path), encoding="utf-8") as file:
            config = json.load(file)
        pre = config.get("pre_tokenizer") or {}
        self.cuts = config.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.cuts = self.cuts and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) for x in config.get("added_tokens", []))

    def pieces(self, text: str) -> list[str]:
        if not self.cuts:
            return [text] if text else []
        if _AFTER_SPACE.search(text) or text[:1] == " ":
            cut = _SAFE.split(text) if text else []
        else:
            first, *rest = text.split(" ")
            cut = [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
        if max(map(len, cut), default=0) > LONG:
            cut = [y for x in cut for y in (_SAFE_TOO.split(x) if len(x) > LONG else [x])]
        return cut

    def learn(self, pieces: list[str]) -> dict[str, int]:
        """Counts of pieces not known yet, in library calls bounded by bytes."""
        found, batch, size = {}, [], 0
        for piece in [*pieces, None]:
            if piece is not None:
                batch.append(piece)
                size += len(piece.encode())
            if batch and (piece is None or size >= self.how.batch_bytes):
                for text, encoding in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                    found[text] = len(encoding)
                batch, size = [], 0
        return found

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        start, size = 0, 0
        for at, text in enumerate(texts):  # groups balanced by size: what one round holds is bounded
            size += len(text)
            if size >= 4 * self.how.batch_bytes or at + 1 == len(texts):
                out += self._count(texts[start : at + 1])
                start, size = at + 1, 0
        return out

    def _count(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(x) for x in texts]
        known = self.known
        new = self.learn([*{p for c in cut for p in c if p not in known}])
        if len(known) + len(new) > self.how.remembered:
            totals = [sum(known[p] if p in known else new[p] for p in c) for c in cut]
            if len(new) <= self.how.remembered:
                self.known = {p: n for p, n in new.items() if len(p) <= SHORT}
            return totals
        totals = [sum(known[p] if p in known else new[p] for p in c) for c in cut]
        known.update((p, n) for p, n in new.items() if len(p) <= SHORT)
        return totals


def counted(text: Column, how: Counting) -> Column:
    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = _counters.get(how) or _counters.setdefault(how, Counter(how))
        for batch in batches:
            yield pa.array(counter.count(batch.to_pylist()), pa.int64())
        counter.known = {}  # a worker lives on when its task ends

    return lengths(F.coalesce(text, F.lit("")))


def token_counts(df: DataFrame, how: Counting, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``; a column of that name in ``df`` is replaced."""
    tune(df.sparkSession)
    ship_file(df.sparkSession, how.path)
    return df.withColumn("n_tokens", counted(F.col(text), how))

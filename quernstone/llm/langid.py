"""Language identification by hyperdimensional profiles.

Every letter, of any script, has a random bipolar vector of its own, drawn from its code point; what
is no letter is one blank. A character trigram is the element-wise product (binding) of its letters'
vectors, each rotated by the letter's place; a text is the sum (bundle) of its trigrams' vectors; a
language's prototype is the sum of the unit vectors of its texts. A text takes the language whose
prototype has the largest cosine with it. The bundles of many texts are one product of matrices, whose
entries are whole numbers, so a text's vector doesn't depend on the texts beside it.

Cases: a null or empty text or one without a letter is ``und`` with score 0. Rows whose ``lang`` or text
is null, or whose text has no letter, teach nothing. With no teaching row at all every text is
``und``; an empty table gives an empty result. Equal cosines go to the smallest language name. Texts of
any length are read whole. Repeated rows are predicted alike and each counts when learning. Extra
columns of any name pass through, but for ``lang_pred`` and ``score``, which are replaced. More than
``max_langs`` languages raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tune, with_columns

UNKNOWN = "und"
_SCALE = 1 << 20


@dataclass(frozen=True)
class Profile:
    """``dim`` components a vector, seed of the letters, sharpness of the score; most languages; letters whose vectors are kept, trigrams and texts bound at once."""

    dim: int = 2048
    seed: int = 20240229
    sharpness: float = 40.0
    max_langs: int = 2_000
    letters: int = 4096
    grams: int = 2048
    texts: int = 128


@dataclass(frozen=True)
class Model:
    profile: Profile
    langs: tuple[str, ...]
    prototypes: np.ndarray  # a unit vector a language


_tables: dict = {}
_MASK = (1 << 21) - 1


class Encoder:
    """Vectors of texts; one a Python worker."""

    def __init__(self, profile: Profile):
        self.profile = profile
        self.letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), np.bool_, 0x110000)
        self.known: dict[int, np.ndarray] = {}

    def vectors(self, points: np.ndarray) -> np.ndarray:
        """The vector of each code point, a row each; 0 is the blank."""
        if len(self.known) + len(points) > self.profile.letters:
            self.known.clear()
        for point in points.tolist():
            if point not in self.known:
                bits = np.random.default_rng([self.profile.seed, point]).integers(0, 2, self.profile.dim, np.int8)
                self.known[point] = 2 * bits - 1
        return np.stack([self.known[p] for p in points.tolist()])

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigrams (three code points in one number) and their counts; None without letters."""
        if not text:
            return None
        s = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        s = np.where(self.letter[s], s, 0)
        if not s.any():
            return None
        s = np.concatenate(([0], s, [0]))
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        return np.unique(s[:-2] << 42 | s[1:-1] << 21 | s[2:], return_counts=True)

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """The vector of each trigram, a row each."""
        out = np.ones((len(grams), self.profile.dim), np.int8)
        for place in range(3):
            points, at = np.unique(grams >> 21 * (2 - place) & _MASK, return_inverse=True)
            out *= np.roll(self.vectors(points), 2 - place, axis=1)[at]
        return out.astype(np.float32)

    def encode(self, texts: list) -> list[np.ndarray | None]:
        """Unit vector of each text; None without letters."""
        out: list = []
        for low in range(0, len(texts), self.profile.texts):
            out += self._encode([self.trigrams(x) for x in texts[low : low + self.profile.texts]])
        return out

    def _encode(self, found: list) -> list[np.ndarray | None]:
        some = [i for i, x in enumerate(found) if x is not None]
        if not some:
            return [None] * len(found)
        sizes = [len(found[i][0]) for i in some]
        grams, column = np.unique(np.concatenate([found[i][0] for i in some]), return_inverse=True)
        counts, row = np.concatenate([found[i][1] for i in some]), np.repeat(np.arange(len(some)), sizes)
        total = np.zeros((len(some), self.profile.dim))
        # sums of whole numbers below 2 ** 24 are exact in single precision
        kind = np.float32 if max(int(found[i][1].sum()) for i in some) < 1 << 24 else np.float64
        for low in range(0, len(grams), self.profile.grams):
            part = grams[low : low + self.profile.grams]
            here = (column >= low) & (column < low + len(part))
            table = np.zeros((len(some), len(part)), kind)
            table[row[here], column[here] - low] = counts[here]
            total += table @ self.bound(part).astype(kind, copy=False)
        norms = np.sqrt((total * total).sum(axis=1))
        out: list = [None] * len(found)
        for k, i in enumerate(some):
            out[i] = total[k] / norms[k] if norms[k] else total[k]
        return out


def encoder(profile: Profile) -> Encoder:
    if profile not in _tables:
        _tables[profile] = Encoder(profile)
    return _tables[profile]


def fit(df: DataFrame, profile: Profile = Profile(), text: str = "text", lang: str = "lang") -> Model:
    """Prototypes from all rows of ``df``; each task sends one integer vector a language."""
    tune(df.sparkSession)
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, vector in zip(batch.column(0).to_pylist(), encoder(profile).encode(batch.column(1).to_pylist()), strict=True):
                if vector is not None:
                    part = np.rint(vector * _SCALE).astype(np.int64)
                    sums[name] = sums[name] + part if name in sums else part
        for name, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name], "total": pa.array([total], pa.list_(pa.int64()))})

    parts = rows.mapInArrow(bundle, "lang string, total array<bigint>")
    summed = parts.select("lang", F.posexplode("total").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    whole = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("total")).select("lang", F.col("total.value").alias("total"))
    got = {r["lang"]: np.array(r["total"], np.float64) for r in whole.limit(profile.max_langs + 1).collect()}  # dim numbers a language
    if len(got) > profile.max_langs:
        raise ValueError(f"more than {profile.max_langs} languages")
    langs = tuple(sorted(x for x in got if np.linalg.norm(got[x]) > 0))
    units = [got[x] / np.linalg.norm(got[x]) for x in langs]
    return Model(profile, langs, np.array(units, np.float64).reshape(len(langs), profile.dim))


def predictions(model: Model, texts: list) -> list[tuple[str, float]]:
    """Language and score (a softmax of the cosines, 0 to 1) of each text."""
    out = []
    for vector in encoder(model.profile).encode(texts) if model.langs else [None] * len(texts):
        if vector is None:
            out.append((UNKNOWN, 0.0))
            continue
        cosines = model.prototypes @ vector
        weights = np.exp((cosines - cosines.max()) * model.profile.sharpness)
        best = int(np.argmax(cosines))
        out.append((model.langs[best], float(weights[best] / weights.sum())))
    return out


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``; columns of these names in ``df`` are replaced."""
    tune(df.sparkSession)
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    rows = df.select(*(F.col(f"`{c}`") for c in kept))
    return with_columns(rows, text, "lang_pred string, score double", ["lang_pred", "score"], [pa.string(), pa.float64()], lambda: lambda texts: predictions(model, texts))

"""Personal data: candidate spans, boosted trees, calibrated thresholds; DataFrame operations alone.

Base spans come from one pattern a kind and its check (parts at most 255, Luhn, number of digits),
leftmost and non-overlapping a kind; matches that fail the check go. Generators propose further,
overlapping candidates: items run together with other digits, written without a plus sign, with
``[at]`` and ``dot``, and, as a further kind, secrets (long tokens of letters and digits). Format and
context features of a candidate are small numbers, packed into a cell.

Trees learn from examples: a candidate that is a base span is a positive one (a secret: one that
follows a word such as ``token``), a candidate that fails its check a negative one. Each positive
example is planted again in other forms, with the same surroundings: written as people obfuscate it
(positive), and broken or put behind a word of another meaning (negative). Candidates that pass
their check and are no base span have no label; they are what the trees decide on. A quarter of the
examples, by hash of the value, grows no tree: on it the scores are calibrated (isotonic, a kind at a
time), and a kind's threshold is the least score with the wanted precision; a kind with too few held
out examples to show that precision takes the threshold of all kinds together. A candidate that is a
positive example itself is chosen whatever its score, so small tables lose none. Chosen candidates that
touch a base span go, and of those that overlap each other the leftmost, then longest, stays.

Only counts a cell and label come to the driver, where the trees grow: of all rows, no sample; at
most 2 ** 19 cells, of which real texts fill some hundreds.

Cases: a null text counts as empty. Offsets are code points, end exclusive. Repeated rows give the
same spans; ties are settled by start, kind and end. With no candidate, or none of a kind that is
likely, nothing is added; an empty table gives an empty result. Extra columns of any name pass through
``redact`` untouched and are ignored elsewhere. Patterns have possessive loops and arrays are folded in
blocks, so texts of any length, with any number of matches, are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import scanned, staged

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the trees find.
LEARNED = ("secret",)
ALL = KINDS + LEARNED

# Base patterns. Possessive loops where nothing could be given back; an e-mail's local part starts
# where its run of characters starts or where the match before ended, as a leftmost search would.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:@|\x20?[(\[][aA][tT][)\]]\x20?|\x20[aA][tT]\x20)"
_DOT = r"(?:\.|\x20?[(\[](?:\.|[dD][oO][tT])[)\]]\x20?|\x20[dD][oO][tT]\x20)"
#: Generators of candidates, several a kind; their matches may overlap.
WIDE = {
    "email": [rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+)++"],
    "ip": [r"(?<![0-9A-Za-z.])[0-9]{1,3}+(?:(?:\.|\[\.\])[0-9]{1,3}+){3}+(?![0-9A-Za-z])"],
    "card": [r"(?<![0-9A-Za-z])[0-9]{13,19}+(?![0-9A-Za-z])", r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?![0-9A-Za-z])"],
    "phone": [r"(?<![0-9A-Za-z.+])(?:(?:\+|00\x20?)[0-9]{1,3}+[\x20.-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![.-]?[0-9A-Za-z])"],
    "secret": [r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{20,}+"],
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": r"@|(?i:[(\[]at[)\]]|\x20dot\x20)", "ip": r"[0-9](?:\.|\[\.\])[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"[0-9]", "secret": r"[0-9]"}
#: Words before a candidate that speak for its kind, and words that speak for something else.
SPEAKS = {"email": "(?i)mail|contact|write|reach", "ip": r"(?i)\bip\b|host|server|addr", "card": "(?i)card|visa|credit|debit|account|pay", "phone": "(?i)phone|tel|call|mobile|fax|contact", "secret": "$^"}
ELSE = r"(?i)version|release|order|invoice|isbn|issue|serial|build|page|section|date"
NAMED = r"(?i)(?:token|key|secret|passw(?:or)?d|pwd|auth|bearer|credentials?)[\"']?[\x20:=\"']{1,6}$"
GROUPED = {"email": "^[^\x20]*$", "ip": r"^(?:0|[1-9][0-9]*+)(?:\.(?:0|[1-9][0-9]*+)){3}$", "card": r"^(?:[0-9]++|[0-9]{4}(?:[\x20-][0-9]{4}){3})$", "phone": r"^(?:[^0-9]*[0-9]{1,3}[\x20.-])?[(]?[0-9]{3}[)]?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$", "secret": "^(?:[0-9a-f]++|[0-9A-F]++)$"}
#: Features: name and bits of each, from the lowest.
FEATURES = (("word", 2), ("separators", 2), ("left", 2), ("right", 2), ("digits", 3), ("checked", 1), ("mark", 2), ("grouped", 1), ("plain", 1))
BITS = sum(n for _, n in FEATURES)
#: Numbers of digits at which the feature rises.
DIGITS = (4, 7, 10, 13, 16, 17, 20)
NEGATIVE, POSITIVE, UNKNOWN = 0, 1, 2


@dataclass(frozen=True)
class Boosting:
    """``trees`` of ``depth``; ``rate``: step of a tree; ``share``: precision wanted of a kind's threshold; ``context``: characters read on either side; one of ``held`` examples calibrates."""

    trees: int = 30
    depth: int = 3
    rate: float = 0.4
    share: float = 0.9
    context: int = 24
    held: int = 4


@dataclass(frozen=True)
class Model:
    """Score of each cell seen, and the threshold of each kind."""

    scores: dict = field(default_factory=dict)
    thresholds: dict = field(default_factory=dict)

    def chosen(self) -> list[int]:
        return sorted(c for c, p in self.scores.items() if p >= self.thresholds.get(c >> BITS, math.inf))


# places

_PLACED = "array<struct<first:int,last:int,wide:int,value:string,left:string,right:string>>"


def located(gaps: str, matches: str, starts: str, wide: int, context: int) -> Column:
    """Places of a pattern's matches, with what stands right before and after; ``starts`` is where the gaps start."""

    def put(value: Column, i: Column) -> Column:
        gap = F.get(gaps, i)
        first = F.get(starts, i) + F.length(gap)
        return F.struct(first.alias("first"), (first + F.length(value)).alias("last"), F.lit(wide).alias("wide"), value.alias("value"), F.right(gap, F.lit(context)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(context)).alias("right"))

    return F.when(F.size(matches) > 0, F.transform(matches, put)).otherwise(F.array().cast(_PLACED))


# checks


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check sum of a string of digits holds."""
    points = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(points, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, value: Column, least: int = 14) -> Column:
    """The check of a kind; a card has at least ``least`` digits."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(least, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def holds(kind: str, value: Column) -> Column:
    """The check of a candidate, which may be written in other ways."""
    if kind == "email":
        return value.rlike(r"(?:\.|[dD][oO][tT][)\]]?\x20?|\.[)\]]\x20?)[A-Za-z]{2,24}$")
    if kind == "secret":
        return F.regexp_count(value, F.lit("[0-9](?=[A-Za-z])")) >= 3
    if kind == "phone":
        return valid(kind, F.regexp_replace(value, "^00", ""))
    return valid(kind, F.translate(value, "[]", "") if kind == "ip" else value, 13)


# candidates


def read(kind: str, x: Column) -> Column:
    """What the features of a form are read from."""
    digits, other = _digits(x["value"]), F.regexp_replace(x["value"], "[A-Za-z0-9]", "")
    named = {"left": x["left"], "value": x["value"], "right": F.left(x["right"], F.lit(1)), "digits": digits, "other": other, "n": F.length(digits), "checked": holds(kind, x["value"]), "label": x["label"]}
    return F.struct(*(c.alias(n) for n, c in named.items()))


def cell(kind: str, x: Column) -> Column:
    """The kind and features of a form in one number."""
    edge = lambda c, space, inner: F.when((c == "") | c.rlike(space), 0).when(c.rlike(inner), 1).when(c.rlike("[A-Za-z0-9_]"), 3).otherwise(2)
    first = F.left(x["other"], F.lit(1))
    parts = {
        "word": F.when(x["left"].rlike(SPEAKS[kind]), 1).when(x["left"].rlike(ELSE), 2).otherwise(0),
        "separators": F.when(x["other"].rlike(r"[()\[\]]"), 3).when(x["other"] == "", 0).when(F.replace(x["other"], first, F.lit("")) == "", 1).otherwise(2),
        "left": edge(F.right(x["left"], F.lit(1)), r"\s", r"[(<\[\"':=,;|]"),
        "right": edge(x["right"], r"[\s.]", r"[)>\]\"':,;!?|]"),
        "digits": F.size(F.filter(F.array(*map(F.lit, DIGITS)), lambda least: x["n"] >= least)),
        "checked": x["checked"].cast("int"),
        "mark": F.when(x["value"].startswith("+"), 1).when(x["value"].startswith("("), 2).when(x["value"].startswith("00"), 3).otherwise(0),
        "grouped": x["value"].rlike(GROUPED[kind]).cast("int"),
        "plain": (F.length(F.replace(x["digits"], F.left(x["digits"], F.lit(1)), F.lit(""))) <= 1).cast("int"),  # one digit, again and again
    }
    packed, at = F.lit(ALL.index(kind) << BITS), 0
    for name, bits in FEATURES:
        packed = packed + F.shiftleft(parts[name], at)
        at += bits
    return packed.cast("int")


def planted(kind: str, left: Column, value: Column, right: Column) -> list[tuple[Column, Column, Column, int]]:
    """A positive example in other forms: as people write it to hide it, and so that it is none."""
    swap, other = F.regexp_replace, F.lit("release ")
    if kind == "email":
        hidden, spoken = swap(swap(value, "@", " [at] "), r"\.(?=[^@\[]*$)", " [dot] "), swap(swap(value, "@", " at "), r"(?<= at [^.]{0,63})\.", " dot ")
        return [(left, hidden, right, POSITIVE), (left, spoken, right, POSITIVE), (left, swap(value, "@.*$", " at 4 dot 5"), right, NEGATIVE), (other, swap(value, "@.*$", "@4.17"), right, NEGATIVE)]
    if kind == "ip":
        return [(left, swap(value, r"\.", "[.]"), right, POSITIVE), (other, value, right, NEGATIVE), (left, swap(value, "^[0-9]+", "640"), right, NEGATIVE)]
    if kind == "card":
        solid, four = _digits(value), "^([0-9]{4})([0-9]{4})([0-9]{4})([0-9]{4})$"
        broken = F.concat(F.left(solid, F.length(solid) - 1), F.pmod(F.right(solid, F.lit(1)).cast("int") + 1, F.lit(10)).cast("string"))
        return [(left, swap(solid, four, "$1 $2 $3 $4"), right, POSITIVE), (left, swap(solid, four, "$1.$2.$3.$4"), right, POSITIVE), (left, broken, right, NEGATIVE)]
    if kind == "phone":
        bare = swap(value, "^\\+[0-9]{1,3}[\x20.-]?", "")
        return [(left, swap(value, "^\\+", "00"), right, POSITIVE), (left, bare, right, POSITIVE), (left, F.right(value, F.lit(8)), right, NEGATIVE), (other, bare, right, NEGATIVE)]
    return [(left, F.translate(value, "0123456789", "eeaaoottnn"), right, NEGATIVE)]


def _marked(both: str) -> Column:
    """The candidates among base spans and candidates in order of place, each once, and whether it is a base span."""
    key = lambda x: F.shiftleft(x["first"].cast("long"), 32) + x["last"]
    state = F.struct(F.lit(-1).cast("long").alias("base"), F.lit(-1).cast("long").alias("seen"))
    after = lambda s, x: F.struct(F.when(x["wide"] == 0, key(x)).otherwise(s["base"]).alias("base"), F.when(x["wide"] == 1, key(x)).otherwise(s["seen"]).alias("seen"))
    first = lambda s, x: F.when((x["wide"] == 0) | (s["seen"] == key(x)), 0).when(s["base"] == key(x), 1).otherwise(2)
    put = lambda x, what: F.struct(*(x[c].alias(c) for c in ("first", "last", "value", "left", "right")), what.alias("what"))
    return F.filter(F.zip_with(both, scanned(both, state, after, first, "int"), put), lambda x: x["what"] > 0)


def _forms(kind: str, x: Column) -> Column:
    """The forms of a candidate: its own, labelled, and, if it is a positive example, the planted ones."""
    sure = x["what"] == 1 if kind in KINDS else x["left"].rlike(NAMED)
    form = lambda left, value, right, label: F.struct(left.alias("left"), value.alias("value"), right.alias("right"), label.alias("label"))
    around = x["left"], x["value"], x["right"]
    more = [form(*what, F.lit(label)) for *what, label in planted(kind, *around)]
    forms = F.when(sure, F.array(form(*around, F.lit(POSITIVE)), *more)).otherwise(F.array(form(*around, F.lit(UNKNOWN))))
    return F.struct(x["first"].alias("first"), x["last"].alias("last"), x["value"].alias("value"), forms.alias("forms"))


def _read(kind: str, x: Column) -> Column:
    return F.struct(x["first"].alias("first"), x["last"].alias("last"), x["value"].alias("value"), F.transform(x["forms"], lambda f: read(kind, f)).alias("forms"))


def _celled(k: int, kind: str, x: Column, held: int) -> Column:
    """Place, kind and cell of a candidate, and the codes of its forms: cell, whether it is held out, label."""
    label = lambda f: F.when((f["label"] == POSITIVE) & ~f["checked"], UNKNOWN).when((f["label"] == UNKNOWN) & ~f["checked"], NEGATIVE).otherwise(f["label"])
    out = F.when(F.pmod(F.xxhash64(x["value"]), F.lit(held)) == 0, 4).otherwise(0)
    codes = F.transform(x["forms"], lambda f: cell(kind, f) * 8 + out + label(f))
    return F.struct(x["first"].alias("first"), x["last"].alias("last"), F.lit(k).alias("kind"), codes.alias("codes"))


def with_candidates(df: DataFrame, text: Column, how: Boosting = Boosting()) -> DataFrame:
    """The columns of ``df`` (whose names don't start with ``_``), ``_base``: array of (first, kind, last) in order, ``_wide``: (first, last, kind, cell, sure: whether it is a positive example itself), ``_examples``: codes."""
    kept, each = [F.col(f"`{c}`") for c in df.columns], list(enumerate(ALL))
    body, none = F.col("_t"), F.array().cast("array<string>")
    patterns = {**{f"_b{k}": (kind, BASE[kind]) for k, kind in enumerate(KINDS)}, **{f"_w{k}{i}": (kind, p) for k, kind in each for i, p in enumerate(WIDE[kind])}}
    found = [F.when(body.rlike(NEEDS[kind]), F.regexp_extract_all(body, F.lit(p), F.lit(0))).otherwise(none).alias(name) for name, (kind, p) in patterns.items()]
    out = df.select(*kept, F.coalesce(text, F.lit("")).alias("_t")).select(*kept, "_t", *found)
    gaps = [F.when(F.size(name) > 0, F.split(body, p, -1)).otherwise(none).alias(f"{name}g") for name, (_, p) in patterns.items()]
    out = out.select(*kept, *patterns, *gaps)
    long = lambda name: lambda gap, i: F.length(gap) + F.coalesce(F.length(F.get(name, i)), F.lit(0))
    out = out.select("*", *(F.transform(f"{name}g", long(name)).alias(f"{name}n") for name in patterns))
    out = out.select("*", *(scanned(f"{name}n", F.lit(0), lambda at, n: at + n, lambda at, n: at, "int").alias(f"{name}s") for name in patterns))
    out = out.select(*kept, *(located(f"{name}g", name, f"{name}s", int(name.startswith("_w")), how.context).alias(name) for name in patterns))
    good = lambda kind: lambda x: valid(kind, x["value"])
    out = out.select(*kept, *(n for n in patterns if n.startswith("_w")), *(F.filter(f"_b{k}", good(kind)).alias(f"_b{k}") for k, kind in enumerate(KINDS)))
    both = [F.sort_array(F.concat(*([f"_b{k}"] if kind in KINDS else []), *(n for n in patterns if n.startswith(f"_w{k}")))).alias(f"_u{k}") for k, kind in each]
    span = lambda k: lambda x: F.struct(x["first"].alias("first"), F.lit(k).alias("kind"), x["last"].alias("last"))
    base = F.sort_array(F.concat(*(F.transform(f"_b{k}", span(k)) for k in range(len(KINDS)))))
    out = out.select(*kept, base.alias("_base"), *both).select(*kept, "_base", *(_marked(f"_u{k}").alias(f"_u{k}") for k, _ in each))
    mapped = lambda step, kind: lambda x: step(kind, x)
    codes = lambda k, kind: lambda x: _celled(k, kind, x, how.held)
    for step in (_forms, _read):
        out = out.select(*kept, "_base", *(F.transform(f"_u{k}", mapped(step, kind)).alias(f"_u{k}") for k, kind in each))
    out = out.select(*kept, "_base", F.concat(*(F.transform(f"_u{k}", codes(k, kind)) for k, kind in each)).alias("_u"))
    slim = F.transform("_u", lambda x: F.struct(x["first"], x["last"], x["kind"], F.shiftright(F.get(x["codes"], 0), 3).alias("cell"), (F.get(x["codes"], 0).bitwiseAND(3) == POSITIVE).alias("sure")))
    return out.select(*kept, "_base", slim.alias("_wide"), F.flatten(F.transform("_u", lambda x: x["codes"])).alias("_examples"))


# trees


def features_of(cells: np.ndarray) -> np.ndarray:
    """A row a cell: whether it is of each kind, then the features."""
    columns = [(cells >> BITS == k).astype(np.int64) for k in range(len(ALL))]
    at = 0
    for _, bits in FEATURES:
        columns.append(cells >> at & ((1 << bits) - 1))
        at += bits
    return np.stack(columns, axis=1)


def boosted(features: np.ndarray, n: np.ndarray, hits: np.ndarray, how: Boosting) -> np.ndarray:
    """Log-odds of each row: trees grown by the second-order logistic loss of ``hits`` in ``n``."""
    score = np.zeros(len(features))
    tests = [(f, v) for f in range(features.shape[1]) for v in np.unique(features[:, f])[:-1].tolist()]

    def grow(rows: np.ndarray, depth: int) -> None:
        g, h = slope[rows], curve[rows]
        best, split = 1e-9, None
        for f, v in tests if depth else ():
            low = features[rows, f] <= v
            if low.any() and not low.all():
                a, b, c, d = g[low].sum(), h[low].sum(), g[~low].sum(), h[~low].sum()
                gain = a * a / (b + 1) + c * c / (d + 1) - (a + c) ** 2 / (b + d + 1)
                if gain > best:
                    best, split = gain, low
        if split is None:
            step[rows] = how.rate * g.sum() / (h.sum() + 1)
            return
        grow(rows[split], depth - 1)
        grow(rows[~split], depth - 1)

    for _ in range(how.trees if len(features) else 0):
        p = 1 / (1 + np.exp(-score))
        slope, curve, step = hits - n * p, n * p * (1 - p), np.zeros(len(features))
        grow(np.arange(len(features)), how.depth)
        score = np.clip(score + step, -8, 8)
    return score


def calibrated(score: np.ndarray, n: np.ndarray, hits: np.ndarray) -> list[tuple[float, float, float]]:
    """Score, rows and hits of the steps of the isotonic fit, by rising score (adjacent violators pooled)."""
    steps: list[list[float]] = []
    for s in np.unique(score[n > 0]).tolist():
        same = (score == s) & (n > 0)
        steps.append([s, float(n[same].sum()), float(hits[same].sum())])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            _, more, good = steps.pop()
            steps[-1] = [steps[-1][0], steps[-1][1] + more, steps[-1][2] + good]
    return [tuple(x) for x in steps]


def fitted(counts: dict[int, int], how: Boosting = Boosting()) -> Model:
    """Trees and thresholds from the number of rows of each code (cell, whether held out, label)."""
    cells = np.array(sorted({code >> 3 for code in counts}), np.int64)
    if not len(cells):
        return Model()
    at = {c: i for i, c in enumerate(cells.tolist())}
    n, hits = np.zeros((2, len(cells))), np.zeros((2, len(cells)))
    for code, rows in counts.items():
        if code & 3 != UNKNOWN:
            n[code >> 2 & 1, at[code >> 3]] += rows
            hits[code >> 2 & 1, at[code >> 3]] += rows * (code & 3 == POSITIVE)
    # counts of a cell enter by their logarithm, so that common cells don't drown the planted forms
    weight = np.log1p(n[0]) / np.maximum(n[0], 1)
    score = np.round(boosted(features_of(cells), n[0] * weight, hits[0] * weight, how), 9)
    thresholds = {}
    least = (2 * how.share - 1) / (1 - how.share)  # good rows of a kind that its share can't be shown without
    for k in range(len(ALL)):
        mine = cells >> BITS == k
        if hits[1][mine].sum() < least:
            mine = np.ones(len(cells), bool)
        for s, rows, good in calibrated(score[mine], n[1][mine], hits[1][mine]):
            if (good + 1) / (rows + 2) >= how.share:
                thresholds[k] = max(s, 0.0)  # never below even odds
                break
    return Model(dict(zip(cells.tolist(), score.tolist(), strict=True)), thresholds)


def fit(candidates: DataFrame, how: Boosting = Boosting()) -> Model:
    """The model of a table with ``_examples``: only counts a code come to the driver."""
    rows = candidates.select(F.explode("_examples").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()
    return fitted({r["code"]: r["n"] for r in rows}, how)


# spans

def with_spans(candidates: DataFrame, model: Model) -> DataFrame:
    """``candidates`` with ``_spans``: base and selected spans (first, kind, last), in order.

    Of the chosen candidates those that touch no base span count; of these, where they overlap, the
    leftmost, then longest. Two folds over both in order of place: from the right, where the next base
    span starts; from the left, where the last span that stays ends.
    """
    cells = F.array(*map(F.lit, model.chosen())).cast("array<int>")
    kept = [F.col(f"`{c}`") for c in candidates.columns if c not in ("_wide", "_examples")]
    picked = candidates.select(*kept, F.filter("_wide", lambda x: x["sure"] | F.array_contains(cells, x["cell"])).alias("_more"))
    mark = lambda added: lambda x: F.struct(x["first"].alias("first"), F.lit(added).alias("added"), (-x["last"]).alias("back"), x["kind"].alias("kind"))
    both = F.reverse(F.sort_array(F.concat(F.transform("_base", mark(0)), F.transform("_more", mark(1)))))
    none = F.array().cast("array<struct<first:int,added:int,back:int,kind:int>>")
    picked = picked.select(*kept, "_more", F.when(F.size("_more") > 0, both).otherwise(none).alias("_both"))
    ahead = scanned("_both", F.lit(2**31 - 1), lambda at, x: F.when(x["added"] == 0, x["first"]).otherwise(at), lambda at, x: at, "int")
    put = lambda x, at: F.struct(x["first"].alias("first"), x["added"].alias("added"), x["kind"].alias("kind"), (-x["back"]).alias("last"), at.alias("ahead"))
    picked = picked.select(*kept, "_more", F.reverse(F.zip_with("_both", ahead, put)).alias("_both"))
    stays = lambda at, x: (x["added"] == 0) | ((x["first"] >= at) & (x["last"] <= x["ahead"]))
    swept = scanned("_both", F.lit(0), lambda at, x: F.when(stays(at, x), F.greatest(at, x["last"])).otherwise(at), stays, "boolean")
    span = lambda x, keep: F.when(keep, F.struct(x["first"].alias("first"), x["kind"].alias("kind"), x["last"].alias("last")))
    spans = F.when(F.size("_more") == 0, F.col("_base")).otherwise(F.sort_array(F.filter(F.zip_with("_both", swept, span), lambda x: x.isNotNull())))
    return picked.select(*kept, spans.alias("_spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, ALL))
    each = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["first"].cast("string"), x["last"].cast("string")))
    return F.array_join(each, ",")


def personal_data(df: DataFrame, how: Boosting = Boosting()) -> DataFrame:
    """A row a document: base counts and digest, all spans of the base kinds, number and spans of secrets, and of all spans."""
    rows = df.select(F.col("doc_id"), F.col("text").alias("_text"))
    found = staged(with_candidates(rows, F.col("_text"), how).select("doc_id", "_base", "_wide", "_examples"), "spans")
    of = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter("_base", of(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    digest = F.sha2(listed(F.col("_base")).cast("binary"), 256)
    secret = lambda wanted: F.filter("_spans", lambda x: (x["kind"] >= len(KINDS)) == wanted)
    done = with_spans(found, fit(found, how))
    more = [F.size(secret(True)).cast("long").alias("n_secret"), listed(secret(True)).alias("secret_spans"), F.size("_spans").cast("long").alias("n_spans")]
    return done.select("doc_id", *counts, digest.alias("base_sha256"), listed(secret(False)).alias("spans"), *more)


CHUNK = 4096


def chunked(text: Column) -> Column:
    """The text in pieces of CHUNK characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def redacted(text: Column, chunks: str, spans: str) -> Column:
    """The text with each span replaced by its kind's mark; of spans that overlap, the first's mark stands for all.

    ``chunks`` is a column of ``chunked``, so that what lies between two spans is found without
    reading the text from its start.
    """
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in ALL))

    def between(low: Column, high: Column) -> Column:
        first = F.floor(low / CHUNK).cast("int")
        some = F.slice(chunks, first + 1, F.greatest(F.lit(0), F.ceil(high / CHUNK).cast("int") - first))
        skip = lambda i: F.greatest(F.lit(0), low - (first + i) * CHUNK)
        cut = lambda c, i: F.substring(c, skip(i) + 1, F.least(F.lit(CHUNK), high - (first + i) * CHUNK) - skip(i))
        return F.array_join(F.transform(some, cut), "")

    ends = scanned(spans, F.lit(0), lambda at, x: F.greatest(at, x["last"]), lambda at, x: at, "int")
    piece = lambda x, at: F.when(x["first"] >= at, F.concat(between(at, x["first"]), F.element_at(marks, x["kind"] + 1))).otherwise("")
    rest = between(F.array_max(F.transform(spans, lambda x: x["last"])), F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(F.zip_with(spans, ends, piece), ""), rest))


def redact(df: DataFrame, how: Boosting = Boosting()) -> DataFrame:
    """``df`` with personal data in ``text`` replaced and ``n_chars``, if there, counted anew; null texts stay null.

    Rows travel as one struct, so columns of any name keep their values.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    found = staged(with_candidates(df.select(row), F.col("row")["text"], how), "candidates")
    text = F.col("row")["text"]
    some = with_spans(found, fit(found, how)).select("row", "_spans", F.when(F.size("_spans") > 0, chunked(text)).otherwise(F.array().cast("array<string>")).alias("_chunks"))
    clean = some.select("row", F.size("_spans").alias("_n"), redacted(text, "_chunks", "_spans").alias("_clean"))
    changed = (F.col("_n") > 0) & F.col("_clean").isNotNull()
    own = {"text": F.col("_clean"), "n_chars": F.when(changed, F.length("_clean")).otherwise(F.col("row")["n_chars"]) if "n_chars" in df.columns else None}
    return clean.select(*((own[c].cast(df.schema[c].dataType) if c in own else F.col("row")[c]).alias(c) for c in df.columns))

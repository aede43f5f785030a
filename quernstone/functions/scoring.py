"""Scores of ranked retrieval as column expressions. Time is an explicit ``as_of``, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, half-lives in days, and cut-offs.
WEIGHTS = {"similarity": 0.4, "keyword": 0.3, "recency": 0.15, "domain": 0.15}
HALF_LIFE = {"memory": (30.0, 2.0), "task": (30.0, 2.0), "standard": (180.0, 2.718281828459045)}
THRESHOLDS = {"memory": (0.1, 0.4), "task": (0.08, 0.2), "standard": (0.08, 0.2)}
SMALL_POOL = 5
NO_OVERLAP = 0.16
SAME_REPO = 0.1
CONFIDENCE = (0.7, 0.4)
STANDARD_CONFIDENCE = (0.72, 0.42)
STANDARD_KEYWORD_CONFIDENCE = (0.85, 0.45)
UNACKNOWLEDGED, TASK_ARCHIVE = 0.15, 0.2
BM25_K1, BM25_B, BM25_FLOOR = 1.2, 0.75, 1e-6


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def age_days(at: Column, as_of: Column) -> Column:
    """Days between two times, as a double."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(as_of) - micros(at)) / 86_400_000_000


def decay(age: Column, half_life: float, base: float = 2.0) -> Column:
    """1 up to age 0, then base ** (-age / half-life)."""
    return F.when(age <= 0, 1.0).otherwise(clamp(F.pow(F.lit(base), -age / half_life)))


def recency(at: Column, as_of: Column, kind: str = "memory") -> Column:
    """Decay of a time; 0.5 without one."""
    half_life, base = HALF_LIFE[kind]
    return F.when(at.isNull(), 0.5).otherwise(decay(age_days(at, as_of), half_life, base))


def overlap(searched: Column, terms: Column) -> Column:
    """Share of the searched array's members that are terms; 0 of none."""
    hits = F.size(F.filter(searched, lambda x: F.array_contains(terms, F.lower(x))))
    return F.when(F.size(searched) == 0, 0.0).otherwise(hits / F.greatest(F.size(searched), F.lit(1)))


def coverage(words: Column, terms: Column) -> Column:
    """Share of the terms among the words, at most 1; 0 without terms."""
    hits = F.size(F.filter(terms, lambda x: F.array_contains(words, x)))
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.least(F.lit(1.0), hits / F.greatest(F.size(terms), F.lit(1))))


def blend(similarity: Column, keyword: Column, recency_: Column, domain: Column) -> Column:
    return similarity * WEIGHTS["similarity"] + keyword * WEIGHTS["keyword"] + recency_ * WEIGHTS["recency"] + domain * WEIGHTS["domain"]


def domain_adjusted(domain: Column, acknowledged: Column, type_: Column) -> Column:
    """More for what was never recalled, less for archived tasks, kept in 0..1."""
    return clamp(domain + F.when(acknowledged, 0.0).otherwise(UNACKNOWLEDGED) - F.when(type_ == "task_archive", TASK_ARCHIVE).otherwise(0.0))


def affinity(similarity: Column, row: dict[str, Column], wanted: dict) -> Column:
    """Similarity with boosts for what the request and the row have in common; at most 1."""
    boost = F.lit(0.0)
    path, query = (wanted.get("path") or "").lower(), (wanted.get("query") or "").lower()
    holds = lambda value, column: F.when((row[column] != "") & F.lit(value.lower()).contains(F.lower(row[column])), 0.15 if column == "folder" else 0.1).otherwise(0.0)
    if wanted.get("branch"):
        boost = boost + F.when(row["branch"] == wanted["branch"], 0.1).otherwise(0.0)
    if path:
        boost = boost + holds(path, "folder") + holds(path.rsplit(".", 1)[-1], "language")
    for column in ("folder", "language"):
        if value := wanted.get(column) or query:
            boost = boost + holds(value, column)
    if wanted.get("tags"):
        tags = F.array(*(F.lit(t.lower()) for t in wanted["tags"]))
        boost = boost + F.when(F.arrays_overlap(F.transform(row["tags"], F.lower), tags), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), similarity + boost)


def threshold(pool: Column, kind: str) -> Column:
    """Least score kept, by the size of the whole pool."""
    small, large = THRESHOLDS[kind]
    return F.when(pool <= SMALL_POOL, small).otherwise(large)


def confidence(score: Column, cuts: tuple[float, float] = CONFIDENCE) -> Column:
    return F.when(score >= cuts[0], "high").when(score >= cuts[1], "medium").otherwise("low")


def standard_confidence(score: Column, keyword: Column) -> Column:
    high, medium = STANDARD_CONFIDENCE
    k_high, k_medium = STANDARD_KEYWORD_CONFIDENCE
    return F.when((score >= high) | (keyword >= k_high), "high").when((score >= medium) | (keyword >= k_medium), "medium").otherwise("low")


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if their lengths differ or one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(F.try_divide(dot(a, b), norm))

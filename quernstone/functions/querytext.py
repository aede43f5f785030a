"""Parsers of query text; they run on the driver, once a query."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

MOST_TERMS = 8
MOST_REGEX = 200

# Synonyms of technical words.
SYNONYMS = {
    "update": ["migrate", "change", "alter", "modify", "patch", "upgrade"],
    "database": ["db", "sql", "schema", "persistence", "storage", "sqlite", "postgres"],
    "auth": ["login", "security", "token", "session", "permission", "authorization", "authentication", "system"],
    "authentication": ["auth", "login", "security", "token", "session", "permission"],
    "system": ["architecture", "structure", "design", "security"],
    "error": ["bug", "issue", "failure", "mistake", "fix", "exception"],
    "ui": ["frontend", "component", "styling", "css", "layout", "view"],
    "deploy": ["publish", "release", "ci", "cd", "pipeline"],
}


@dataclass(frozen=True)
class Tag:
    """An inline tag: its keys, the filter that it sets (one in another: ``outer``), and the type of its value."""

    keys: tuple[str, ...]
    sets: str
    outer: str | None = None
    type: type = str


# Inline tags of each kind of search.
TAGS = {
    "memory": [
        Tag(("tag", "tags"), "current_tags", type=list),
        Tag(("lang", "language"), "language", "scope"),
        Tag(("branch",), "branch", "scope"),
        Tag(("folder",), "folder", "scope"),
        Tag(("path",), "current_file_path"),
        Tag(("owner",), "owner", "scope"),
        Tag(("repo",), "repo", "scope"),
    ],
    "standard": [
        Tag(("language", "lang"), "language"),
        Tag(("framework", "stack"), "stack", type=list),
        Tag(("tag", "tags"), "tags", type=list),
        Tag(("context",), "context"),
        Tag(("version",), "version"),
        Tag(("is_global",), "is_global", type=bool),
        Tag(("owner",), "owner", "scope"),
        Tag(("repo",), "repo", "scope"),
    ],
    "code": [
        Tag(("language", "lang"), "language"),
        Tag(("kind",), "kind", type=list),
        Tag(("file", "path"), "filePath"),
    ],
}


def expanded(query: str, prompt: str | None = None) -> str:
    """The words, in order and once each, then the synonyms of those that have some."""
    words = re.split(r"\s+", f"{query} {prompt}".lower() if prompt else query.lower())
    more = [s for w in words for s in SYNONYMS.get(re.sub(r"[?.!,]", "", w), ())]
    return " ".join(dict.fromkeys([*words, *more]))


@dataclass(frozen=True)
class Match:
    """Phrases (adjacent tokens) and prefixes, all of which a row must have."""

    phrases: tuple[tuple[str, ...], ...] = ()
    prefixes: tuple[str, ...] = ()


def full_text(query: str) -> Match:
    """Quoted phrases, then each other word as a prefix; at most eight in all."""
    spaced = lambda s: re.sub(r"[^\w\s]", " ", s, flags=re.UNICODE).split()
    phrases = [tuple(spaced(p.lower())) for p in re.findall(r'"([^"]+)"', query)]
    phrases = [p for p in phrases if p][:MOST_TERMS]
    words = spaced(re.sub(r'"[^"]+"', " ", query).lower())
    return Match(tuple(phrases), tuple(words[: MOST_TERMS - len(phrases)]))


def plain_terms(query: str) -> list[str]:
    """Words of a query for an index without prefixes."""
    return re.sub(r"[^\w\s]", " ", query).lower().split()


@dataclass
class Tagged:
    query: str
    filters: dict = field(default_factory=dict)


def tagged(raw: str, kind: str) -> Tagged:
    """Split key:value tokens off a query; unknown keys stay in the text."""
    known = {key: tag for tag in TAGS[kind] for key in tag.keys}
    found = Tagged("")
    kept = []
    for token in (raw or "").split():
        key, colon, text = token.partition(":")
        tag = known.get(key.lower()) if colon and text else None
        if tag is None:
            kept.append(token)
            continue
        values = [v for v in map(str.strip, text.split(",")) if v]
        place = found.filters.setdefault(tag.outer, {}) if tag.outer else found.filters
        if tag.type is list:
            place[tag.sets] = list(dict.fromkeys([*place.get(tag.sets, ()), *values]))
        elif tag.type is bool:
            place[tag.sets] = values[:1] in (["true"], ["1"])
        else:
            place[tag.sets] = values[0] if values else None
    found.query = " ".join(kept)
    return found


def merged(structured: dict, inline: dict) -> dict:
    """Filters of both: lists are joined without repeats, of scalars the inline one counts."""
    out = dict(structured)
    for key, value in inline.items():
        if isinstance(value, list):
            out[key] = list(dict.fromkeys([*(out.get(key) or []), *value]))
        elif isinstance(value, dict):
            out[key] = {**(out.get(key) or {}), **value}
        else:
            out[key] = value
    return out


def inferred_mode(given: dict, rules: list[tuple[str, str]], default: str) -> str:
    """Mode of the first rule whose field is present (not None)."""
    return next((mode for name, mode in rules if given.get(name) is not None), default)


@dataclass(frozen=True)
class Window:
    query: str
    since: datetime | None = None
    until: datetime | None = None


# Relative dates. A named phrase is a number of units from the current one to its first
# and, if it ends, to its last; a counted one goes back so many units of days.
NAMED_DATES = [("last month", "month", -1, -1), ("last week", "week", -1, -1), ("this week", "week", 0, None), ("yesterday", "day", -1, -1), ("today", "day", 0, 0)]
COUNTED_DATES = [("week", 7), ("day", 1)]
LAST_HOUR = ("last_hour", "past_hour")


def _first_day(day: datetime, unit: str, steps: int) -> datetime:
    """The first day of the unit that lies so many steps from the one of a day."""
    if unit == "month":
        year, month = divmod(day.year * 12 + day.month - 1 + steps, 12)
        return day.replace(year=year, month=month + 1, day=1)
    if unit == "week":
        return day - timedelta(days=day.weekday()) + timedelta(weeks=steps)
    return day + timedelta(days=steps)


def time_window(query: str, as_of: datetime) -> Window | None:
    """A relative date phrase as a window; the phrase leaves the query. None without one.

    ``until`` is the last millisecond of a day and is compared exclusively.
    """
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)

    def without(place: re.Match, since: datetime, until: datetime | None = None) -> Window:
        return Window(" ".join(f"{query[: place.start()]}{query[place.end() :]}".split()), since, until)

    def look(phrase: str) -> re.Match | None:
        return re.search(rf"\b{phrase}\b", query or "", re.IGNORECASE)

    for words, unit, first, last in NAMED_DATES:
        if place := look(words):
            end = None if last is None else _first_day(day, unit, last + 1) - timedelta(milliseconds=1)
            return without(place, _first_day(day, unit, first), end)
    for unit, days in COUNTED_DATES:
        if place := look(rf"(?:last|past)\s+(\d+)\s+{unit}s?"):
            return without(place, day - timedelta(days=days * int(place[1])))
    place = look("(?:" + "|".join(LAST_HOUR) + ")")
    return without(place, as_of - timedelta(hours=1)) if place else None


def issue_numbers(query: str) -> list[int]:
    """Issues a query asks for: #12, issue 12, issues #12; ascending, once each."""
    return sorted({int(n) for n in re.findall(r"#(\d+)", query)} | {int(n) for n in re.findall(r"\bissues?\s+#?(\d+)", query, re.IGNORECASE)})


def safe_pattern(pattern: str) -> str:
    """The pattern, if it is short, compiles and has no quantifier inside a quantified group; else ValueError."""
    if not 0 < len(pattern) <= MOST_REGEX:
        raise ValueError(f"a pattern has 1 to {MOST_REGEX} characters")
    re.compile(pattern)
    bare = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "x", pattern)
    if re.search(r"\([^()]*[*+}][^()]*\)\s*(?:[*+]|\{\d*,)", bare):
        raise ValueError("a quantifier inside a quantified group may take exponential time")
    return pattern


def cursor(offset: int) -> str:
    import base64

    return base64.b64encode(str(offset).encode()).decode()


def offset_of(token: str | None) -> int:
    """Offset a cursor stands for; 0 of none or a damaged one."""
    import base64
    import binascii

    try:
        return max(0, int(base64.b64decode(token or "", validate=True).decode()))
    except (ValueError, binascii.Error):
        return 0


def page(number: int | None, size: int | None) -> tuple[int, int]:
    """Offset and limit of a page: numbers from 1, 1 to 100 rows, 20 unless asked otherwise."""
    limit = min(100, max(1, size if size is not None else 20))
    return (max(1, number or 1) - 1) * limit, limit

"""Doc comments, next steps, and plain-text reports; small texts, handled in Python."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DOC = "summary string, description array<string>, tags array<struct<tag:string,text:string>>, deprecated boolean"
# What a line of a comment may start with.
MARKS = ("///", "//!", "//", "#", "*")


def clean_doc(raw: str) -> list[str]:
    """Lines of a comment without its marks; empty ones go."""
    body = raw.strip()
    if body.startswith("/*"):
        body = body[2:].removeprefix("*")
    lines = (x.strip() for x in body.removesuffix("*/").split("\n"))
    bare = (x.removeprefix(next((m for m in MARKS if x.startswith(m)), "")).strip() for x in lines)
    return [x for x in bare if x]


def parse_doc(raw: str) -> dict:
    """Summary (first line that is no tag), description, @tags in order, and whether it is deprecated."""
    lines = clean_doc(raw)
    prose = [x for x in lines if not x.startswith("@")]
    tags = [dict(zip(("tag", "text"), (*x.split(None, 1), ""), strict=False)) for x in lines if x.startswith("@")]
    return {"summary": prose[0] if prose else None, "description": prose[1:], "tags": tags, "deprecated": any(t["tag"].lower().startswith("@deprecated") for t in tags)}


def serialized_doc(raw: str) -> str | None:
    """The comment in one canonical text that keeps all its words; None of an empty one."""
    doc = parse_doc(raw)
    head = [("[DEPRECATED] " if doc["deprecated"] else "") + doc["summary"]] if doc["summary"] else []
    return "\n".join([*head, *doc["description"], *[f"{t['tag']} {t['text']}".strip() for t in doc["tags"]]]) or None


def doc_struct(comment: Column) -> Column:
    """``parse_doc`` of a column, in Arrow batches."""

    kind = pa.struct([("summary", pa.string()), ("description", pa.list_(pa.string())), ("tags", pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())]))), ("deprecated", pa.bool_())])

    @F.arrow_udf(DOC)
    def parse(comments: pa.Array) -> pa.Array:
        return pa.array([parse_doc(x or "") for x in comments.to_pylist()], kind)

    return parse(comment)


def next_steps(steps: Column, most: int = 300) -> Column:
    """Steps (an array) in one text, cut with three dots; empty of none."""
    joined = F.coalesce(F.array_join(steps, "; "), F.lit(""))
    return F.when(F.length(joined) > most, F.concat(F.substring(joined, 1, most), F.lit("..."))).otherwise(joined)


def content_slice(content: Column, most: int = 2000) -> Column:
    """Struct of the first lines of a file and whether there were more."""
    lines = F.split(content, "\n")
    return F.struct(F.array_join(F.slice(lines, 1, most), "\n").alias("text"), (F.size(lines) > most).alias("truncated"))


def rendered_tree(rows: list[tuple[str, str, int]]) -> str:
    """An indented report of a directory rollup (directory, kind, n), which is small."""
    by: dict[str, list[str]] = {}
    for directory, kind, n in sorted(rows):
        by.setdefault(directory, []).append(f"{kind} {n}")
    name = lambda d: d.rsplit("/", 1)[-1] + "/" if d else "."
    return "\n".join("  " * (d.count("/") + 1 if d else 0) + f"{name(d)} ({', '.join(k)})" for d, k in sorted(by.items()))


def rendered_dead_code(totals: dict, dead: list[dict], hot: list[dict]) -> str:
    """A report of dead code and hotspots; empty if there is neither."""
    if not totals.get("scanned") and not hot:
        return ""
    lines = [f"Dead code: {totals.get('scanned', 0)} scanned, {totals.get('dead', 0)} dead, {totals.get('excluded', 0)} entry points"]
    lines += [f"- {d['kind']} {d['name']} {d['file_path']}:{d['start_line']}" for d in dead]
    lines += [f"Hotspots: {len(hot)}"] * bool(hot) + [f"- {h['kind']} {h['name']} {h['file_path']}, {h['total']} references" for h in hot]
    return "\n".join(lines)

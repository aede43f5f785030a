"""Analytics over indexed code: symbols, references, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources.manifests import entry_kind
from ..sources.stored import staged
from . import intervals

def filtered_symbols(symbols: DataFrame, kinds: list[str] | None = None, repos: list[str] | None = None, path: str | None = None, exported: bool = False) -> DataFrame:
    """Conjunctive filters; absent ones hold."""
    if kinds:
        symbols = symbols.where(F.col("kind").isin(kinds))
    if repos:
        symbols = symbols.where(F.col("repo").isin(repos))
    if path:
        symbols = symbols.where(F.col("file_path") == path)
    return symbols.where("exported") if exported else symbols


def with_prefix(symbols: DataFrame, prefix: str, kind: str | None = None) -> DataFrame:
    found = symbols.where(F.lower("name").startswith(prefix.lower()))
    return found.where(F.col("kind") == kind) if kind else found


def ranked_symbols(symbols: DataFrame, query: str) -> DataFrame:
    """``tier`` (1 exact, 2 camel case, 3 prefix, 4 substring, 5 other) and ``score`` within the tier.

    A tier of one row, or of equal rows, scores 0; without a query all are tier 1 with score 1.
    """
    q = query.strip()
    if not q:
        return symbols.withColumn("tier", F.lit(1)).withColumn("score", F.lit(1.0))
    import re

    low, name = q.lower(), F.lower("name")
    camel = bool(re.search(r"[a-z][A-Z]|[A-Z][a-z]", q))
    in_order = text.parts_in_order(F.col("name"), text.camel_parts(q)) if camel else F.lit(False)
    tier = F.when(name == low, 1).when(in_order, 2).when(name.startswith(low), 3).when(name.contains(low), 4).otherwise(5)
    raw = 0.6 + F.when(F.col("name") == q, 0.15).otherwise(0.0) + F.when(F.col("exported"), 0.2).otherwise(0.0) + 0.1 / F.size(F.split("file_path", "/"))
    inside = Window.partitionBy("tier")
    low_, high = F.min("_raw").over(inside), F.max("_raw").over(inside)
    score = F.when(high == low_, 0.0).otherwise(F.round((F.col("_raw") - low_) / F.nullif(high - low_, F.lit(0.0)), 4))
    return symbols.withColumn("tier", tier).withColumn("_raw", raw).withColumn("score", score).drop("_raw")


def searched_symbols(symbols: DataFrame, query: str, cap: int = 200) -> DataFrame:
    """Symbols whose name, comment, path or signature holds the query, at most ``cap``."""
    found = F.lit(False)
    for c in ("name", "doc_comment", "file_path", "signature"):
        found = found | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return symbols.where(found).orderBy("name", "id").limit(cap)


def searched_by_words(symbols: DataFrame, query: str, cap: int = 200) -> DataFrame:
    """``searched_symbols`` of the query; if it finds nothing, of its first word (of two characters or more) that does."""
    words = [w for w in query.split() if len(w) >= 2] if " " in query.strip() else []
    tries = [searched_symbols(symbols, q, cap).withColumn("_try", F.lit(i)) for i, q in enumerate([query, *words])]
    found = tries[0]
    for other in tries[1:]:
        found = found.unionByName(other)
    first = found.agg(F.min("_try").alias("_first"))  # one row; each try is at most ``cap`` rows
    return found.join(F.broadcast(first)).where("_try = _first").drop("_try", "_first")


def grep_with_symbols(files: DataFrame, symbols: DataFrame, query: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of the matches in order of file and line, each with its innermost symbol, and whether more follow."""
    matched = lines_of(files.where(F.lower("content").contains(query.lower()))).where(F.lower("line").contains(query.lower()))
    order = ["repo", "file_path", "line_no"]
    head = matched.select(*order).orderBy(*order).offset(offset).limit(limit + 1)  # one more tells whether it ends
    whole = Window.partitionBy()  # of the bounded page
    page = staged(head.withColumn("rank", F.row_number().over(whole.orderBy(*order))).withColumn("more", F.count("*").over(whole) > limit), "page")
    return enclosing(page.where(F.col("rank") <= limit), symbols, ["repo", "file_path"], "line_no", "rank")


def blended_with_vectors(ranked: DataFrame, similarity: DataFrame) -> DataFrame:
    """Score 0.3 vector + 0.7 text where a symbol has a vector; order inside each tier."""
    met = ranked.join(similarity.select("id", "similarity"), "id", "left")
    return met.withColumn("score", F.when(F.col("similarity").isNull(), F.col("score")).otherwise(0.3 * F.col("similarity") + 0.7 * F.col("score")))


def reference_counts(refs: DataFrame) -> DataFrame:
    """``symbol_name, total, kinds`` (map of counts)."""
    each = refs.groupBy("symbol_name", "kind").agg(F.count("*").alias("n"))
    return each.groupBy("symbol_name").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))


def top_references(refs: DataFrame, most: int) -> DataFrame:
    return refs.groupBy("symbol_name").agg(F.count("*").alias("total")).orderBy(F.col("total").desc(), "symbol_name").limit(most)


def lines_of(files: DataFrame, column: str = "content") -> DataFrame:
    """A row a line of each file, numbered from 1."""
    each = files.select(*[c for c in files.columns if c != column], F.posexplode(F.split(F.coalesce(F.col(column), F.lit("")), r"\r?\n")).alias("_p", "line"))
    return each.withColumn("line_no", F.col("_p") + 1).drop("_p")


def grep(files: DataFrame, query: str, regex: bool = False) -> DataFrame:
    """At most one match a line, without regard to case: ``file_path, line_no, at, snippet``.

    Files without the text are dropped before they are cut into lines.
    """
    if regex:
        from ..functions.querytext import safe_pattern

        pattern = f"(?i)({safe_pattern(query)})"
        found = lines_of(files.where(F.col("content").rlike(pattern))).where(F.col("line").rlike(pattern))
        hit = F.regexp_extract("line", pattern, 1)
        at = F.call_function("instr", F.col("line"), hit) - 1
        return found.select("file_path", "line_no", at.cast("int").alias("at"), text.snippet(F.col("line"), at, F.length(hit)).alias("snippet"))
    low = query.lower()
    found = lines_of(files.where(F.lower("content").contains(low))).where(F.lower("line").contains(low))
    at = F.locate(low, F.lower("line")) - 1
    return found.select("file_path", "line_no", at.alias("at"), text.snippet(F.col("line"), at, len(query)).alias("snippet"))


def enclosing(points: DataFrame, symbols: DataFrame, keys: list[str], line: str, point_id: str) -> DataFrame:
    """Each point with the innermost symbol around its line: smallest span, then earliest start, then id.

    Points and spans of a file are swept in order of line; points without a symbol keep nulls.
    """
    spans = symbols.select(*keys, F.col("id").alias("_span"), F.col("start_line").alias("_start"), F.col("end_line").alias("_end"))
    asked = points.select(*keys, F.col(point_id).alias("_point"), F.col(line).alias("_line"), F.col(line).alias("_until"), F.lit(None).cast("long").alias("_own"))
    found = intervals.stabbed(asked, spans, keys).where("_span IS NOT NULL").withColumnRenamed("_span", "symbol_id")
    size = F.struct(F.col("end_line") - F.col("start_line"), "start_line")
    names = symbols.groupBy(*keys, F.col("id").alias("symbol_id")).agg(F.min_by("name", size).alias("symbol"))  # ids may repeat in other files
    return points.join(found, F.col(point_id) == F.col("_point"), "left").drop("_point").join(names, [*keys, "symbol_id"], "left").select(*points.columns, "symbol_id", "symbol")


def parents(symbols: DataFrame, containers: list[str]) -> DataFrame:
    """``id, parent_id``: the closest container of the same file around each symbol, itself excluded.

    Of containers that enclose it, the last by start ascending and end descending.
    """
    keys = ["repo", "file_path"]
    spans = symbols.where(F.col("kind").isin(containers)).select(*keys, F.col("id").alias("_span"), F.col("start_line").alias("_start"), F.col("end_line").alias("_end"))
    asked = symbols.select(*keys, F.col("id").alias("_point"), F.col("start_line").alias("_line"), F.col("end_line").alias("_until"), F.col("id").alias("_own"))
    found = intervals.stabbed(asked, spans, keys, intervals.Closest)
    return symbols.select("id").join(found, F.col("id") == F.col("_point"), "left").select("id", F.col("_span").alias("parent_id"))


def dead_code(symbols: DataFrame, refs: DataFrame, entry_points: Column | None = None) -> DataFrame:
    """Top-level symbols whose name is never referred to in their repository; ``entry`` marks entry points."""
    used = refs.select("repo", F.col("symbol_name").alias("name")).distinct()
    dead = symbols.where("parent_symbol_id IS NULL").join(used, ["repo", "name"], "left_anti")
    return dead.withColumn("entry", entry_points if entry_points is not None else F.col("exported"))


# Languages whose references are extracted, under the names that files have.
REFERRING = "typescript typescriptreact javascript javascriptreact svelte astro c cpp dart go java kotlin php python ruby rust swift vue".split()


def dead_code_report(symbols: DataFrame, refs: DataFrame, manifests: DataFrame, files: DataFrame, scan: int = 500, most: int = 20) -> DataFrame:
    """Unreferenced top-level symbols of each repository, dead ones before entry points, at most ``most``.

    Only languages count that references are extracted from and that have some in the repository; the
    first ``scan`` symbols by file and line are looked at. ``entry``: public-api if exported, else the
    kind under which a manifest of the repository (``repo, file_path, kind``) names the file, else
    shebang where the file (``repo, file_path, content``) starts with one, else null. ``scanned``, ``dead``
    and ``excluded`` are whole counts; ``truncated``: a limit was met.
    """
    lang = lambda c: text.language_of(F.col(c))
    reliable = refs.select("repo", lang("caller_file").alias("lang")).where(F.col("lang").isin(REFERRING)).distinct()
    order = Window.partitionBy("repo").orderBy("file_path", "start_line", "id")
    head = symbols.where("parent_symbol_id IS NULL").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= scan).withColumn("lang", lang("file_path"))
    used = refs.select("repo", F.col("symbol_name").alias("name")).distinct()
    found = head.join(reliable, ["repo", "lang"], "left_semi").join(used, ["repo", "name"], "left_anti")
    found = entry_kind(found, manifests, files).withColumnRenamed("entry_kind", "entry")
    totals = found.groupBy("repo").agg(F.count("*").alias("scanned"), F.count_if(F.col("entry").isNull()).alias("dead"), F.count_if(F.col("entry").isNotNull()).alias("excluded"))
    sizes = head.groupBy("repo").agg(F.count("*").alias("_looked"))
    place = Window.partitionBy("repo").orderBy(F.col("entry").isNotNull(), "file_path", "start_line", "id")
    listed = found.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most)
    met = listed.join(totals, "repo").join(sizes, "repo")
    return met.withColumn("truncated", (F.col("_looked") >= scan) | (F.col("scanned") > most)).drop("_n", "_looked")


def hotspots(symbols: DataFrame, refs: DataFrame, most: int = 20) -> DataFrame:
    """Each repository's most referenced names with its first symbol of that name (by file and line); names without one go."""
    first = symbols.groupBy("repo", "name").agg(F.min_by(F.struct("file_path", "start_line", "kind", "id"), F.struct("file_path", "start_line", "id")).alias("_s"))
    counted = refs.groupBy("repo", F.col("symbol_name").alias("name")).agg(F.count("*").alias("total"))
    met = counted.join(first, ["repo", "name"]).select("repo", "name", "total", F.col("_s.file_path"), F.col("_s.start_line"), F.col("_s.kind"))
    place = Window.partitionBy("repo").orderBy(F.col("total").desc(), "name")
    return met.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most).drop("_n")


def directory_rollup(symbols: DataFrame, depth: int) -> DataFrame:
    """``directory, kind, n`` for each directory down to ``depth``, what lies below counted in; the root is empty."""
    per_file = symbols.groupBy("file_path", "kind").agg(F.count("*").alias("n"))
    parts = F.split("file_path", "/")
    levels = F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(depth)))
    prefixes = F.transform(levels, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return per_file.select(F.explode(prefixes).alias("directory"), "kind", "n").groupBy("directory", "kind").agg(F.sum("n").alias("n"))


def resolved_references(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with ``target``: by id, else by target file and name, else by caller's file and name."""
    by_id = symbols.select(F.col("id").alias("target_symbol_id"), F.col("id").alias("_t1"))
    named = symbols.groupBy("repo", "file_path", "name").agg(F.min("id").alias("_id"))
    by_file = named.select("repo", F.col("file_path").alias("target_file"), F.col("name").alias("symbol_name"), F.col("_id").alias("_t2"))
    by_caller = named.select("repo", F.col("file_path").alias("caller_file"), F.col("name").alias("symbol_name"), F.col("_id").alias("_t3"))
    met = refs.join(by_id, "target_symbol_id", "left").join(by_file, ["repo", "target_file", "symbol_name"], "left").join(by_caller, ["repo", "caller_file", "symbol_name"], "left")
    return met.withColumn("target", F.coalesce("_t1", "_t2", "_t3")).drop("_t1", "_t2", "_t3")


def defined_together(symbols: DataFrame) -> DataFrame:
    """Edges from each symbol of a file to the next in order of line."""
    order = Window.partitionBy("repo", "file_path").orderBy("start_line", "id")
    return symbols.select(F.lag("id").over(order).alias("source"), F.col("id").alias("target"), F.lit("co_defined").alias("kind")).where("source IS NOT NULL")


def code_graph(symbols: DataFrame, refs: DataFrame, nodes: int = 120, edges: int = 400) -> DataFrame:
    """Edges among the symbols of highest degree: ``source, target, kind``, once each.

    Degrees count repeated edges; loops and unresolved references are left out.
    """
    resolved = resolved_references(refs, symbols).where("target IS NOT NULL").withColumn("_row", F.col("id"))
    points = resolved.select("repo", F.col("caller_file").alias("file_path"), "caller_line", "_row", "target", "kind")
    placed = enclosing(points, symbols, ["repo", "file_path"], "caller_line", "_row")
    calls = placed.where("symbol_id IS NOT NULL AND symbol_id != target").select(F.col("symbol_id").alias("source"), "target", "kind")
    every = staged(calls.unionByName(defined_together(symbols)), "edges")
    degree = every.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    top = degree.orderBy(F.col("degree").desc(), "node").limit(nodes)
    top = staged(top, "nodes")  # ``nodes`` rows
    kept = every.join(F.broadcast(top.select(F.col("node").alias("source"))), "source", "left_semi").join(F.broadcast(top.select(F.col("node").alias("target"))), "target", "left_semi")
    return kept.select("source", "target", "kind").distinct().orderBy("source", "target", "kind").limit(edges)


def callers(refs: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Who refers to a symbol: ``caller, file_path, caller_kind, n, first_line``; a reference a place."""
    places = refs.where(F.col("symbol_name") == name).select("repo", "caller_file", "caller_line", F.coalesce("caller_name", "caller_file").alias("caller")).distinct()
    grouped = places.groupBy("repo", "caller_file", "caller").agg(F.count("*").alias("n"), F.min("caller_line").alias("first_line"))
    kinds = symbols.groupBy("repo", F.col("name").alias("caller")).agg(F.min_by("kind", "id").alias("caller_kind"))
    return grouped.join(kinds, ["repo", "caller"], "left").select("caller", F.col("caller_file").alias("file_path"), "caller_kind", "n", "first_line")


def inferred_references(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols whose comment or signature mentions a name."""
    low = name.lower()
    mentions = F.coalesce(F.lower("doc_comment").contains(low), F.lit(False)) | F.coalesce(F.lower("signature").contains(low), F.lit(False))
    return symbols.where(mentions & (F.col("name") != name)).select("repo", F.col("file_path").alias("caller_file"), F.col("start_line").alias("caller_line"), F.lit("inferred").alias("kind"))


def traced(refs: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Stored, then inferred references, the first of each file and line."""
    stored = refs.where(F.col("symbol_name") == name).select("repo", "caller_file", "caller_line", "kind", F.lit(0).alias("_p"))
    both = stored.unionByName(inferred_references(symbols, name).withColumn("_p", F.lit(1)))
    order = Window.partitionBy("repo", "caller_file", "caller_line").orderBy("_p", "kind")
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_p")


def index_plan(found: DataFrame, known: DataFrame) -> DataFrame:
    """``file_path, action``: new, skip, parse or stale.

    ``found``: file_path, checksum, mtime; ``known``: file_path, checksum, last_indexed_at. A file
    is skipped if it has not changed since two seconds before it was indexed, or its checksum is the same.
    """
    k = known.select("file_path", F.col("checksum").alias("_sum"), "last_indexed_at")
    met = found.join(k, "file_path", "full_outer")
    unchanged = (F.col("mtime") + F.expr("INTERVAL 2 SECONDS") <= F.col("last_indexed_at")) | (F.col("checksum") == F.col("_sum"))
    action = F.when(F.col("mtime").isNull(), "stale").when(F.col("last_indexed_at").isNull(), "new").when(unchanged, "skip").otherwise("parse")
    return met.select("file_path", action.alias("action"))


def renames(new: DataFrame, stale: DataFrame) -> DataFrame:
    """``old_path, new_path`` of equal checksums, one old path for each new one, in order of path."""
    place = Window.partitionBy("checksum").orderBy("file_path")
    number = lambda df, name: df.select("checksum", F.col("file_path").alias(name), F.row_number().over(place).alias("_n"))
    return number(stale, "old_path").join(number(new, "new_path"), ["checksum", "_n"]).select("old_path", "new_path")


def staleness(files: DataFrame, stale: Column, least: float = 0.05) -> DataFrame:
    """Share of stale files to three places, and whether that makes the index stale."""
    ratio = F.round(F.avg(stale.cast("int")), 3)
    return files.agg(F.count("*").alias("total"), F.count_if(stale).alias("stale"), ratio.alias("ratio")).withColumn("is_stale", F.col("ratio") >= least)

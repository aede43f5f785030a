"""Queries over indexed code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import code_index as C
from ..operators import text_index
from ..sources import code_files, tables
from .bindings import Tables
from .registry import query
from .retrieval_queries import VECTOR, VECTOR_SQL

_TIER_SQL = """CASE WHEN lower(name) = 'getpart12' THEN 1 WHEN regexp_matches(lower(name), 'get.*part12') THEN 2 WHEN starts_with(lower(name), 'getpart12') THEN 3 WHEN contains(lower(name), 'getpart12') THEN 4 ELSE 5 END"""
_RANKED_SQL = f"""found AS (SELECT * FROM symbols WHERE name ILIKE '%getPart12%' OR doc_comment ILIKE '%getPart12%' OR file_path ILIKE '%getPart12%' OR signature ILIKE '%getPart12%' ORDER BY name, id LIMIT 200),
raw AS (SELECT *, {_TIER_SQL} AS tier, 0.6 + CASE WHEN name = 'getPart12' THEN 0.15 ELSE 0 END + CASE WHEN exported THEN 0.2 ELSE 0 END + 0.1 / len(string_split(file_path, '/')) AS r FROM found),
ranked AS (SELECT *, CASE WHEN max(r) OVER w = min(r) OVER w THEN 0.0 ELSE round((r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w), 4) END AS score FROM raw WINDOW w AS (PARTITION BY tier))"""


@query("R9 W8 F31 P10 symbol search, Q3 Q18", f"WITH {_RANKED_SQL} SELECT id, name, tier, CAST(score AS DOUBLE) AS score FROM ranked")
def symbol_search_ranked(t: Tables):
    return C.ranked_symbols(C.searched_symbols(t.symbols, "getPart12"), "getPart12").select("id", "name", "tier", "score")


@query("R9 symbol search by words", f"WITH {_RANKED_SQL} SELECT id, name FROM ranked")
def symbol_search_words(t: Tables):
    return C.searched_by_words(t.symbols, "zzzz q getPart12 setPart").select("id", "name")


@query(
    "R10 vector blend in tiers",
    f"""WITH {_RANKED_SQL} SELECT s.id, tier, round(CASE WHEN v.id IS NULL THEN score ELSE 0.3 * list_cosine_similarity(CAST(vector AS DOUBLE[]), {VECTOR_SQL}) + 0.7 * score END, 6) AS score FROM ranked s LEFT JOIN vectors v ON s.id = v.id""",
)
def symbol_search_vectors(t: Tables):
    ranked = C.ranked_symbols(C.searched_symbols(t.symbols, "getPart12"), "getPart12")
    similarity = t.vectors.select("id", scoring.dense_cosine(F.col("vector"), F.array(*map(F.lit, VECTOR))).alias("similarity"))
    return C.blended_with_vectors(ranked, similarity).select("id", "tier", F.round("score", 6).alias("score"))


@query("P11 prefix", "SELECT id, name FROM symbols WHERE starts_with(lower(name), 'setpart1') AND kind = 'class'")
def symbol_prefix(t: Tables):
    return C.with_prefix(t.symbols, "setPart1", "class").select("id", "name")


@query("P10 G13 filters", "SELECT id FROM symbols WHERE kind IN ('class', 'method') AND repo IN ('site1', 'site2') AND exported")
def symbol_filters(t: Tables):
    return C.filtered_symbols(t.symbols, ["class", "method"], ["site1", "site2"], exported=True).select("id")


@query("A15 symbols a file and kind", "SELECT file_path, kind, count(*) AS n FROM symbols GROUP BY file_path, kind")
def symbol_counts(t: Tables):
    return t.symbols.groupBy("file_path", "kind").agg(F.count("*").alias("n"))


@query("A14 top references", "SELECT symbol_name, count(*) AS total FROM refs GROUP BY symbol_name ORDER BY total DESC, symbol_name LIMIT 25")
def top_references(t: Tables):
    return C.top_references(t.refs, 25)


@query(
    "A13 reference counts a kind",
    "SELECT symbol_name, count(*) AS total, count(*) FILTER (WHERE kind = 'call') AS calls, count(*) FILTER (WHERE kind = 'import') AS imports, count(*) FILTER (WHERE kind = 'type') AS types FROM refs GROUP BY symbol_name",
)
def reference_counts(t: Tables):
    n = lambda kind: F.coalesce(F.try_element_at("kinds", F.lit(kind)), F.lit(0))
    return C.reference_counts(t.refs).select("symbol_name", "total", n("call").alias("calls"), n("import").alias("imports"), n("type").alias("types"))


@query(
    "J25 G8 callers",
    """WITH p AS (SELECT DISTINCT repo, caller_file, caller_line, coalesce(caller_name, caller_file) AS caller FROM refs WHERE symbol_name = 'getPart36'), g AS (SELECT repo, caller_file, caller, count(*) AS n, min(caller_line) AS first_line FROM p GROUP BY ALL),
k AS (SELECT repo, name, arg_min(kind, id) AS kind FROM symbols GROUP BY repo, name) SELECT g.caller, caller_file AS file_path, k.kind AS caller_kind, n, first_line FROM g LEFT JOIN k ON g.repo = k.repo AND g.caller = k.name""",
)
def callers(t: Tables):
    return C.callers(t.refs, t.symbols, "getPart36")


@query(
    "G9 U6 trace",
    """WITH a AS (SELECT repo, caller_file, caller_line, kind, 0 AS p FROM refs WHERE symbol_name = 'part6' UNION ALL SELECT repo, file_path, start_line, 'inferred', 1 FROM symbols WHERE (contains(lower(coalesce(doc_comment, '')), 'part6') OR contains(lower(signature), 'part6')) AND name <> 'part6')
SELECT repo, caller_file, caller_line, kind FROM a QUALIFY row_number() OVER (PARTITION BY repo, caller_file, caller_line ORDER BY p, kind) = 1""",
)
def trace_symbol(t: Tables):
    return C.traced(t.refs, t.symbols, "part6")


@query("G9 children and parent of a symbol", "SELECT c.id, c.name, p.name AS parent FROM symbols c LEFT JOIN symbols p ON c.parent_symbol_id = p.id WHERE c.parent_symbol_id IS NOT NULL")
def symbol_parents(t: Tables):
    p = t.symbols.select(F.col("id").alias("parent_symbol_id"), F.col("name").alias("parent"))
    return t.symbols.where("parent_symbol_id IS NOT NULL").join(p, "parent_symbol_id", "left").select("id", "name", "parent")


_DEAD_SQL = "SELECT s.* FROM symbols s WHERE parent_symbol_id IS NULL AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.repo = s.repo AND r.symbol_name = s.name)"


@query("G10 J15 dead code", f"SELECT id, name, exported AS entry FROM ({_DEAD_SQL})")
def dead_code(t: Tables):
    return C.dead_code(t.symbols, t.refs).select("id", "name", "entry")


@query("A30 dead-code totals", f"SELECT (SELECT count(*) FROM symbols WHERE parent_symbol_id IS NULL) AS scanned, count(*) FILTER (WHERE NOT exported) AS dead, count(*) FILTER (WHERE exported) AS excluded FROM ({_DEAD_SQL})")
def dead_code_totals(t: Tables):
    scanned = t.symbols.where("parent_symbol_id IS NULL").agg(F.count("*").alias("scanned"))
    found = C.dead_code(t.symbols, t.refs).agg(F.count_if(~F.col("entry")).alias("dead"), F.count_if("entry").alias("excluded"))
    return scanned.join(F.broadcast(found))


@query(
    "J14 W4 hotspots of each repository",
    """WITH f AS (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY repo, name ORDER BY file_path, start_line, id) = 1), r AS (SELECT repo, symbol_name, count(*) AS total FROM refs GROUP BY repo, symbol_name)
SELECT r.repo, name, total, file_path, start_line, kind FROM r JOIN f ON f.repo = r.repo AND name = symbol_name QUALIFY row_number() OVER (PARTITION BY r.repo ORDER BY total DESC, name) <= 20""",
)
def hotspots(t: Tables):
    return C.hotspots(t.symbols, t.refs)


@query(
    "A17 G11 directory rollup",
    """SELECT directory, kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT '' AS directory, kind FROM symbols UNION ALL SELECT string_split(file_path, '/')[1], kind FROM symbols UNION ALL SELECT string_split(file_path, '/')[1] || '/' || string_split(file_path, '/')[2], kind FROM symbols) GROUP BY directory, kind""",
)
def architecture_rollup(t: Tables):
    return C.directory_rollup(t.symbols, 2)


@query("A16 J13 languages", "SELECT coalesce(language, 'unknown') AS language, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM files GROUP BY 1")
def language_breakdown(t: Tables):
    return t.files.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("size_bytes"))


@query("G11 exports", "SELECT file_path, start_line, name FROM symbols WHERE exported AND parent_symbol_id IS NULL ORDER BY file_path, start_line, id LIMIT 50")
def architecture_exports(t: Tables):
    return t.symbols.where("exported AND parent_symbol_id IS NULL").orderBy("file_path", "start_line", "id").limit(50).select("file_path", "start_line", "name")


@query("F34 S7 language by path", "SELECT id, CASE page_ % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'markdown' ELSE 'html' END AS language FROM (SELECT id, id AS page_ FROM files)")
def language_by_path(t: Tables):
    return t.files.select("id", text.language_of(F.col("file_path")).alias("language"))


_RESOLVED_SQL = """named AS (SELECT repo, file_path, name, min(id) AS id FROM symbols GROUP BY ALL),
res AS (SELECT r.*, coalesce(a.id, b.id, c.id) AS target FROM refs r LEFT JOIN symbols a ON a.id = r.target_symbol_id LEFT JOIN named b ON b.repo = r.repo AND b.file_path = r.target_file AND b.name = r.symbol_name LEFT JOIN named c ON c.repo = r.repo AND c.file_path = r.caller_file AND c.name = r.symbol_name)"""
_ENCLOSED_SQL = """enc AS (SELECT p.id, p.target, p.kind, s.id AS source FROM res p LEFT JOIN symbols s ON s.repo = p.repo AND s.file_path = p.caller_file AND p.caller_line BETWEEN s.start_line AND s.end_line
  QUALIFY row_number() OVER (PARTITION BY p.id, p.caller_line, p.target, p.kind, p.caller_file ORDER BY s.end_line - s.start_line NULLS LAST, s.start_line, s.id) = 1)"""


@query("J10 references to their symbols", f"WITH {_RESOLVED_SQL} SELECT kind, count(*) AS n, count(target) AS resolved, CAST(sum(target) AS BIGINT) AS checksum FROM res GROUP BY kind")
def resolved_references(t: Tables):
    return C.resolved_references(t.refs, t.symbols).groupBy("kind").agg(F.count("*").alias("n"), F.count("target").alias("resolved"), F.sum("target").alias("checksum"))


@query(
    "J11 enclosing symbol",
    """WITH p AS (SELECT row_number() OVER (ORDER BY repo, caller_file, caller_line) AS k, * FROM (SELECT DISTINCT repo, caller_file, caller_line FROM refs)) SELECT p.repo, p.caller_file, p.caller_line, s.id AS symbol_id FROM p LEFT JOIN symbols s ON s.repo = p.repo AND s.file_path = p.caller_file AND p.caller_line BETWEEN s.start_line AND s.end_line
QUALIFY row_number() OVER (PARTITION BY k ORDER BY s.end_line - s.start_line NULLS LAST, s.start_line, s.id) = 1""",
)
def enclosing_symbol(t: Tables):
    points = t.refs.select("repo", F.col("caller_file").alias("file_path"), "caller_line").distinct()
    points = points.withColumn("k", F.concat_ws("|", "repo", "file_path", "caller_line"))
    return C.enclosing(points, t.symbols, ["repo", "file_path"], "caller_line", "k").select("repo", F.col("file_path").alias("caller_file"), "caller_line", "symbol_id")


@query(
    "G7 W6 code graph, Q25",
    f"""WITH {_RESOLVED_SQL}, {_ENCLOSED_SQL.replace("PARTITION BY p.id, p.caller_line, p.target, p.kind, p.caller_file", "PARTITION BY p.id, p.target, p.kind, p.caller_file, p.caller_line, p.symbol_name, p.rowid_")},
e AS (SELECT source, target, kind FROM enc WHERE source IS NOT NULL AND source <> target UNION ALL SELECT * FROM (SELECT lag(id) OVER (PARTITION BY repo, file_path ORDER BY start_line, id), id, 'co_defined' FROM symbols) AS c(source, target, kind) WHERE source IS NOT NULL),
d AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY node ORDER BY degree DESC, node LIMIT 120)
SELECT DISTINCT source, target, kind FROM e WHERE source IN (SELECT node FROM d) AND target IN (SELECT node FROM d) ORDER BY source, target, kind LIMIT 400""".replace("SELECT r.*, coalesce", "SELECT r.*, row_number() OVER () AS rowid_, coalesce"),
)
def code_graph(t: Tables):
    refs = t.refs.withColumn("id", F.monotonically_increasing_id())  # ids of the bound references repeat
    return C.code_graph(t.symbols, refs)


@query(
    "G12 F28 grep, Q20",
    r"""WITH l AS (SELECT file_path, unnest(string_split_regex(content, '\r?\n')) AS line, generate_subscripts(string_split_regex(content, '\r?\n'), 1) AS line_no FROM files), h AS (SELECT *, instr(lower(line), 'class=') - 1 AS place FROM l WHERE contains(lower(line), 'class='))
SELECT file_path, CAST(line_no AS INTEGER) AS line_no, CAST(place AS INTEGER) AS "at", CASE WHEN greatest(0, place - 40) > 0 THEN '…' ELSE '' END || substr(line, greatest(0, place - 40) + 1, least(length(line), place + 46) - greatest(0, place - 40)) || CASE WHEN least(length(line), place + 46) < length(line) THEN '…' ELSE '' END AS snippet FROM h""",
)
def grep_lines(t: Tables):
    index = t.trigrams("files", t.files, "files", ["content"], ["file_path"])
    return C.grep(text_index.may_hold(index, "CLASS="), "CLASS=")


@query(
    "G12 J11 grep with enclosing symbols, a page",
    r"""WITH s AS (SELECT id, repo, file_path, name, start_line, end_line FROM symbols UNION ALL SELECT 1000000 + id, repo, file_path, 'whole', 1, 9999 FROM files WHERE id % 2 = 0),
l AS (SELECT repo, file_path, unnest(string_split_regex(content, '
?
')) AS line, generate_subscripts(string_split_regex(content, '
?
'), 1) AS line_no FROM files), h AS (SELECT repo, file_path, line_no FROM l WHERE contains(lower(line), 'class=')),
p AS (SELECT *, row_number() OVER (ORDER BY repo, file_path, line_no) AS rank FROM (SELECT * FROM h ORDER BY repo, file_path, line_no LIMIT 40 OFFSET 5))
SELECT p.repo, p.file_path, CAST(p.line_no AS INTEGER) AS line_no, CAST(p.rank AS INTEGER) AS rank, s.name AS symbol, (SELECT count(*) FROM h) > 45 AS more FROM p LEFT JOIN s ON s.repo = p.repo AND s.file_path = p.file_path AND p.line_no BETWEEN s.start_line AND s.end_line
QUALIFY row_number() OVER (PARTITION BY p.rank ORDER BY s.end_line - s.start_line NULLS LAST, s.start_line, s.id) = 1""",
)
def grep_symbols(t: Tables):
    whole = t.files.where("id % 2 = 0").select((F.col("id") + 1000000).alias("id"), "repo", "file_path", F.lit("whole").alias("name"), F.lit(1).alias("start_line"), F.lit(9999).alias("end_line"))
    symbols = t.symbols.select("id", "repo", "file_path", "name", "start_line", "end_line").unionByName(whole)
    return C.grep_with_symbols(t.files, symbols, "class=", 40, 5).select("repo", "file_path", "line_no", "rank", "symbol", "more")


@query(
    "G12 F40 grep by pattern",
    r"""WITH l AS (SELECT file_path, unnest(string_split_regex(content, '\r?\n')) AS line, generate_subscripts(string_split_regex(content, '\r?\n'), 1) AS line_no FROM files) SELECT file_path, CAST(line_no AS INTEGER) AS line_no, CAST(instr(line, regexp_extract(line, '(?i)h[1-3]>')) - 1 AS INTEGER) AS at FROM l WHERE regexp_matches(line, '(?i)h[1-3]>')""",
)
def grep_pattern(t: Tables):
    return C.grep(t.files, "h[1-3]>", regex=True).select("file_path", "line_no", "at")


@query(
    "J12 parents",
    """SELECT s.id, c.id AS parent_id FROM symbols s LEFT JOIN symbols c ON c.kind IN ('class', 'interface') AND c.repo = s.repo AND c.file_path = s.file_path AND c.start_line <= s.start_line AND c.end_line >= s.end_line AND c.id <> s.id QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY c.start_line DESC NULLS LAST, c.end_line, c.id DESC) = 1""",
)
def parent_resolution(t: Tables):
    return C.parents(t.symbols, ["class", "interface"])


@query(
    "S9 symbols of generic text",
    r"""WITH l AS (SELECT p_brand, CASE WHEN p_size % 2 = 0 THEN 'function' ELSE 'class' END AS kind, regexp_replace(p_name, '[^a-zA-Z_0-9]', '_', 'g') AS name, CASE WHEN p_size % 2 = 0 THEN 'def ' ELSE 'class ' END || regexp_replace(p_name, '[^a-zA-Z_0-9]', '_', 'g') || '():' AS line FROM part),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY line) AS INTEGER) AS k FROM l)
SELECT p_brand || '.py' AS file_path, name, kind, k AS start_line, k AS end_line, line AS signature, CAST(NULL AS VARCHAR) AS doc_comment FROM n""",
)
def generic_symbols(t: Tables):
    """The parts as declarations, a text a brand."""
    line = F.concat(F.when(F.col("p_size") % 2 == 0, "def ").otherwise("class "), F.regexp_replace("p_name", "[^a-zA-Z_0-9]", "_"), F.lit("():"))
    lists = t.table("part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content"))
    return code_files.extracted(lists.select(F.concat("p_brand", F.lit(".py")).alias("file_path"), F.lit("python").alias("language"), "content"))


@query(
    "S10 symbols of Markdown",
    r"""WITH l AS (SELECT file_path, repo, string_split('# ' || file_path || chr(10) || 'about' || chr(10) || chr(10) || '## ' || repo || chr(10) || '```html' || chr(10) || content || chr(10) || '```' || chr(10), chr(10)) AS lines FROM files),
p AS (SELECT *, list_min(list_filter(range(5, len(lines) + 1), lambda i: trim(lines[i]) = '')) AS blank FROM l),
f AS (SELECT *, list_min(list_filter(range(blank, len(lines) + 1), lambda i: starts_with(lines[i], '```'))) AS fence FROM p)
SELECT file_path, file_path AS name, 'heading1' AS kind, CAST(1 AS INTEGER) AS start_line, CAST(2 AS INTEGER) AS end_line, '# ' || file_path AS signature, CAST(NULL AS VARCHAR) AS doc_comment FROM f
UNION ALL SELECT file_path, repo, 'heading2', 4, CAST(blank - 1 AS INTEGER), '## ' || repo, NULL FROM f
UNION ALL SELECT file_path, 'code-block:unknown', 'code_block', CAST(fence AS INTEGER), CAST(len(lines) AS INTEGER), '```unknown', NULL FROM f WHERE fence IS NOT NULL""",
)
def markdown_symbols(t: Tables):
    body = F.concat(F.lit("# "), "file_path", F.lit("\nabout\n\n## "), F.col("repo"), F.lit("\n```html\n"), "content", F.lit("\n```\n"))
    return code_files.extracted(t.files.withColumn("content", body).withColumn("language", F.lit("markdown")))


@query(
    "G14 U5 index plan",
    """WITH f AS (SELECT file_path, CASE WHEN id % 5 = 0 THEN checksum || 'x' ELSE checksum END AS checksum, last_indexed_at + CASE WHEN id % 2 = 0 THEN to_hours(1) ELSE to_hours(-1) END AS mtime, id FROM files WHERE checksum <> 'c7'), k AS (SELECT * FROM files WHERE checksum <> 'c11')
SELECT coalesce(f.file_path, k.file_path) AS file_path, CASE WHEN f.file_path IS NULL THEN 'stale' WHEN k.file_path IS NULL THEN 'new' WHEN f.mtime + INTERVAL 2 SECONDS <= k.last_indexed_at OR f.checksum = k.checksum THEN 'skip' ELSE 'parse' END AS action FROM f FULL JOIN k ON f.file_path = k.file_path""",
)
def index_plan(t: Tables):
    mtime = F.when(F.col("id") % 2 == 0, F.col("last_indexed_at") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("last_indexed_at") - F.expr("INTERVAL 1 HOUR"))
    found = t.files.where("checksum <> 'c7'").select("file_path", F.when(F.col("id") % 5 == 0, F.concat("checksum", F.lit("x"))).otherwise(F.col("checksum")).alias("checksum"), mtime.alias("mtime"))
    return C.index_plan(found, t.files.where("checksum <> 'c11'"))


@query(
    "J24 renames",
    """WITH n AS (SELECT checksum, file_path, row_number() OVER (PARTITION BY checksum ORDER BY file_path) AS k FROM files WHERE repo = 'site0'), o AS (SELECT checksum, file_path, row_number() OVER (PARTITION BY checksum ORDER BY file_path) AS k FROM files WHERE repo = 'site1') SELECT o.file_path AS old_path, n.file_path AS new_path FROM n JOIN o USING (checksum, k)""",
)
def rename_detect(t: Tables):
    return C.renames(t.files.where("repo = 'site0'"), t.files.where("repo = 'site1'"))


@query("S18 path moves", "SELECT id, CASE WHEN language = 'typescript' THEN 'moved/' || file_path ELSE file_path END AS file_path FROM files")
def path_transfer(t: Tables):
    moves = t.files.where("language = 'typescript'").select(F.col("file_path").alias("old_path"), F.concat(F.lit("moved/"), "file_path").alias("new_path"))
    return tables.renamed(t.files, moves, ["file_path"]).select("id", "file_path")


@query("A23 staleness", "SELECT count(*) AS total, count(*) FILTER (WHERE last_indexed_at < TIMESTAMP '2024-01-03 00:00:00') AS stale, round(avg(CAST(last_indexed_at < TIMESTAMP '2024-01-03 00:00:00' AS INT)), 3) AS ratio, round(avg(CAST(last_indexed_at < TIMESTAMP '2024-01-03 00:00:00' AS INT)), 3) >= 0.05 AS is_stale FROM files")
def staleness(t: Tables):
    return C.staleness(t.files, F.col("last_indexed_at") < F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))


@query("A22 index totals", "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM refs) AS refs")
def index_stats(t: Tables):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(t.files, "files").join(F.broadcast(one(t.symbols, "symbols"))).join(F.broadcast(one(t.refs, "refs")))


@query("F36 name variants", "SELECT id, 'a-' || kind || '.b' AS name, 'a.' || kind || '.b' AS dotted, 'a-' || kind || '-b' AS dashed FROM symbols")
def name_variants(t: Tables):
    name = F.concat(F.lit("a-"), "kind", F.lit(".b"))
    v = text.name_variants(name)
    pick = lambda x: F.element_at(F.filter(v, lambda y: y == x), 1)
    return t.symbols.select("id", name.alias("name"), pick(F.concat(F.lit("a."), "kind", F.lit(".b"))).alias("dotted"), pick(F.concat(F.lit("a-"), "kind", F.lit("-b"))).alias("dashed"))


@query("X23 file slices", "SELECT id, length(array_to_string(string_split(content, chr(10))[1:3], chr(10))) AS n, len(string_split(content, chr(10))) > 3 AS truncated FROM files")
def file_slices(t: Tables):
    from ..functions.documentation import content_slice

    cut = t.files.select("id", content_slice(F.col("content"), 3).alias("s"))
    return cut.select("id", F.length("s.text").cast("long").alias("n"), "s.truncated")


@query("F30 doc comments", "SELECT id, doc_comment AS summary, CAST(2 AS INTEGER) AS n_tags, true AS deprecated FROM symbols")
def doc_comments(t: Tables):
    from ..functions.documentation import doc_struct

    raw = F.concat(F.lit("/**\n * "), F.coalesce("doc_comment", F.lit("")), F.lit("\n * @param x the "), "name", F.lit("\n * @deprecated\n */"))
    return t.symbols.select("id", doc_struct(raw).alias("d")).select("id", "d.summary", F.size("d.tags").alias("n_tags"), "d.deprecated")

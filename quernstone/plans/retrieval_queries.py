"""Queries of ranked retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import querytext, scoring, text
from ..operators import retrieval as R
from ..operators import similarity, text_index, vector_index
from ..operators.analytics import board_order
from ..sources import tables as S
from ..sources.stored import shared_root
from .bindings import AS_OF, Tables
from .registry import query

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
NORMAL_SQL = r"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\s_\-.]', ' ', 'g'), '\s+', ' ', 'g'))"
TOKENS_SQL = f"list_filter(string_split({NORMAL_SQL}, ' '), lambda t: t <> '' AND NOT list_contains({STOP_SQL}, t))"
FTS_SQL = f"list_filter(string_split_regex(translate(lower({{c}}), '{text.FOLD_FROM}', '{text.FOLD_TO}'), '[^a-z0-9]+'), lambda t: t <> '')"
REPO = "src1"
QUERY = "the and ing"


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def stamp_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def cosine_sql(table: str, column: str, terms: dict[str, int]) -> str:
    """CTEs tok(id, term, tf), norms(id, norm), dots(id, dot) of a column against fixed term counts."""
    values = ", ".join(f"('{t}', {n})" for t, n in terms.items())
    return f"""tok AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({TOKENS_SQL.replace("{c}", column)}) AS term FROM {table}) GROUP BY id, term),
norms AS (SELECT id, sqrt(CAST(sum(tf * tf) AS DOUBLE)) AS norm FROM tok GROUP BY id),
q(term, n) AS (VALUES {values}),
dots AS (SELECT id, CAST(sum(tf * n) AS DOUBLE) AS dot FROM tok JOIN q USING (term) GROUP BY id)"""


def bm25_sql(table: str, columns: str, prefixes: list[str], scope: str = "TRUE") -> str:
    """CTEs ending in bm(id, bm25): every prefix must hit; statistics before the scope."""
    hits = ", ".join(f"len(list_filter(tokens, lambda t: starts_with(t, '{p}'))) AS f{i}" for i, p in enumerate(prefixes))
    stats = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(prefixes)))
    idf = lambda i: f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END"
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (1 - 0.75 + 0.75 * dl / average))" for i in range(len(prefixes)))
    every = " AND ".join(f"f{i} > 0" for i in range(len(prefixes)))
    return f"""toks AS (SELECT *, {FTS_SQL.replace("{c}", columns)} AS tokens FROM {table}),
hits AS (SELECT *, len(tokens) AS dl, {hits} FROM toks),
stats AS (SELECT count(*) AS n, avg(dl) AS average, {stats} FROM hits),
bm AS (SELECT id, -({score}) AS bm25 FROM hits, stats WHERE {every} AND {scope})"""


BODY_SQL = "title || ' ' || content || ' ' || array_to_string(tags, ' ')"


@query(
    "R4 BM25 search, F6 full-text query, A27 min-max, T2 order, J2",
    f"""WITH {bm25_sql("memories", BODY_SQL, ["th", "ing"], "(repo = 'src1' OR is_global) AND status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-03-01 00:00:00')")},
scaled AS (SELECT m.*, bm25, CASE WHEN max(bm25) OVER () = min(bm25) OVER () THEN 1.0 ELSE (max(bm25) OVER () - bm25) / (max(bm25) OVER () - min(bm25) OVER ()) END AS keyword FROM bm JOIN memories m USING (id))
SELECT id, round(bm25, 6) AS bm25, round(keyword, 6) AS keyword, CAST(row_number() OVER (ORDER BY round(bm25, 9), importance DESC, created_at DESC, id) AS INTEGER) AS rank FROM scaled ORDER BY rank LIMIT 100""",
)
def memory_search_bm25(t: Tables):
    from pyspark.sql.window import Window

    scope = ((F.col("repo") == REPO) | F.col("is_global")) & R.live(t.as_of)
    found = R.bm25(t.memories, "th ing", [], scope, t.index("memories", "title", "content", "tags[]"))
    scaled = R.with_min_max(found.select("id", "bm25", "importance", "created_at"), "bm25", "keyword")
    order = [F.round("bm25", 9), F.col("importance").desc(), F.col("created_at").desc(), F.col("id")]
    top = scaled.orderBy(*order).limit(100)
    return top.select("id", F.round("bm25", 6).alias("bm25"), F.round("keyword", 6).alias("keyword"), F.row_number().over(Window.partitionBy().orderBy(*order)).alias("rank"))


@query(
    "F6 phrases",
    f"""WITH toks AS (SELECT id, {FTS_SQL.replace("{c}", "content")} AS tokens FROM memories),
places AS (SELECT id, tokens, unnest(range(1, len(tokens))) AS i FROM toks WHERE len(tokens) > 1)
SELECT id, CAST(count(*) AS INTEGER) AS hits FROM places WHERE tokens[i] = 'of' AND tokens[i + 1] = 'the' GROUP BY id""",
)
def memory_phrase_hits(t: Tables):
    hits = R.phrase_hits(F.col("body"), ("of", "the"))
    return t.memories.select("id", text.folded(F.col("content")).alias("body")).select("id", hits.alias("hits")).where("hits > 0")


CANDIDATES_SQL = f"""pool AS (SELECT * FROM memories WHERE (repo = '{REPO}' OR is_global OR list_contains(list_transform(tags, lambda x: lower(x)), 'tag3'))
  AND status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-03-01 00:00:00')
  ORDER BY repo = '{REPO}' DESC, importance DESC, created_at DESC, id LIMIT 60)"""
SIMILAR_SQL = f"""sim AS (SELECT p.*, CASE WHEN coalesce(dot, 0) = 0 THEN 0.16 ELSE dot / (norm * {{norm}}) END + CASE WHEN repo = '{REPO}' THEN 0.1 ELSE 0.0 END AS similarity FROM pool p LEFT JOIN norms USING (id) LEFT JOIN dots USING (id))"""


@query(
    "R6 term-vector candidates, F1 F2 F9 F10, P2 P3, scope with tags",
    f"""WITH {CANDIDATES_SQL}, {cosine_sql("pool", "content", {"heth": 1, "ing": 2, "onth": 1})}, {SIMILAR_SQL.replace("{norm}", "sqrt(6.0)")}
SELECT id, round(similarity, 6) AS similarity FROM sim ORDER BY round(similarity, 9) DESC, id LIMIT 20""",
)
def memory_search_tf_cosine(t: Tables):
    pool = R.candidates(t.memories, REPO, "heth ing onth ing", t.as_of, 60, ["tag3"])
    return pool.select("id", F.round("similarity", 9).alias("s"), F.round("similarity", 6).alias("similarity")).orderBy(F.col("s").desc(), "id").limit(20).drop("s")


@query(
    "R1 R2 R3 hybrid blend, threshold, page, F13 F15 F20 F22, P13, P15",
    f"""WITH {CANDIDATES_SQL}, {cosine_sql("pool", "content", {"heth": 1, "ing": 2, "onth": 1})}, {SIMILAR_SQL.replace("{norm}", "sqrt(6.0)")},
parts AS (SELECT *, CASE WHEN content LIKE '%ing%' THEN 1.0 ELSE 0.0 END AS keyword,
  CASE WHEN created_at >= TIMESTAMP '2024-03-01 00:00:00' THEN 1.0 ELSE pow(2.0, -(epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(created_at)) / 86400000000.0 / 30.0) END AS recency,
  greatest(0.0, least(1.0, len(list_filter(tags, lambda x: list_contains(['en', 'ing'], lower(x)))) / len(tags) + CASE WHEN recall_count > 0 THEN 0.0 ELSE 0.15 END - CASE WHEN type = 'task_archive' THEN 0.2 ELSE 0.0 END)) AS domain FROM sim),
scored AS (SELECT *, 0.4 * similarity + 0.3 * keyword + 0.15 * recency + 0.15 * domain AS score, count(*) OVER () AS eligible FROM parts),
kept AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM scored)
SELECT id, round(score, 6) AS score, eligible, CAST(rank AS INTEGER) AS rank, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence
FROM kept WHERE (score >= CASE WHEN eligible <= 5 THEN 0.1 ELSE 0.4 END OR rank = 1) AND rank > 2 AND rank <= 17""",
)
def memory_search_hybrid(t: Tables):
    pool = R.candidates(t.memories, REPO, "heth ing onth ing", t.as_of, 60, ["tag3"])
    domain = scoring.overlap(F.col("tags"), text.strings(["en", "ing"]))
    pool = pool.select("id", "similarity", F.when(F.col("content").contains("ing"), 1.0).otherwise(0.0).alias("keyword"), scoring.recency(F.col("created_at"), t.as_of).alias("recency"), scoring.domain_adjusted(domain, F.col("recall_count") > 0, F.col("type")).alias("domain"))
    found = R.hybrid(pool, "memory", offset=2, limit=15, bounded=True)
    return found.select("id", F.round("score", 6).alias("score"), "eligible", "rank", scoring.confidence(F.col("score")).alias("confidence"))


def _search_sql(words: list[str]) -> str:
    """SQL of a search for some words in French memories of last month, with tags and a branch."""
    wide = querytext.expanded(" ".join(words)).split()
    return f"""WITH pool AS (SELECT * FROM memories WHERE (repo = '{REPO}' OR is_global OR list_has_any(list_transform(tags, lambda x: lower(x)), ['tag3', 'tag1'])) AND status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-03-01 00:00:00')
  ORDER BY repo = '{REPO}' DESC, importance DESC, created_at DESC, id LIMIT 90), {cosine_sql("pool", "content", dict.fromkeys(wide, 1))}, {{similar}},
{bm25_sql("memories", BODY_SQL, words, f"(repo = '{REPO}' OR is_global) AND status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-03-01 00:00:00')")},
best AS (SELECT id, bm25 FROM bm JOIN memories USING (id) ORDER BY round(bm25, 9), importance DESC, created_at DESC, id LIMIT 100),
keyed AS (SELECT id, CASE WHEN max(bm25) OVER () = min(bm25) OVER () THEN 1.0 ELSE (max(bm25) OVER () - bm25) / (max(bm25) OVER () - min(bm25) OVER ()) END AS keyword FROM best),
met AS (SELECT m.*, coalesce(s.similarity, 0.0) AS base, coalesce(k.keyword, 0.0) AS keyword FROM (SELECT id, similarity FROM sim) s FULL JOIN keyed k ON s.id = k.id JOIN memories m ON m.id = coalesce(s.id, k.id)),
parts AS (SELECT id, created_at, keyword, CAST(least(1.0, base + CASE WHEN branch = 'main' THEN 0.1 ELSE 0 END + CASE WHEN contains('fr', lower(language)) THEN 0.1 ELSE 0 END + CASE WHEN list_has_any(list_transform(tags, lambda x: lower(x)), ['tag3', 'tag1']) THEN 0.2 ELSE 0 END) AS DOUBLE) AS similarity,
  CASE WHEN created_at >= TIMESTAMP '2024-03-01 00:00:00' THEN 1.0 ELSE pow(2.0, -(epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(created_at)) / 86400000000.0 / 30.0) END AS recency,
  greatest(0.0, least(1.0, len(list_filter(tags, lambda x: list_contains({wide!r}, lower(x)))) / len(tags) + CASE WHEN recall_count > 0 THEN 0.0 ELSE 0.15 END - CASE WHEN type = 'task_archive' THEN 0.2 ELSE 0.0 END)) AS domain FROM met),
scored AS (SELECT *, 0.4 * similarity + 0.3 * keyword + 0.15 * recency + 0.15 * domain AS score, count(*) OVER () AS eligible FROM parts),
kept AS (SELECT * FROM scored WHERE (score >= CASE WHEN eligible <= 5 THEN 0.1 ELSE 0.4 END) OR id = (SELECT id FROM scored ORDER BY round(score, 9) DESC, id LIMIT 1)),
placed AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM kept WHERE created_at >= TIMESTAMP '2024-02-01 00:00:00' AND created_at < TIMESTAMP '2024-02-29 23:59:59.999')
SELECT id, round(score, 6) AS score, round(keyword, 6) AS keyword, round(similarity, 6) AS similarity, eligible, CAST(rank AS INTEGER) AS rank FROM placed WHERE rank <= 30""".replace("{similar}", SIMILAR_SQL.replace("{norm}", f"sqrt({float(len(wide))})"))


def _search(t: Tables, words: str):
    raw = f"lang:fr tags:tag3,Tag1 branch:main {words} last month"
    found = R.memory_search(t.memories, t.index("memories", "title", "content", "tags[]"), raw, REPO, AS_OF, t.as_of, 0, 30)
    return found.select("id", F.round("score", 6).alias("score"), F.round("keyword", 6).alias("keyword"), F.round("similarity", 6).alias("similarity"), "eligible", "rank")


@query("R7 memory search: tags, date phrase, term vectors and full text, affinity, blend, window", _search_sql(["au", "th"]))
def memory_search(t: Tables):
    return _search(t, "au th")


@query("R7 F8 memory search with synonyms and without a full-text hit", _search_sql(["ui", "th"]))
def memory_search_synonyms(t: Tables):
    return _search(t, "ui th")


@query(
    "R5 full-text first, substring fallback, P6, Q9",
    "SELECT id, title FROM memories WHERE content ILIKE '%trash%' OR title ILIKE '%trash%' OR array_to_string(tags, ' ') ILIKE '%trash%'",
)
def memory_search_like(t: Tables):
    df = t.memories.withColumn("tag_text", F.array_join("tags", " "))
    first = R.bm25(df, "zzzznothing", [], None, t.index("memories", "title", "content", "tags[]")).select("id", "title")
    second = text_index.substring_search(t.trigrams("memories", df, "memories", ["content", "title", "tag_text"], []), "trash").select("id", "title")
    return R.with_fallback(first, second)


_CHANGED_SQL = f"""changed AS (SELECT id, {BODY_SQL} AS body FROM memories WHERE id % 10 NOT IN (3, 4)
  UNION ALL SELECT id, 'something about the ' || title FROM memories WHERE id % 10 = 4 UNION ALL SELECT id + 1000000000, 'nothing else, ' || title FROM memories WHERE id % 10 = 5)"""


@query(
    "R4 S13 ST7 full-text search after rows came, changed and went",
    f"WITH {_CHANGED_SQL}, {bm25_sql('changed', 'body', ['th', 'ing'])} SELECT id, round(bm25, 6) AS bm25 FROM bm",
)
def memory_index_changed(t: Tables):
    body = F.concat_ws(" ", "title", "content", F.array_join("tags", " "))
    rows = t.memories.select("id", body.alias("body"), "title")
    store = text_index.IndexStore(t.spark, f"{shared_root(t.spark)}/quernstone/index-{uuid.uuid4().hex}")
    store.create(rows)
    store.apply(rows.where("id % 10 = 4").select("id", F.concat(F.lit("something about the "), "title").alias("body")), rows.where("id % 10 = 3"))
    new = rows.where("id % 10 = 5").select((F.col("id") + 1_000_000_000).alias("id"), F.concat(F.lit("nothing else, "), "title").alias("body"))
    store.apply(new, rows.where("false"))
    return R.indexed_bm25(store.index(), ("th", "ing")).select("id", F.round("bm25", 6).alias("bm25"))


@query(
    "P13 time window, F23 relative dates",
    f"SELECT id, {stamp_sql('created_at')} AS created FROM memories WHERE created_at >= TIMESTAMP '2024-02-01 00:00:00' AND created_at < TIMESTAMP '2024-02-29 23:59:59.999'",
)
def memory_search_time_window(t: Tables):
    w = querytext.time_window("decisions last month", AS_OF)
    at = F.col("created_at")
    return t.memories.where((at >= F.lit(w.since).cast("timestamp_ntz")) & (at < F.lit(w.until).cast("timestamp_ntz"))).select("id", stamp("created_at").alias("created"))


@query(
    "F21 affinity boost",
    """SELECT id, round(CAST(least(1.0, 0.3 + CASE WHEN branch = 'main' THEN 0.1 ELSE 0 END + CASE WHEN contains('x/src/src1/a.en', folder) THEN 0.15 ELSE 0 END + CASE WHEN contains('en', lower(language)) THEN 0.1 ELSE 0 END
  + CASE WHEN contains('find fr in src/src2', lower(folder)) THEN 0.15 ELSE 0 END + CASE WHEN contains('find fr in src/src2', lower(language)) THEN 0.1 ELSE 0 END + CASE WHEN list_has_any(list_transform(tags, lambda x: lower(x)), ['tag1', 'src3']) THEN 0.2 ELSE 0 END) AS DOUBLE), 6) AS boosted FROM memories""",
)
def memory_affinity_boost(t: Tables):
    row = {c: F.col(c) for c in ("branch", "folder", "language", "tags")}
    wanted = {"branch": "main", "path": "x/src/src1/a.en", "query": "find fr in src/src2", "tags": ["Tag1", "src3"]}
    return t.memories.select("id", F.round(scoring.affinity(F.lit(0.3), row, wanted), 6).alias("boosted"))


@query(
    "R18 recap, A1 counts by type (archived ones too, Q17), A2",
    """SELECT type, count(*) AS n, (SELECT count(*) FROM memories WHERE repo = 'src1' AND status = 'active' AND type <> 'task_archive') AS total FROM memories WHERE repo = 'src1' AND type <> 'task_archive' GROUP BY type""",
)
def memory_recap(t: Tables):
    own = R.scoped(t.memories, REPO)
    total = own.where("status = 'active' AND type <> 'task_archive'").agg(F.count("*").alias("total"))
    return own.where("type <> 'task_archive'").groupBy("type").agg(F.count("*").alias("n")).join(F.broadcast(total))


@query(
    "R18 the top of a recap",
    "SELECT id, code, title, type, importance, recall_count > 0 AS acknowledged FROM memories WHERE repo = 'src1' AND status = 'active' AND type <> 'task_archive' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-03-01 00:00:00') ORDER BY importance DESC, created_at DESC, id LIMIT 20",
)
def memory_recap_top(t: Tables):
    top = R.recap_top(t.memories, REPO, t.as_of, 20)
    return top.select("id", "code", "title", "type", "importance", (F.col("recall_count") > 0).alias("acknowledged"))


@query(
    "T1 recent memories",
    f"SELECT id, importance, {stamp_sql('created_at')} AS created FROM memories WHERE repo = 'src1' ORDER BY importance DESC, created_at DESC, id LIMIT 10 OFFSET 3",
)
def memory_recent(t: Tables):
    return R.scoped(t.memories, REPO).orderBy(F.col("importance").desc(), F.col("created_at").desc(), "id").offset(3).limit(10).select("id", "importance", stamp("created_at").alias("created"))


@query(
    "R19 dashboard list, W1 total with page, P5 range, P14 recall rate, P17, T4, S21",
    """SELECT id, importance, round(CASE WHEN hit_count > 0 THEN recall_count / hit_count ELSE 0 END, 6) AS recall_rate, count(*) OVER () AS total FROM memories
WHERE importance BETWEEN 2 AND 4 AND type IN ('decision', 'pattern') AND (title ILIKE '%th%' OR content ILIKE '%th%') ORDER BY CASE WHEN hit_count > 0 THEN recall_count / hit_count ELSE 0 END DESC, id LIMIT 20 OFFSET 20""",
)
def memory_dashboard_list(t: Tables):
    found = t.memories.where(F.col("importance").between(2, 4) & F.col("type").isin("decision", "pattern") & R.substring("th", "title", "content"))
    offset, limit = querytext.page(2, 20)
    page = S.paged(S.with_recall_rate(found), [F.col("recall_rate").desc(), "id"], offset, limit)
    return page.select("id", "importance", F.round("recall_rate", 6).alias("recall_rate"), "total")


CODES = ["MEM-000030", "MEM-000007", "MEM-000030", "MEM-999999", "MEM-000001"]


@query(
    "S5 order-preserving lookup, S3, S4, S6",
    """WITH wanted(pos, code) AS (VALUES (0, 'MEM-000030'), (1, 'MEM-000007'), (2, 'MEM-999999'), (3, 'MEM-000001')) SELECT CAST(pos AS INTEGER) AS pos, code, id FROM wanted JOIN memories USING (code)""",
)
def memory_by_codes_ordered(t: Tables):
    return R.in_order(t.memories, CODES).select("pos", "code", "id")


@query("S2 S4 bulk lookup with filters", "SELECT id, type FROM memories WHERE id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) AND type = 'pattern' AND status = 'active'")
def memory_by_ids(t: Tables):
    return t.memories.where(F.col("id").isin(1, 2, 3, 5, 8, 13, 21, 34, 55, 89) & (F.col("type") == "pattern") & (F.col("status") == "active")).select("id", "type")


def _terms_sql(source: str) -> str:
    return f"""tok AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({TOKENS_SQL.replace("{c}", "content")}) AS term FROM {source}) GROUP BY id, term),
norms AS (SELECT id, sqrt(CAST(sum(tf * tf) AS DOUBLE)) AS norm FROM tok GROUP BY id)"""


@query(
    "R14 conflict check of memories, Q5",
    f"""WITH pool AS (SELECT * FROM memories WHERE (repo = '{REPO}' OR is_global) AND status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-03-01 00:00:00') ORDER BY repo = '{REPO}' DESC, importance DESC, created_at DESC, id LIMIT 10),
{cosine_sql("pool", "content", {"heth": 1, "ing": 1, "the.": 1})}, {SIMILAR_SQL.replace("{norm}", "sqrt(3.0)")}
SELECT id, round(similarity, 6) AS similarity, similarity >= 0.85 AS conflict FROM sim ORDER BY round(similarity, 9) DESC, id LIMIT 1""",
)
def memory_conflicts(t: Tables):
    pool = R.candidates(t.memories, REPO, "heth ing the.", t.as_of, 1)
    best = pool.orderBy(F.round("similarity", 9).desc(), "id").limit(1)
    return best.select("id", F.round("similarity", 6).alias("similarity"), (F.col("similarity") >= 0.85).alias("conflict"))


@query(
    "J23 similarity join of standards with those of their repository and global ones, five best",
    f"""WITH s AS (SELECT * FROM standards), {_terms_sql("s")},
dots AS (SELECT x.id AS a, y.id AS b, CAST(sum(x.tf * y.tf) AS DOUBLE) AS dot FROM tok x JOIN tok y ON x.term = y.term AND x.id < y.id GROUP BY x.id, y.id),
sims AS (SELECT a, b, dot / (p.norm * q.norm) AS similarity FROM dots JOIN norms p ON p.id = a JOIN norms q ON q.id = b WHERE dot / (p.norm * q.norm) >= 0.6),
ways AS (SELECT a, b, similarity FROM sims UNION ALL SELECT b, a, similarity FROM sims),
twice AS (SELECT a, b, similarity FROM ways JOIN s p ON p.id = a JOIN s q ON q.id = b WHERE p.repo = q.repo OR q.is_global)
SELECT a, b, round(similarity, 6) AS similarity FROM twice QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(similarity, 9) DESC, b) <= 5""",
)
def near_duplicate_pairs(t: Tables):
    return similarity.similar_pairs(t.standards, "content", 0.6, 5, "repo", "is_global").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    "A28 grouped summary with caps",
    """WITH r AS (SELECT id, type, row_number() OVER (ORDER BY importance DESC, id) AS rank FROM memories WHERE repo = 'src1'),
p AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY rank) AS place, count(*) OVER (PARTITION BY type) AS n, CASE WHEN type = 'task_archive' THEN 2 ELSE 5 END AS cap FROM r)
SELECT id, type, CAST(rank AS INTEGER) AS rank, CAST(place AS INTEGER) AS place, greatest(0, n - cap) AS more FROM p WHERE place <= cap""",
)
def memory_grouped_summary(t: Tables):
    found = R.summary_by_group(R.scoped(t.memories, REPO).select("id", "type", "importance"), "type", [("importance", True), ("id", False)], {"task_archive": 2})
    return found.select("id", "type", "rank", "place", "more")


@query(
    "A29 timeline by day of the top of a recap",
    "WITH top AS (SELECT * FROM memories WHERE repo = 'src1' AND status = 'active' AND type <> 'task_archive' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-03-01 00:00:00') ORDER BY importance DESC, created_at DESC, id LIMIT 50) SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, array_to_string(list(code ORDER BY created_at DESC, id), ',') AS codes FROM top GROUP BY 1",
)
def memory_timeline(t: Tables):
    day = F.date_format("created_at", "yyyy-MM-dd").alias("day")
    each = R.recap_top(t.memories, REPO, t.as_of, 50).groupBy(day).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("k"), "id", "code"))).alias("c"))
    return each.select("day", "n", F.array_join(F.transform("c", lambda x: x["code"]), ",").alias("codes"))


@query("P7 tag membership without case, Q10", "SELECT id FROM memories WHERE list_has_any(list_transform(tags, lambda x: lower(x)), ['tag2', 'es'])")
def tag_filter(t: Tables):
    return t.memories.where(R.has_tag(["TAG2", "es"])).select("id")


@query("F42 tag explode, A25 distinct tags", "SELECT tag, count(*) AS n, count(DISTINCT repo) AS repos FROM (SELECT lower(unnest(tags)) AS tag, repo FROM memories) GROUP BY tag")
def tag_explode_counts(t: Tables):
    each = t.memories.select(F.explode("tags").alias("tag"), "repo").withColumn("tag", F.lower("tag"))
    return each.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("repo").alias("repos"))


#: Cells probed, of so many: at least 0.9 of the ten nearest are found.
PROBED = (24, 32)
VECTOR = [((i * 7) % 13 - 6) / 10 for i in range(64)]
VECTOR_SQL = "CAST([" + ", ".join(map(str, VECTOR)) + "] AS DOUBLE[])"


@query("R12 T5 F11 dense vector search, J1", f"SELECT id, round(list_cosine_similarity(CAST(vector AS DOUBLE[]), {VECTOR_SQL}), 6) AS similarity FROM vectors ORDER BY round(list_cosine_similarity(CAST(vector AS DOUBLE[]), {VECTOR_SQL}), 9) DESC, id LIMIT 10")
def vector_topk(t: Tables):
    return R.nearest(t.vectors, VECTOR, 10).select("id", F.round("similarity", 6).alias("similarity"))


@query(
    "R12 T5 nearest vectors by the inverted file, all cells probed, every twentieth row against all rows",
    """WITH q AS (SELECT id AS query, CAST(vector AS DOUBLE[]) AS asked FROM vectors WHERE id % 20 = 0),
near AS (SELECT query, id, round(list_cosine_similarity(asked, CAST(vector AS DOUBLE[])), 9) AS similarity FROM q JOIN vectors ON id <> query)
SELECT query, id, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM near QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) <= 10""",
)
def vector_index_exact(t: Tables):
    found = vector_index.search(vector_index.build(t.vectors), t.vectors.where("id % 20 = 0"), 10)
    return found.select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query("R12 T5 nearest vectors by the inverted file, some cells probed, every twentieth row against all rows")
def vector_index_search(t: Tables):
    found = vector_index.search(vector_index.build(t.vectors, cells=PROBED[1]), t.vectors.where("id % 20 = 0"), 10, PROBED[0])
    return found.select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    "R13 context blend, U4 difference, active tasks",
    f"""WITH pool AS (SELECT m.*, 0.3 * list_cosine_similarity(CAST(v.vector AS DOUBLE[]), {VECTOR_SQL}) + 0.7 * importance / 5.0 AS score FROM memories m JOIN vectors v ON m.id = v.id WHERE m.status = 'active'),
top AS (SELECT * FROM pool WHERE type IN ('pattern', 'mistake', 'decision') ORDER BY round(score, 9) DESC, id LIMIT 20)
SELECT id, round(score, 6) AS score, 'memory' AS part FROM top UNION ALL SELECT id, CAST(priority AS DOUBLE), 'task' FROM (SELECT * FROM tasks WHERE repo = 'repo1' AND status IN ('in_progress', 'pending', 'backlog', 'blocked') ORDER BY CASE status WHEN 'in_progress' THEN 0 WHEN 'pending' THEN 1 WHEN 'backlog' THEN 2 ELSE 3 END, priority DESC NULLS LAST, created_at, id LIMIT 10) UNION ALL SELECT id, round(score, 6), 'decision' FROM (SELECT * FROM pool WHERE type = 'decision' AND id NOT IN (SELECT id FROM top) ORDER BY created_at DESC, id LIMIT 10)""",
)
def agent_context(t: Tables):
    similarity = scoring.dense_cosine(F.col("vector"), F.array(*map(F.lit, VECTOR)))
    pool = t.memories.where("status = 'active'").join(t.vectors.select("id", "vector"), "id").withColumn("score", 0.3 * similarity + 0.7 * F.col("importance") / 5.0)
    top = pool.where(F.col("type").isin("pattern", "mistake", "decision")).orderBy(F.round("score", 9).desc(), "id").limit(20)
    rest = pool.where("type = 'decision'").join(top.select("id"), "id", "left_anti").orderBy(F.col("created_at").desc(), "id").limit(10)
    pick = lambda df, part: df.select("id", F.round("score", 6).alias("score"), F.lit(part).alias("part"))
    active = t.tasks.where((F.col("repo") == "repo1") & F.col("status").isin("in_progress", "pending", "backlog", "blocked")).orderBy(*board_order()).limit(10)
    tasks = pick(active.withColumn("score", F.col("priority").cast("double")), "task")
    return pick(top, "memory").unionByName(pick(rest, "decision")).unionByName(tasks)


@query("J17 vector supplement", "SELECT id FROM memories WHERE repo = 'src1' UNION SELECT id FROM vectors WHERE repo = 'repo3'")
def vector_supplement(t: Tables):
    return R.merged_with_vectors(R.scoped(t.memories, REPO).select("id"), t.vectors.where("repo = 'repo3'").select("id"))


def standard_keyword(query_: str):
    """Weighted coverage of the query's words in title, context, tags, stack and content, and a phrase bonus."""
    words = [w for w in dict.fromkeys(__import__("re").split("[^a-z0-9]+", query_.lower())) if len(w) >= 2]
    fields = {"title": 0.45, "context": 0.15, "tag_text": 0.15, "stack_text": 0.05, "content": 0.2}
    score = F.lit(0.0)
    for name, weight in fields.items():
        hits = F.lit(0)
        for w in words:
            hits = hits + F.lower(name).contains(w).cast("int")
        score = score + hits / len(words) * weight
    phrase = query_.lower().strip()
    bonus = F.lit(0.0)
    if len(phrase) >= 6:
        held = F.lower("title").contains(phrase) | F.lower("content").contains(phrase) | F.lower("tag_text").contains(phrase)
        bonus = F.when(held, 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), score + bonus)


_KEY_SQL = "least(1.0, (CAST(contains(lower(title), 'that') AS INT) + CAST(contains(lower(title), 'thing') AS INT)) / 2.0 * 0.45 + (CAST(contains(context, 'that') AS INT) + CAST(contains(context, 'thing') AS INT)) / 2.0 * 0.15 + (CAST(contains(array_to_string(tags, ' '), 'that') AS INT) + CAST(contains(array_to_string(tags, ' '), 'thing') AS INT)) / 2.0 * 0.15 + (CAST(contains(array_to_string(stack, ' '), 'that') AS INT) + CAST(contains(array_to_string(stack, ' '), 'thing') AS INT)) / 2.0 * 0.05 + (CAST(contains(lower(content), 'that') AS INT) + CAST(contains(lower(content), 'thing') AS INT)) / 2.0 * 0.2 + CASE WHEN contains(lower(title), 'that thing') OR contains(lower(content), 'that thing') OR contains(array_to_string(tags, ' '), 'that thing') THEN 0.2 ELSE 0 END)"


@query(
    "R11 standard search, F4 F14 F17 F18 F20, P9, Q8",
    f"""WITH pool AS (SELECT *, title || ' ' || content || ' ' || context || ' ' || language || ' ' || version || ' ' || array_to_string(stack, ' ') || ' ' || array_to_string(tags, ' ') AS hay FROM standards WHERE (repo = 'src1' OR is_global) AND list_contains(stack, 'stack2')),
{cosine_sql("pool", "hay", {"thing": 1})},
parts AS (SELECT p.*, coalesce(dot / norm, 0.0) AS similarity, {_KEY_SQL} AS keyword,
  exp(-(epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(coalesce(last_used_at, updated_at))) / 86400000000.0 / 180.0) AS raw, (1 + CASE WHEN context = 'api' THEN 1 ELSE 0 END) / 2.0 AS domain FROM pool p LEFT JOIN norms USING (id) LEFT JOIN dots USING (id)),
scored AS (SELECT *, 0.4 * similarity + 0.3 * keyword + 0.15 * least(1.0, raw) + 0.15 * domain AS score, count(*) OVER () AS eligible FROM parts),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM scored)
SELECT id, round(score, 3) AS score, CAST(rank AS INTEGER) AS rank, CASE WHEN score >= 0.72 OR keyword >= 0.85 THEN 'high' WHEN score >= 0.42 OR keyword >= 0.45 THEN 'medium' ELSE 'low' END AS confidence
FROM ranked WHERE (score >= CASE WHEN eligible <= 5 THEN 0.08 ELSE 0.2 END OR rank = 1) AND rank <= 20""",
)
def standard_search(t: Tables):
    pool = t.standards.where(((F.col("repo") == REPO) | F.col("is_global")) & F.array_contains("stack", "stack2"))
    pool = pool.withColumn("tag_text", F.array_join("tags", " ")).withColumn("stack_text", F.array_join("stack", " "))
    pool = pool.withColumn("hay", F.concat_ws(" ", "title", "content", "context", "language", "version", "stack_text", "tag_text"))
    domain = (1 + (F.col("context") == "api").cast("int")) / 2.0
    pool = pool.select("id", R.tf_cosine("hay", "that thing").alias("similarity"), standard_keyword("that thing").alias("keyword"), scoring.recency(F.coalesce("last_used_at", "updated_at"), t.as_of, "standard").alias("recency"), domain.alias("domain"))
    found = R.hybrid(pool, "standard", limit=20)
    return found.select("id", F.round("score", 3).alias("score"), "rank", scoring.standard_confidence(F.col("score"), F.col("keyword")).alias("confidence"))


@query(
    "R15 conflict check of standards",
    f"""WITH target AS (SELECT * FROM standards ORDER BY id LIMIT 1), s AS (SELECT * FROM standards WHERE (repo = (SELECT repo FROM target) OR is_global) AND id <> (SELECT id FROM target) ORDER BY created_at DESC, id LIMIT 80),
texts AS (SELECT id, content FROM s UNION ALL SELECT id, content FROM target), {_terms_sql("texts")}, t_tok AS (SELECT term, tf FROM tok WHERE id = (SELECT id FROM target)),
dots AS (SELECT id, CAST(sum(tok.tf * t_tok.tf) AS DOUBLE) AS dot FROM tok JOIN t_tok USING (term) GROUP BY id)
SELECT s.id, round(dot / (norm * (SELECT norm FROM norms WHERE id = (SELECT id FROM target))), 6) AS similarity,
  dot / (norm * (SELECT norm FROM norms WHERE id = (SELECT id FROM target))) >= 0.82 AND s.version = (SELECT version FROM target) AND s.language = (SELECT language FROM target) AND list_has_any(s.stack, (SELECT stack FROM target)) AS conflict
FROM s JOIN dots USING (id) JOIN norms USING (id)""",
)
def standard_conflicts(t: Tables):
    target = t.standards.orderBy("id").limit(1).select(F.col("id").alias("t"), F.col("repo").alias("t_repo"), "content", F.col("version").alias("t_version"), F.col("language").alias("t_language"), F.col("stack").alias("t_stack"))
    reach = t.standards.join(F.broadcast(target.select("t", "t_repo"))).where(((F.col("repo") == F.col("t_repo")) | F.col("is_global")) & (F.col("id") != F.col("t"))).drop("t", "t_repo")
    pool = reach.orderBy(F.col("created_at").desc(), "id").limit(80)  # the newest, as many as are looked at
    terms = pool.select("id", "content").unionByName(target.select(F.col("t").alias("id"), "content")).select("id", F.explode(text.tokens(F.col("content"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    norms = terms.groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf")).cast("double")).alias("norm"))
    own = terms.join(F.broadcast(target.select("t")), F.col("id") == F.col("t"), "left_semi").select("term", F.col("tf").alias("x"))
    dots = terms.join(F.broadcast(own), "term").groupBy("id").agg(F.sum(F.col("tf") * F.col("x")).alias("dot"))
    t_norm = norms.join(F.broadcast(target.select("t")), F.col("id") == F.col("t"), "left_semi").select(F.col("norm").alias("t_norm"))
    met = pool.join(dots, "id").join(norms, "id").join(F.broadcast(target.drop("content"))).join(F.broadcast(t_norm))
    similarity = F.col("dot") / (F.col("norm") * F.col("t_norm"))
    conflict = (similarity >= 0.82) & (F.col("version") == F.col("t_version")) & (F.col("language") == F.col("t_language")) & F.arrays_overlap("stack", "t_stack")
    return met.select("id", F.round(similarity, 6).alias("similarity"), conflict.alias("conflict"))


_EXPANDED_SQL = " OR ".join(f"contains(lower(description), '{w}')" for w in ("error", "bug", "issue", "failure", "mistake", "fix", "exception"))


@query("F8 query expansion, P4 exclusion", f"SELECT id FROM tasks WHERE status NOT IN ('completed', 'canceled') AND ({_EXPANDED_SQL})")
def expanded_terms(t: Tables):
    found = F.lit(False)
    for w in querytext.expanded("error").split():
        found = found | F.lower("description").contains(w)
    return t.tasks.where(~F.col("status").isin("completed", "canceled") & found).select("id")


@query("P18 P19 inline tags", "SELECT id FROM memories WHERE language = 'fr' AND branch = 'dev' AND list_has_any(list_transform(tags, lambda x: lower(x)), ['tag1', 'tag3']) AND content ILIKE '%le%'")
def memory_inline_tags(t: Tables):
    asked = querytext.tagged("lang:fr branch:dev tags:tag1,tag3 le", "memory")
    scope = asked.filters["scope"]
    return t.memories.where((F.col("language") == scope["language"]) & (F.col("branch") == scope["branch"]) & R.has_tag(asked.filters["current_tags"]) & R.substring(asked.query, "content")).select("id")


@query("F37 completion rank", "SELECT id, CAST(CASE WHEN lower(repo) = 'src1' THEN 100 WHEN starts_with(lower(repo), 'src1') THEN 75 WHEN contains(lower(repo), 'src1') THEN 50 ELSE 0 END AS INTEGER) AS score FROM memories WHERE contains(lower(repo), 'src1') ORDER BY score DESC, id LIMIT 50")
def completion_rank(t: Tables):
    return t.memories.select("id", text.completion_score(F.col("repo"), "SRC1").alias("score")).where("score > 0").orderBy(F.col("score").desc(), "id").limit(50)


@query("F32 content hash", "SELECT id, sha256('{\"id\":' || id || ',\"lang\":\"' || language || '\",\"repo\":\"' || repo || '\"}') AS hash FROM memories")
def content_hash(t: Tables):
    return t.memories.select("id", F.col("language").alias("lang"), "repo").select("id", text.content_hash("id", "lang", "repo").alias("hash"))


@query("P1 decode with defaults, Q27", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CAST(0 AS INTEGER) AS n_tags FROM events")
def json_decode(t: Tables):
    raw = t.table("events").select("event_id", F.col("props").alias("metadata"), F.concat(F.lit("["), F.col("props")).alias("tags"))
    return S.decoded(raw).select("event_id", F.col("metadata")["k"].cast("long").alias("k"), F.size("tags").alias("n_tags"))


@query(
    "F26 F27 F29 F33 F35 F41 scalars",
    r"""SELECT id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, CASE WHEN length(content) = 0 THEN 0 ELSE CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS INTEGER) END AS lines,
  'Mentioned in memory: ' || title AS note, list_last(string_split('org/team/' || repo, '/')) AS repo_name, length(trim(regexp_replace(content, '\s+', ' ', 'g'))) <= 140 AS short FROM memories""",
)
def memory_scalars(t: Tables):
    short = F.length(F.trim(F.regexp_replace("content", r"\s+", " "))) <= 140
    return t.memories.select("id", text.slug(F.col("title")).alias("slug"), text.line_count(F.col("content")).alias("lines"), F.concat(F.lit("Mentioned in memory: "), "title").alias("note"), text.repo_name(F.concat(F.lit("org/team/"), "repo")).alias("repo_name"), short.alias("short"))


@query("S11 export", "SELECT id, '{\"id\":' || id || ',\"code\":\"' || code || '\",\"importance\":' || importance || '}' AS json FROM memories")
def export_json(t: Tables):
    return t.memories.select("id", "code", "importance").select("id", F.to_json(F.struct("id", "code", "importance")).alias("json"))


@query(
    "S12 import upsert of standards",
    "SELECT id, title FROM standards WHERE context <> 'api' UNION ALL SELECT id, 'new' AS title FROM standards WHERE context = 'api'",
)
def standards_import(t: Tables):
    base = t.standards.select("id", "code", "title")
    new = t.standards.where("context = 'api'").select((F.col("id") + 10_000_000).alias("id"), "code", F.lit("new").alias("title"))
    return S.merged_standards(base, new).select("id", "title")


@query("S6 X26 identifiers to ids", "SELECT 'MEM-' || lpad(CAST(i AS VARCHAR), 6, '0') AS identifier, CAST(CASE WHEN i IN (SELECT id FROM memories) THEN i END AS VARCHAR) AS id FROM range(0, 2000, 50) r(i) UNION ALL SELECT '123e4567-e89b-12d3-a456-426614174000', '123e4567-e89b-12d3-a456-426614174000'")
def resolved_ids(t: Tables):
    asked = t.spark.range(0, 2000, 50).select(F.concat(F.lit("MEM-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("identifier"))
    uuid = t.spark.range(1).select(F.lit("123e4567-e89b-12d3-a456-426614174000").alias("identifier"))
    return R.resolved_ids(asked.unionByName(uuid), t.memories)


@query("X18 new memories from drafts", "SELECT id, strftime(TIMESTAMP '2024-03-01 00:00:00' + to_days(CAST(id % 9 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS expires, array_to_string(list_distinct(list_concat(tags, [language])), '') = array_to_string(list_distinct(tags), '') AS known FROM memories")
def memory_drafts(t: Tables):
    from ..operators.lifecycle import new_memories

    drafts = t.memories.select("id", "tags", "language", (F.col("id") % 9).cast("int").alias("ttl_days"))
    made = new_memories(drafts, t.as_of)
    return made.select("id", stamp("expires_at").alias("expires"), (F.size("tags") == 3).alias("known"))

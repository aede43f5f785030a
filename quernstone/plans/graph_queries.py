"""Queries of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph as G
from ..sources import tables as S
from .bindings import Tables
from .registry import query
from .retrieval_queries import STOP_SQL

DEGREE_SQL = "deg AS (SELECT repo, node, count(*) AS degree FROM (SELECT repo, from_entity AS node FROM relations UNION ALL SELECT repo, to_entity FROM relations) GROUP BY repo, node)"
REPO = "kg1"
OWN_SQL = f"own AS (SELECT * FROM relations WHERE repo = '{REPO}'), names AS (SELECT name FROM entities WHERE repo = '{REPO}')"
PAGE_SQL = f"{DEGREE_SQL}, {OWN_SQL}, page AS (SELECT name, coalesce(degree, 0) AS degree FROM names LEFT JOIN deg ON node = name AND repo = '{REPO}' ORDER BY coalesce(degree, 0) DESC, name LIMIT 40)"


@query("A12 U2 degrees, Q26", f"WITH {DEGREE_SQL} SELECT repo, node, degree FROM deg")
def kg_degrees(t: Tables):
    return G.degrees(t.relations)


@query(
    "A12 G2 degrees kept by changes: relations that came and went",
    f"WITH left_ AS (SELECT * FROM relations WHERE relation_type <> 'supplied'), {DEGREE_SQL.replace('FROM relations', 'FROM left_')} SELECT repo, node, degree FROM deg",
)
def kg_degrees_maintained(t: Tables):
    first = t.relations.where("relation_type != 'returned'")
    none = t.relations.where("false")
    changes = G.degree_changes(first, none).unionByName(G.degree_changes(t.relations.where("relation_type = 'returned'"), first.where("relation_type = 'supplied'")))
    return G.summed_degrees(changes)


def _own(df, repo: str = REPO):
    return df.where(F.col("repo") == repo)


def _page(t: Tables, size: int = 40, offset: int = 0):
    order = [F.col("degree").desc(), F.col("name")]
    return G.ranked_nodes(_own(t.entities), _own(t.relations)).orderBy(*order).offset(offset).limit(size), order


@query("T7 nodes by degree", f"WITH {PAGE_SQL} SELECT name, degree, CAST(row_number() OVER (ORDER BY degree DESC, name) AS INTEGER) AS rank FROM page")
def kg_nodes_ranked(t: Tables):
    page, order = _page(t)
    return page.select("name", "degree", F.row_number().over(Window.partitionBy().orderBy(*order)).alias("rank"))


@query(
    "G2 J7 edges by degree, T6 cap",
    f"""WITH {DEGREE_SQL}, e AS (SELECT r.*, f.degree + d.degree AS degree_sum FROM relations r JOIN deg f ON f.node = from_entity AND f.repo = r.repo JOIN deg d ON d.node = to_entity AND d.repo = r.repo WHERE (r.repo, from_entity) IN (SELECT repo, name FROM entities) AND (r.repo, to_entity) IN (SELECT repo, name FROM entities))
SELECT from_entity, to_entity, relation_type, degree_sum, (SELECT count(*) FROM e) > 300 AS truncated FROM e ORDER BY degree_sum DESC, from_entity, to_entity, relation_type LIMIT 300""",
)
def kg_edges_ranked(t: Tables):
    order = [F.col("degree_sum").desc(), "from_entity", "to_entity", "relation_type"]
    return G.capped(G.ranked_edges(t.entities, t.relations), order, 300).select("from_entity", "to_entity", "relation_type", "degree_sum", "truncated")


@query(
    "G1 J8 T6 graph window: nodes by degree, edges among them up to a cap, whether more were left out",
    f"WITH {PAGE_SQL}, inside AS (SELECT from_entity, to_entity, relation_type FROM own WHERE from_entity IN (SELECT name FROM page) AND to_entity IN (SELECT name FROM page)) SELECT *, (SELECT count(*) FROM inside) > 60 AS truncated, (SELECT count(*) FROM names) AS total FROM inside ORDER BY from_entity, to_entity, relation_type LIMIT 60",
)
def kg_subgraph(t: Tables):
    page, _ = _page(t)
    total = _own(t.entities).agg(F.count("*").alias("total"))
    inside = G.subgraph(t.relations, page).select("from_entity", "to_entity", "relation_type")
    return G.capped(inside, ["from_entity", "to_entity", "relation_type"], 60).join(F.broadcast(total))


@query("J9 neighbours", "SELECT DISTINCT repo, from_entity, to_entity, relation_type FROM relations WHERE repo = 'kg0' AND (from_entity IN ('supplier 4', 'nation NATION_3', 'brand Brand#1') OR to_entity IN ('supplier 4', 'nation NATION_3', 'brand Brand#1'))")
def kg_neighbors(t: Tables):
    names = _own(t.entities, "kg0").where(F.col("name").isin("supplier 4", "nation NATION_3", "brand Brand#1"))
    return G.neighbours(t.relations, names).select("repo", "from_entity", "to_entity", "relation_type")


@query(
    "J16 U3 L5 orphans",
    """WITH used AS (SELECT repo, entity_name AS name FROM observations WHERE observation = 'purchase 3' UNION SELECT repo, from_entity FROM relations WHERE relation_type = 'returned' AND to_entity = 'brand Brand#1' UNION SELECT repo, to_entity FROM relations WHERE relation_type = 'part_of' AND repo = 'kg0')
SELECT repo, name FROM entities WHERE type IN ('supplier', 'region') AND (repo, name) NOT IN (SELECT repo, name FROM used)""",
)
def kg_orphans(t: Tables):
    relations = t.relations.where("(relation_type = 'part_of' AND repo = 'kg0') OR (relation_type = 'returned' AND to_entity = 'brand Brand#1')")
    return G.orphans(t.entities.where("type IN ('supplier', 'region')"), relations, t.observations.where("observation = 'purchase 3'")).select("repo", "name")


@query(
    "J21 G5 co-mentions",
    """WITH f AS (SELECT doc, name, min(pos) AS pos FROM mentions GROUP BY doc, name) SELECT x.name AS a, y.name AS b, count(*) AS n, CAST(0.55 AS DOUBLE) AS confidence FROM f x JOIN f y ON x.doc = y.doc AND (x.pos, x.name) < (y.pos, y.name) GROUP BY 1, 2""",
)
def kg_comentions(t: Tables):
    return G.co_mentions(t.mentions)


@query("S14 insert or ignore, Q7", "SELECT entity_name || ' ' || observation AS name, min(id) AS id FROM observations WHERE observation NOT LIKE 'click%' GROUP BY 1")
def kg_insert_or_ignore(t: Tables):
    new = t.observations.select(F.concat_ws(" ", "entity_name", "observation").alias("name"), "id", "observation")
    return S.inserted(new.where("observation LIKE 'click%'"), new, ["name"], ["id"]).select("name", "id")


@query(
    "R16 F5 entities by text",
    """SELECT name, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')), ['supplier', '17', 'nation', '3', 'europe'])) AS INTEGER) AS hits FROM entities WHERE repo = 'kg1' AND len(list_intersect(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')), ['supplier', '17', 'nation', '3', 'europe'])) > 0 ORDER BY hits DESC, name LIMIT 50""",
)
def kg_entities_by_text(t: Tables):
    return G.matching_entities(t.entities, REPO, "Supplier 17, nation 3; Europe supplier").select("name", "hits")


@query(
    "R17 context of results: titles to observations to entities to relations",
    """WITH results AS (SELECT action || ' ' || (id % 7) AS title FROM actions ORDER BY id LIMIT 5),
e AS (SELECT DISTINCT entity_name FROM observations WHERE repo = 'kg1' AND (observation IN (SELECT 'click ' || substr(title, -1) FROM results) OR observation IN (SELECT title FROM results)) ORDER BY entity_name LIMIT 50)
SELECT DISTINCT from_entity, to_entity, relation_type FROM relations WHERE repo = 'kg1' AND (from_entity IN (SELECT * FROM e) OR to_entity IN (SELECT * FROM e))""",
)
def kg_context(t: Tables):
    results = t.actions.select("id", F.concat_ws(" ", "action", (F.col("id") % 7).cast("string")).alias("title")).orderBy("id").limit(5)
    noted = results.select(F.explode(F.array("title", F.concat(F.lit("click "), F.right("title", F.lit(1))))).alias("observation"))
    return G.context(t.relations, t.observations, REPO, noted).select("from_entity", "to_entity", "relation_type")


@query(
    "G3 entity detail: relations both ways and observations, of a name that two repositories have",
    """SELECT 'out' AS part, relation_type AS kind, to_entity AS value FROM relations WHERE repo = 'kg1' AND from_entity = 'nation NATION_5' UNION ALL SELECT 'in', relation_type, from_entity FROM relations WHERE repo = 'kg1' AND to_entity = 'nation NATION_5'
UNION ALL SELECT 'out', relation_type, to_entity FROM relations WHERE repo = 'kg1' AND from_entity = 'supplier 5' UNION ALL SELECT 'in', relation_type, from_entity FROM relations WHERE repo = 'kg1' AND to_entity = 'supplier 5'
UNION ALL SELECT 'observation', CAST(id AS VARCHAR), observation FROM observations WHERE repo = 'kg1' AND entity_name = 'supplier 5'""",
)
def kg_entity_detail(t: Tables):
    return G.entity_detail(t.relations, t.observations, REPO, "nation NATION_5").unionByName(G.entity_detail(t.relations, t.observations, REPO, "supplier 5"))


@query("G4 entity list", "SELECT name, type, count(*) OVER () AS total FROM entities WHERE repo = 'kg1' AND type IN ('nation', 'region') AND name ILIKE '%ion%1%' ORDER BY name LIMIT 10 OFFSET 2")
def kg_entity_list(t: Tables):
    found = _own(t.entities).where(F.col("type").isin("nation", "region") & F.col("name").ilike("%ion%1%"))
    return S.paged(found, ["name"], 2, 10).select("name", "type", "total")


@query("L5 observation pruning", "SELECT id FROM observations WHERE created_at >= TIMESTAMP '2024-01-25 00:00:00'")
def kg_prune_observations(t: Tables):
    from ..operators.lifecycle import pruned_observations

    return pruned_observations(t.observations, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).select("id")


@query(
    "U7 G15 unified graph",
    """SELECT 'kg:' || name AS id, 'kg' AS domain, name AS label, CAST(1 AS DOUBLE) AS size FROM entities UNION ALL SELECT 'memory:' || id, 'memory', CAST(id AS VARCHAR), CAST(importance AS DOUBLE) FROM memories
UNION ALL SELECT 'task:' || id, 'task', CAST(id AS VARCHAR), CAST(priority AS DOUBLE) FROM tasks WHERE status = 'blocked' UNION ALL SELECT 'code:' || id, 'code', CAST(id AS VARCHAR), CAST(end_line - start_line AS DOUBLE) FROM symbols""",
)
def unified_graph(t: Tables):
    return G.united({"kg": (t.entities, "name", F.lit(1)), "memory": (t.memories, "id", F.col("importance")), "task": (t.tasks.where("status = 'blocked'"), "id", F.col("priority")), "code": (t.symbols, "id", F.col("end_line") - F.col("start_line"))})


@query("J22 entities of a task with those of its parent", "WITH e AS (SELECT id, lower(word) AS name FROM (SELECT id, unnest(string_split(title, ' ')) AS word FROM tasks) WHERE length(word) >= 3) SELECT DISTINCT t.id AS task, x.name AS source, y.name AS target FROM tasks t JOIN e x ON x.id = t.id JOIN e y ON y.id = t.parent_id WHERE x.name <> y.name")
def kg_parent_refs(t: Tables):
    words = t.tasks.select("id", F.explode(F.split("title", " ")).alias("word")).where("length(word) >= 3").select("id", F.lower("word").alias("name"))
    return G.parent_pairs(t.tasks, words)


@query("A19 first observations", "SELECT entity_name, observation, min(id) AS id FROM observations GROUP BY entity_name, observation")
def dedupe_observations(t: Tables):
    from ..operators.lifecycle import first_observations

    return first_observations(t.observations)




@query(
    "G6 code in the knowledge graph",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY repo, caller_file ORDER BY caller_line, id) AS k FROM refs) SELECT DISTINCT repo, coalesce(caller_name, caller_file) AS from_entity, symbol_name AS to_entity, kind AS relation_type FROM r WHERE k <= 4000""",
)
def kg_code_relations(t: Tables):
    return G.code_relations(t.symbols, t.refs)[1].select("repo", "from_entity", "to_entity", "relation_type")


@query(
    "G5 F41 F39 observations of mentions",
    rf"""WITH w AS (SELECT DISTINCT title, unnest(regexp_extract_all(content, '[\p{{L}}\p{{N}}]+(?:[_.-][\p{{L}}\p{{N}}]+)*')) AS name FROM memories)
SELECT DISTINCT name AS entity_name, 'Mentioned in memory: ' || title AS observation FROM w WHERE regexp_matches(name, '^[A-Za-z][A-Za-z0-9_.-]*$') AND (regexp_matches(name, '^[A-Z]') OR regexp_matches(name, '[a-z][A-Z]|[_.-][A-Za-z0-9]|[A-Za-z][0-9]')) AND length(name) >= 3 AND regexp_matches(lower(name), '[a-z]') AND NOT list_contains({STOP_SQL}, lower(name))""",
)
def kg_extracted(t: Tables):
    mentions = G.extracted_mentions(t.memories)
    return G.observed(mentions, t.memories, "memory")


_NAMED_SQL = "names AS (SELECT DISTINCT word AS name FROM (SELECT unnest(string_split(title, ' ')) AS word FROM memories) WHERE length(word) >= 9)"


@query("R16 J2 names that texts contain, mid-word too", f"WITH {_NAMED_SQL} SELECT m.id, n.name FROM memories m JOIN names n ON contains(m.content, n.name)")
def kg_contained_names(t: Tables):
    names = t.memories.select(F.explode(F.split("title", " ")).alias("name")).where("length(name) >= 9")
    return G.contained_names(t.memories.select("id", "content"), names)


def _mention_sql(table: str, body: str) -> str:
    return rf"""m AS (SELECT DISTINCT doc, name FROM (SELECT id AS doc, unnest(regexp_extract_all({body}, '[\p{{L}}\p{{N}}]+(?:[_.-][\p{{L}}\p{{N}}]+)*')) AS name FROM {table})
  WHERE regexp_matches(name, '^[A-Za-z][A-Za-z0-9_.-]*$') AND (regexp_matches(name, '^[A-Z]') OR regexp_matches(name, '[a-z][A-Z]|[_.-][A-Za-z0-9]|[A-Za-z][0-9]')) AND length(name) >= 3 AND regexp_matches(lower(name), '[a-z]') AND NOT list_contains({STOP_SQL}, lower(name)))"""


@query(
    "G5 J22 semantic edges of tasks: entities, relations, observations",
    rf"""WITH {_mention_sql("tasks", "title || ' ' || phase || ' ' || description")},
link AS (SELECT c.id AS doc, c.repo, c.title, p.id AS target, p.title AS other FROM tasks c JOIN tasks p ON p.id = c.parent_id WHERE p.status <> 'canceled'),
edges AS (SELECT l.repo, x.name AS a, y.name AS b, 'depends_on' AS kind, 'depends_on relation: ' || title || ' → ' || other AS note FROM link l JOIN m x ON x.doc = l.doc JOIN m y ON y.doc = l.target
  UNION ALL SELECT t.repo, x.name, 'Decision ' || t.phase, 'inspired_by', 'inspired_by relation: ' || title || ' → Decision ' || t.phase FROM tasks t JOIN m x ON x.doc = t.id WHERE t.id % 3 = 0)
SELECT DISTINCT 'relation' AS part, repo, a, b, kind FROM edges UNION ALL SELECT DISTINCT 'observation', repo, a, note, '' FROM edges
UNION ALL SELECT DISTINCT 'entity', repo, name, '', '' FROM (SELECT repo, a AS name FROM edges UNION SELECT repo, b FROM edges)""",
)
def kg_semantic_edges(t: Tables):
    mentions = G.extracted_mentions(t.tasks.select("id", F.concat_ws(" ", "title", "phase", "description").alias("content")))
    alive = t.tasks.where("status != 'canceled'").select(F.col("id").alias("target"))
    links = t.tasks.select(F.col("id").alias("doc"), F.col("parent_id").alias("target"), F.lit("depends_on").alias("relation_type")).join(alive, "target")
    decisions = t.tasks.where("id % 3 = 0").select(F.col("id").alias("doc"), F.concat(F.lit("Decision "), "phase").alias("name"), F.lit("decision").alias("type"), F.lit("inspired_by").alias("relation_type"))
    entities, relations, noted = G.semantic_edges(t.tasks.select(F.col("id").alias("doc"), "repo", "title"), mentions, links, decisions)
    none = F.lit("")
    parts = relations.select(F.lit("relation").alias("part"), "repo", F.col("from_entity").alias("a"), F.col("to_entity").alias("b"), F.col("relation_type").alias("kind"))
    parts = parts.unionByName(noted.select(F.lit("observation").alias("part"), "repo", F.col("entity_name").alias("a"), F.col("observation").alias("b"), none.alias("kind")))
    return parts.unionByName(entities.select(F.lit("entity").alias("part"), "repo", F.col("name").alias("a"), none.alias("b"), none.alias("kind")))

"""The knowledge graph: degrees, ranking, subgraphs, orphans, co-mentions, and the union of graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import staged


def degrees(relations: DataFrame) -> DataFrame:
    """``repo, node, degree``: endpoints counted, a loop twice. Partial sums before the shuffle."""
    ends = relations.select("repo", F.explode(F.array("from_entity", "to_entity")).alias("node"))
    return ends.groupBy("repo", "node").agg(F.count("*").alias("degree"))


def ranked_nodes(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities with their degree (0 of none); order by degree descending, then name."""
    met = entities.join(degrees(relations).withColumnRenamed("node", "name"), ["repo", "name"], "left")
    return met.withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def ranked_edges(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges whose ends both exist in the edge's repository, with the sum of their degrees."""
    names = entities.select("repo", "name")
    d = degrees(relations)
    met = relations.join(names.withColumnRenamed("name", "from_entity"), ["repo", "from_entity"], "left_semi").join(names.withColumnRenamed("name", "to_entity"), ["repo", "to_entity"], "left_semi")
    for end in ("from", "to"):
        met = met.join(d.select("repo", F.col("node").alias(f"{end}_entity"), F.col("degree").alias(f"_{end}")), ["repo", f"{end}_entity"], "left")
    return met.withColumn("degree_sum", F.coalesce("_from", F.lit(0)) + F.coalesce("_to", F.lit(0))).drop("_from", "_to")


def subgraph(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (``repo, name``) of their repository."""
    ends = nodes.select("repo", "name").distinct()
    for end in ("from_entity", "to_entity"):
        relations = relations.join(ends.withColumnRenamed("name", end), ["repo", end], "left_semi")
    return relations


def neighbours(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with either end among the names (``repo, name``) of their repository: two semi joins and a union, no disjunctive join."""
    ends = names.select("repo", "name").distinct()
    one = relations.join(ends.withColumnRenamed("name", "from_entity"), ["repo", "from_entity"], "left_semi")
    two = relations.join(ends.withColumnRenamed("name", "to_entity"), ["repo", "to_entity"], "left_semi")
    return one.unionByName(two).distinct()


def capped(df: DataFrame, order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows, with ``truncated``: whether there was one more. The windows are over ``cap`` + 1 rows."""
    whole = Window.partitionBy()
    probe = df.orderBy(*order).limit(cap + 1).withColumn("truncated", F.count("*").over(whole) > cap)
    return probe.withColumn("_n", F.row_number().over(whole.orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def orphans(entities: DataFrame, relations: DataFrame, observations: DataFrame) -> DataFrame:
    """Entities without an observation or a relation in their repository."""
    used = observations.select("repo", F.col("entity_name").alias("name")).union(relations.select("repo", "from_entity")).union(relations.select("repo", "to_entity"))
    return entities.join(used.where("name IS NOT NULL").distinct(), ["repo", "name"], "left_anti")


def degree_changes(added: DataFrame, removed: DataFrame) -> DataFrame:
    """``repo, node, degree``: signed changes of degrees by relations that came and went. Changes add up, in any order."""
    one = lambda df, sign: degrees(df).withColumn("degree", F.col("degree") * sign)
    return one(added, 1).unionByName(one(removed, -1)).groupBy("repo", "node").agg(F.sum("degree").alias("degree")).where("degree != 0")


def summed_degrees(changes: DataFrame) -> DataFrame:
    """The degrees that a table's changes add up to; nodes without a relation are none."""
    return changes.groupBy("repo", "node").agg(F.sum("degree").alias("degree")).where("degree > 0")


def co_mentions(mentions: DataFrame, confidence: float = 0.55) -> DataFrame:
    """``a, b, n``: pairs of names of one document, the earlier one first, with how many documents have it.

    A document's own names pair up, in a join on the document: no list of pairs is built in one row.
    """
    first = mentions.groupBy("doc", "name").agg(F.min("pos").alias("pos"))
    side = lambda x: first.select("doc", F.struct("pos", "name").alias(x))
    pairs = side("x").join(side("y"), "doc").where("x < y")
    return pairs.groupBy(F.col("x.name").alias("a"), F.col("y.name").alias("b")).agg(F.count("*").alias("n")).withColumn("confidence", F.lit(confidence))


def parent_pairs(tasks: DataFrame, names: DataFrame) -> DataFrame:
    """``task, source, target``: names of a task with those of its parent, once each; ``names``: id, name."""
    own = names.select(F.col("id").alias("task"), F.col("name").alias("source")).distinct()
    above = names.select(F.col("id").alias("parent_id"), F.col("name").alias("target")).distinct()
    met = tasks.where("parent_id IS NOT NULL").select(F.col("id").alias("task"), "parent_id").join(own, "task").join(above, "parent_id")
    return met.where("source != target").select("task", "source", "target")


def entity_detail(relations: DataFrame, observations: DataFrame, repo: str, name: str) -> DataFrame:
    """``part, kind, value``: the relations of a repository's entity both ways, and its observations."""
    one = lambda df, part, mine, kind, value: df.where((F.col("repo") == repo) & (F.col(mine) == name)).select(F.lit(part).alias("part"), F.col(kind).cast("string").alias("kind"), F.col(value).alias("value"))
    both = one(relations, "out", "from_entity", "relation_type", "to_entity").unionByName(one(relations, "in", "to_entity", "relation_type", "from_entity"))
    return both.unionByName(one(observations, "observation", "entity_name", "id", "observation"))


def context(relations: DataFrame, observations: DataFrame, repo: str, noted: DataFrame, most: int = 50) -> DataFrame:
    """Relations of a repository's entities that carry one of some observations (``noted``), the first ``most`` entities by name."""
    own = observations.where(F.col("repo") == repo)
    named = own.join(noted, "observation", "left_semi").select("repo", F.col("entity_name").alias("name")).distinct()
    return neighbours(relations, named.orderBy("name").limit(most))


def matching_entities(entities: DataFrame, repo: str, query: str, most: int = 50) -> DataFrame:
    """A repository's entities that share a token with the query, those with more of them first; ``most`` rows."""
    import re

    wanted = list(dict.fromkeys(re.findall(r"[a-z0-9]+", query.lower())))[:40]
    tokens = F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9]+"), F.lit(0))
    hits = F.size(F.array_intersect(tokens, F.array(*map(F.lit, wanted)).cast("array<string>")))
    return entities.where(F.col("repo") == repo).withColumn("hits", hits).where("hits > 0").orderBy(F.col("hits").desc(), "name").limit(most)


NAMES_BYTES = 16 << 20  # of names (64 more each) that a task's automaton holds at once: about 80 MB of its nodes
TEXTS = 512  # that a task holds as Python strings at once


def contained_names(texts: DataFrame, names: DataFrame, limit: int = NAMES_BYTES) -> DataFrame:
    """``id, name``: the names (``name``) that stand anywhere in a text (``id, content``), case and all; empty and null names in none.

    Dictionary matching: an automaton over all names reads each text once, however many names there are.
    A table of names of more than ``limit`` bytes is cut by hash into as many as keep within it, and the
    texts are read once for each.
    """
    known = names.where("name IS NOT NULL AND name != ''").select("name").distinct()
    size = known.agg(F.sum(F.octet_length("name") + 64)).first()[0] or 0
    shares, kind = max(1, -(-size // limit)), texts.schema["id"].dataType
    out = None
    for i in range(shares):
        some = known.where(F.pmod(F.xxhash64("name"), F.lit(shares)) == i).toArrow().column(0).combine_chunks()  # about ``limit`` bytes
        found = _contained(texts, some, kind)
        out = found if out is None else out.unionByName(found)
    return out


def _contained(texts: DataFrame, names: pa.Array, kind) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)  # a name is cut from the text that holds it
        for name in shared.value:
            automaton.add_word(name.as_py())
        automaton.make_automaton()
        some = len(shared.value) > 0
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part, ids, found = batch.slice(start, TEXTS), [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for name in {text[end + 1 - n : end + 1] for end, n in automaton.iter(text)} if text and some else ():
                        ids.append(key)
                        found.append(name)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[0]), pa.array(found, pa.string())], ["id", "name"])

    return texts.select("id", "content").mapInArrow(run, f"id {kind.simpleString()}, name string")


#: Confidence of relations that a record states.
SEMANTIC = 0.8


def semantic_edges(docs: DataFrame, mentions: DataFrame, links: DataFrame, named: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and observations that records state, from one extraction.

    ``docs`` (doc, repo, title); ``mentions`` (doc, name, type) of them; ``links`` (doc, target, relation_type)
    between them: every name of a record is related to every name of its target. ``named`` (doc, name,
    type, relation_type): links to an entity that the record names itself, such as a decision. Both
    ends of each relation are among the entities (a name's first type counts), and each name notes the
    link once. ``mark`` between both titles is an arrow, of ``related_to`` a tilde.
    """
    own = mentions.select("doc", F.col("name").alias("from_entity"), F.col("type").alias("from_type")).distinct()
    other = mentions.select(F.col("doc").alias("target"), F.col("name").alias("to_entity"), F.col("type").alias("to_type")).distinct()
    titles = docs.select(F.col("doc").alias("target"), F.col("title").alias("to_title"))
    edges = links.join(own, "doc").join(other, "target").join(titles, "target").select("doc", "relation_type", "from_entity", "from_type", "to_entity", "to_type", "to_title")
    if named is not None:
        one = named.select("doc", "relation_type", F.trim("name").alias("to_entity"), F.col("type").alias("to_type"), F.trim("name").alias("to_title")).where("to_entity != ''")
        edges = edges.unionByName(one.join(own, "doc").select(*edges.columns))
    edges = staged(edges.join(docs.select("doc", "repo", "title"), "doc"), "edges")
    ends = edges.select("repo", F.col("from_entity").alias("name"), F.col("from_type").alias("type"), F.lit(0).alias("n")).unionByName(edges.select("repo", F.col("to_entity").alias("name"), F.col("to_type").alias("type"), F.lit(1).alias("n")))
    entities = ends.groupBy("repo", "name").agg(F.min(F.struct("n", "type"))["type"].alias("type"))
    relations = edges.select("repo", "from_entity", "to_entity", "relation_type", F.lit(SEMANTIC).alias("confidence")).distinct()
    mark = F.when(F.col("relation_type") == "related_to", " \u223c ").otherwise(" \u2192 ")
    noted = edges.select("repo", F.col("from_entity").alias("entity_name"), F.concat("relation_type", F.lit(" relation: "), "title", mark, "to_title").alias("observation")).distinct()
    return entities, relations, noted


def united(parts: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """Nodes of several domains in one table: ``id`` (domain and key), ``domain``, ``label``, ``size``."""
    out = None
    for domain, (df, key, size) in parts.items():
        one = df.select(F.concat(F.lit(f"{domain}:"), F.col(key).cast("string")).alias("id"), F.lit(domain).alias("domain"), F.col(key).cast("string").alias("label"), size.cast("double").alias("size"))
        out = one if out is None else out.unionByName(one)
    return out


def extracted_mentions(docs: DataFrame, body: str = "content") -> DataFrame:
    """``doc, name, type, pos``: all capitalised words and code-like identifiers of a text, once each.

    A deterministic rule instead of a language model: names of the knowledge graph are what can be
    found again, not what can be guessed.
    """
    from ..functions import text

    words = F.regexp_extract_all(F.col(body), F.lit(r"[\p{L}\p{N}]+(?:[_.-][\p{L}\p{N}]+)*"), F.lit(0))
    words = F.filter(words, lambda w: w.rlike("^[A-Za-z][A-Za-z0-9_.-]*$"))
    coded = lambda w: w.rlike(r"[a-z][A-Z]|[_.-][A-Za-z0-9]|[A-Za-z][0-9]")
    named = F.array_distinct(F.filter(words, lambda w: w.rlike("^[A-Z]") | coded(w)))
    good = F.filter(named, lambda w: text.valid_entity_name(w))
    each = docs.select(F.col("id").alias("doc"), F.posexplode(good).alias("pos", "name"))
    return each.select("doc", "name", F.when(coded(F.col("name")), "identifier").otherwise("concept").alias("type"), "pos")


def observed(mentions: DataFrame, titles: DataFrame, domain: str) -> DataFrame:
    """An observation a mention: ``entity_name, observation``."""
    named = titles.select(F.col("id").alias("doc"), F.concat(F.lit(f"Mentioned in {domain}: "), "title").alias("observation"))
    return mentions.join(named, "doc").select(F.col("name").alias("entity_name"), "observation").distinct()


def code_relations(symbols: DataFrame, refs: DataFrame, most_symbols: int = 50, most_refs: int = 4000, confidence: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of code: the first symbols of each file, and its references by caller (else the file)."""
    order = Window.partitionBy("repo", "file_path").orderBy("start_line", "id")
    entities = symbols.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most_symbols).groupBy("repo", "name").agg(F.min_by("kind", "id").alias("type"))
    place = Window.partitionBy("repo", "caller_file").orderBy("caller_line", "id")
    first = refs.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most_refs)
    relations = first.select("repo", F.coalesce("caller_name", "caller_file").alias("from_entity"), F.col("symbol_name").alias("to_entity"), F.col("kind").alias("relation_type"), F.lit(confidence).alias("confidence")).distinct()
    return entities, relations

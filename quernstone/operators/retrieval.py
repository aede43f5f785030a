"""Ranked retrieval: full-text and term-vector scores, the hybrid engine, conflicts.

A full-text score reads stored postings of its few terms. Without an index, each row counts its own
hits; only the corpus statistics (one row) are aggregated and broadcast either way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring, text
from ..functions.querytext import Match, expanded, full_text, tagged, time_window
from ..sources.stored import staged


def scoped(df: DataFrame, repo: str, owner: str | None = None, rule: str = "strict", tags: list[str] | None = None) -> DataFrame:
    """Rows of a repository: strict, or with global ones, or with those that carry one of the tags too."""
    own = F.col("repo") == repo
    if owner:
        own = own & (F.col("owner") == owner)
    if rule != "strict":
        own = own | F.col("is_global")
    if rule == "tags" and tags:
        own = own | has_tag(tags)
    return df.where(own)


def has_tag(tags: list[str]) -> Column:
    """One of the row's tags is one of these, without regard to case."""
    wanted = text.strings([t.lower() for t in tags])
    return F.exists("tags", lambda t: F.array_contains(wanted, F.lower(t)))


def live(as_of: Column, archived: bool = False) -> Column:
    """Not expired, and active unless archived rows are asked for."""
    fresh = F.col("expires_at").isNull() | (F.col("expires_at") > as_of)
    return fresh if archived else fresh & (F.col("status") == "active")


def substring(query: str, *columns: str) -> Column:
    """Any of the columns holds the query, without regard to case; % and _ are wildcards."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return found


def phrase_hits(body: Column, phrase: tuple[str, ...]) -> Column:
    """How often the tokens of a phrase stand one after another in a folded text."""
    between = "[^a-z0-9]+"
    return F.regexp_count(body, F.lit(f"(?<![a-z0-9])(?={between.join(phrase)}(?![a-z0-9]))"))


def term_hits(body: Column, match: Match) -> list[Column]:
    """Hits of each phrase and prefix in a folded text: matches that start a token; no token list is built."""
    prefixes = [F.regexp_count(body, F.lit(f"(?<![a-z0-9]){p}")) for p in match.prefixes]
    return [phrase_hits(body, p) for p in match.phrases] + prefixes


def folded_words(words: tuple[str, ...]) -> tuple[str, ...]:
    """Query words as the index cuts and folds them; what no token can hold goes."""
    import re

    folded = " ".join(words).lower().translate(str.maketrans(text.FOLD_FROM, text.FOLD_TO))
    return tuple(re.findall("[a-z0-9]+", folded))


def recap_top(memories: DataFrame, repo: str, as_of: Column, most: int) -> DataFrame:
    """The most important live memories of a repository, archived tasks aside."""
    own = scoped(memories.where(live(as_of) & (F.col("type") != "task_archive")), repo)
    return own.orderBy(F.col("importance").desc(), F.col("created_at").desc(), "id").limit(most)


@dataclass(frozen=True)
class Index:
    """``postings`` (term, id, tf), whose filters of terms skip most of what is stored, and ``lengths`` (id, length) of a text."""

    postings: DataFrame
    lengths: DataFrame


def inverted(df: DataFrame, word: str, within: str | None = None) -> DataFrame:
    """``word, ids, tfs`` (and ``within``) of ``id, words``: a row a word and batch of rows, with the ids that have it and how often.

    No row leaves its task: a text is in one batch, so its words are counted there. The words of a batch
    come in order, so that a reader of few words skips most pages of a stored file.
    """
    key = df.schema["id"].dataType.simpleString()
    asked = df.select("id", "words", *([within] if within else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words = max(batch.num_rows, 1), batch.column(1)
            flat = pc.list_flatten(words).dictionary_encode()
            order = pc.sort_indices(flat.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place = np.argsort(batch.column(2).to_numpy(zero_copy_only=False), kind="stable") if within else np.arange(batch.num_rows)
            at = np.empty(batch.num_rows, np.int64)
            at[place] = np.arange(batch.num_rows)
            each = rank[flat.indices.to_numpy()] * rows + at[pc.list_parent_indices(words).to_numpy()]
            each.sort()
            first = np.flatnonzero(np.diff(each, prepend=-1))  # of each word and row
            code, row = np.divmod(each[first], rows)
            tfs = np.diff(np.append(first, len(each))).astype(np.int32)
            row = place[row]
            new = np.diff(code, prepend=-1) != 0
            if within:
                group = batch.column(2).to_numpy(zero_copy_only=False)[row]
                new |= np.diff(group, prepend=group[:1]) != 0
            starts = np.flatnonzero(new)
            ends = pa.array(np.append(starts, len(row)), pa.int32())
            names = flat.dictionary.take(pa.array(order[code[starts]]))
            ids, counts = (pa.ListArray.from_arrays(ends, values) for values in (batch.column(0).take(pa.array(row)), pa.array(tfs)))
            yield pa.RecordBatch.from_arrays([names, ids, counts, *([batch.column(2).take(pa.array(row[starts]))] if within else [])], [word, "ids", "tfs", *([within] if within else [])])

    more = f", `{within}` {df.schema[within].dataType.simpleString()}" if within else ""
    return asked.mapInArrow(run, f"`{word}` string, ids array<{key}>, tfs array<int>{more}")


def packed_postings(df: DataFrame) -> DataFrame:
    """Postings of ``body`` as they are stored: ``term, ids, tfs``, in order of term within each batch of texts."""
    return inverted(df.select("id", text.fts_tokens(F.col("body")).alias("words")), "term")


def repacked(rows: DataFrame) -> DataFrame:
    """Postings (``term, id, tf``) of any origin as they are stored."""
    key = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = pc.run_end_encode(batch.column(0))
            ends = pa.array(np.append(0, runs.run_ends.to_numpy()), pa.int32())
            yield pa.RecordBatch.from_arrays([runs.values, *(pa.ListArray.from_arrays(ends, batch.column(i)) for i in (1, 2))], ["term", "ids", "tfs"])

    placed = rows.select("term", "id", F.col("tf").cast("int").alias("tf")).repartition("term").sortWithinPartitions("term", "id")
    return placed.mapInArrow(run, f"term string, ids array<{key}>, tfs array<int>")


def unpacked(stored: DataFrame) -> DataFrame:
    """``term, id, tf`` of stored postings; filters of terms reach the files."""
    pairs = stored.select("term", F.inline(F.arrays_zip("ids", "tfs")).alias("id", "tf"))
    return pairs.withColumn("tf", F.col("tf").cast("long"))


def postings(df: DataFrame) -> DataFrame:
    """``term, id, tf`` of the terms of ``body``."""
    return unpacked(packed_postings(df))


def lengths(df: DataFrame) -> DataFrame:
    return df.select("id", F.regexp_count(text.folded(F.col("body")), F.lit("[a-z0-9]+")).alias("length"))


def _scored(hits: list[Column], found: list[Column], rows: Column, length: Column, average: Column) -> Column:
    """The score (less is better) of hits of each term, ``found``: the rows that each is in."""
    score = F.lit(0.0)
    for f, n in zip(hits, found, strict=True):
        idf = F.log((rows - n + 0.5) / (n + 0.5))
        norm = scoring.BM25_K1 * (1 - scoring.BM25_B + scoring.BM25_B * length / average)
        score = score + F.when(idf <= 0, scoring.BM25_FLOOR).otherwise(idf) * f * (scoring.BM25_K1 + 1) / (f + norm)
    return -score


def indexed_bm25(index: Index, prefixes: tuple[str, ...]) -> DataFrame:
    """``id, bm25`` of the rows that hold a term with every prefix."""
    starts = [F.col("term").startswith(p) for p in prefixes]
    some = starts[0]
    for s in starts[1:]:
        some = some | s
    sums = [F.sum(F.when(s, F.col("tf")).otherwise(0)).alias(f"f{i}") for i, s in enumerate(starts)]
    hits = index.postings.where(some).groupBy("id").agg(*sums)
    names = [F.col(f"f{i}") for i in range(len(prefixes))]
    stats = index.lengths.agg(F.count("*").alias("rows"), F.avg("length").alias("average"))
    found = hits.agg(*(F.count_if(f > 0).alias(f"n{i}") for i, f in enumerate(names)))
    every = names[0] > 0
    for f in names[1:]:
        every = every & (f > 0)
    met = hits.where(every).join(index.lengths, "id").join(F.broadcast(stats)).join(F.broadcast(found))  # one row each
    return met.select("id", _scored(names, [F.col(f"n{i}") for i in range(len(names))], F.col("rows"), F.col("length"), F.col("average")).alias("bm25"))


def bm25(df: DataFrame, query: str, columns: list[str], scope: Column | None = None, index: Index | None = None) -> DataFrame:
    """Rows of ``df`` that have every term, with ``bm25`` (less is better).

    Statistics cover all of ``df``; ``scope`` restricts the rows returned afterwards. With an ``index``
    of the columns, queries without phrases read the postings of their terms instead of the texts.
    """
    match = full_text(query)
    if index is not None and not match.phrases:
        words = folded_words(match.prefixes)
        if not words:
            return df.where("false").withColumn("bm25", F.lit(0.0))
        return (df if scope is None else df.where(scope)).join(indexed_bm25(index, words), "id")
    body = F.concat_ws(" ", *columns)
    match = Match(tuple(w for p in match.phrases if (w := folded_words(p))), folded_words(match.prefixes))
    counted = df.withColumn("_body", text.folded(body))
    hits = term_hits(F.col("_body"), match)
    if not hits:
        return df.where("false").withColumn("bm25", F.lit(0.0))
    counted = counted.select(*df.columns, F.regexp_count("_body", F.lit("[a-z0-9]+")).alias("_length"), F.array(*hits).alias("_hits"))
    n = len(hits)
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_length").alias("_average"), *[F.sum((F.col("_hits")[i] > 0).cast("int")).alias(f"_df{i}") for i in range(n)])
    met = counted.join(F.broadcast(stats))  # one row
    score = _scored([F.col("_hits")[i] for i in range(n)], [F.col(f"_df{i}") for i in range(n)], F.col("_n"), F.col("_length"), F.col("_average"))
    every = F.forall("_hits", lambda h: h > 0)
    kept = met.where(every if scope is None else every & scope)
    return kept.select(*df.columns, score.alias("bm25"))


def with_min_max(df: DataFrame, score: str, out: str, best_low: bool = True, bounded: bool = False) -> DataFrame:
    """``df`` with the score scaled to 0..1 over all its rows, the best 1; all 1 if they are equal.

    The bounds are one aggregated row; of a ``bounded`` list, whose plan then runs once, a window gives them.
    """
    scaled = (F.col("_high") - F.col(score)) if best_low else (F.col(score) - F.col("_low"))
    value = F.when(F.col("_high") == F.col("_low"), 1.0).otherwise(scaled / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)))
    whole = Window.partitionBy()
    bounds = None if bounded else df.agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    met = df.withColumn("_low", F.min(score).over(whole)).withColumn("_high", F.max(score).over(whole)) if bounded else df.join(F.broadcast(bounds))
    return met.withColumn(out, value).drop("_low", "_high")


def tf_cosine(column: str, query: str, stopwords=text.STOPWORDS) -> Column:
    """Cosine of raw term counts between a column and a query; 0 if either has no term."""
    terms = Counter(t for t in _query_tokens(query, stopwords))
    if not terms:
        return F.lit(0.0)
    tokens = text.tokens(F.coalesce(F.col(column), F.lit("")), stopwords)
    dot = F.lit(0.0)
    for term, count in sorted(terms.items()):
        dot = dot + (F.size(tokens) - F.size(F.array_remove(tokens, term))).cast("double") * count
    sorted_ = F.array_sort(tokens)
    # squared norm: a run of equal tokens of length n adds n * n, that is 2 * place - 1 each
    run = F.aggregate(
        sorted_,
        F.struct(F.lit("").alias("last"), F.lit(0).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("sum")),
        lambda s, t: F.struct(t.alias("last"), F.when(s["last"] == t, s["place"] + 1).otherwise(F.lit(1).cast("bigint")).alias("place"), (s["sum"] + F.when(s["last"] == t, 2 * s["place"] + 1).otherwise(F.lit(1).cast("bigint"))).alias("sum")),
        lambda s: s["sum"],
    )
    norm = sqrt(sum(c * c for c in terms.values()))
    return F.when(F.size(tokens) == 0, 0.0).otherwise(dot / F.nullif(F.sqrt(run.cast("double")) * norm, F.lit(0.0)))


def _query_tokens(query: str, stopwords) -> list[str]:
    import re

    words = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s_\-.]", " ", query.lower())).strip().split(" ")
    return [w for w in words if w and w not in set(stopwords)]


def candidates(memories: DataFrame, repo: str, query: str, as_of: Column, limit: int, tags: list[str] | None = None, floor: int = 10) -> DataFrame:
    """The best rows by scope, importance and age, with ``similarity`` of their content to the query."""
    pool = scoped(memories.where(live(as_of)), repo, rule="tags", tags=tags)
    own = (F.col("repo") == repo).cast("int")
    pool = pool.orderBy(own.desc(), F.col("importance").desc(), F.col("created_at").desc(), "id").limit(max(limit, floor))
    cosine = tf_cosine("content", query)
    base = F.when(cosine == 0, scoring.NO_OVERLAP).otherwise(cosine)
    return pool.withColumn("similarity", base + F.when(F.col("repo") == repo, scoring.SAME_REPO).otherwise(0.0))


def hybrid(pool: DataFrame, kind: str, offset: int = 0, limit: int = 10, post: Column | None = None, small: float | None = None, large: float | None = None, bounded: bool = False) -> DataFrame:
    """Blend, adaptive threshold over the whole pool, at least the best row, later filters, page.

    Takes ``id, similarity, keyword, recency, domain``; adds ``score``, ``eligible`` (pool size) and ``rank``.
    Scores equal to nine places are ordered by id. The pool's plan runs once: of a ``bounded`` list of
    candidates its size and best row come from windows, a pool of any size is stored first.
    """
    scored = pool.withColumn("score", scoring.blend(*(F.col(c) for c in ("similarity", "keyword", "recency", "domain"))))
    order = F.struct((-F.round("score", 9)).alias("s"), "id")
    if bounded:
        whole = Window.partitionBy()
        sized = scored.withColumn("eligible", F.count("*").over(whole)).withColumn("_best", F.min(order).over(whole)["id"])
    else:
        scored = staged(scored, "pool")
        sized = scored.join(F.broadcast(scored.agg(F.count("*").alias("eligible"), F.min(order)["id"].alias("_best"))))  # one row
    least = scoring.threshold(F.col("eligible"), kind) if small is None else F.when(F.col("eligible") <= scoring.SMALL_POOL, small).otherwise(large)
    kept = sized.where((F.col("score") >= least) | (F.col("id") == F.col("_best"))).drop("_best")
    if post is not None:
        kept = kept.where(post)
    place = [F.round("score", 9).desc(), F.col("id")]
    top = kept.orderBy(*place).limit(offset + limit)  # the rank is of this bounded head
    return top.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*place))).where(F.col("rank") > offset)


FTS_CANDIDATES = 100


def memory_search(memories: DataFrame, index: Index, raw: str, repo: str, now: datetime, as_of: Column, offset: int = 0, limit: int = 10) -> DataFrame:
    """The whole search: ``id, score, keyword, similarity, eligible, rank`` of a query with tags and a date phrase.

    Tags leave the query, then the date phrase. Term-vector candidates are sought with synonyms, full-text
    hits without; what either finds is a candidate. Workspace and tag affinity raise the similarity, the
    blend is cut by the adaptive threshold, and the date window is looked at afterwards.
    """
    asked = tagged(raw, "memory")
    scope, tags, path = asked.filters.get("scope", {}), asked.filters.get("current_tags", []), asked.filters.get("current_file_path")
    window = time_window(asked.query, now)
    plain = window.query if window else asked.query
    wide = expanded(plain)
    pool = candidates(memories, repo, wide, as_of, 3 * (offset + limit), tags).select("id", "similarity")
    reach = ((F.col("repo") == repo) | F.col("is_global")) & live(as_of)
    best = bm25(memories, plain, [], reach, index).select("id", "bm25", "importance", "created_at")
    best = best.orderBy(F.round("bm25", 9), F.col("importance").desc(), F.col("created_at").desc(), "id").limit(FTS_CANDIDATES)
    keyed = with_min_max(best, "bm25", "keyword", bounded=True).select("id", "keyword")
    both = pool.join(keyed, "id", "full").select("id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("keyword", F.lit(0.0)).alias("keyword"))
    rows = memories.join(F.broadcast(both), "id")  # two bounded lists
    wanted = {"branch": scope.get("branch"), "path": path, "folder": scope.get("folder"), "language": scope.get("language"), "tags": tags}
    near = scoring.affinity(F.col("similarity"), {c: F.col(c) for c in ("branch", "folder", "language", "tags")}, wanted)
    domain = scoring.domain_adjusted(scoring.overlap(F.col("tags"), text.strings(wide.split())), F.col("recall_count") > 0, F.col("type"))
    found = rows.select("id", "created_at", near.alias("similarity"), "keyword", scoring.recency(F.col("created_at"), as_of).alias("recency"), domain.alias("domain"))
    post = None
    if window:
        at = F.col("created_at")
        post = at >= F.lit(window.since).cast("timestamp_ntz")
        post = post if window.until is None else post & (at < F.lit(window.until).cast("timestamp_ntz"))
    return hybrid(found, "memory", offset, limit, post, bounded=True).select("id", "score", "keyword", "similarity", "eligible", "rank")


def task_search(tasks: DataFrame, vectors: DataFrame, query: str, target: list[float], as_of: Column, offset: int = 0, limit: int = 10, post: Column | None = None) -> DataFrame:
    """The whole search of tasks: ``id, score, eligible, rank``.

    Tasks that hold the query, and the nearest vectors' tasks, which they supplement. Where fewer pass
    the threshold than the page wants, the best of those that hold the query top it up. ``post`` filters
    (phase, priority, issue) come last.
    """
    wanted = offset + limit
    near = nearest(vectors.join(tasks.select("id"), "id", "left_semi"), target, 3 * wanted).select(F.col("id").alias("_near"), F.col("similarity").alias("_similarity"))
    holds = substring(query, "title", "description", "task_code")
    met = tasks.join(F.broadcast(near), F.col("id") == F.col("_near"), "left").where(holds | F.col("_near").isNotNull())  # a bounded list
    words = text.word_tokens(F.concat_ws(" ", "title", "description", "task_code", "phase"), 1)
    domain = scoring.coverage(words, text.strings(query.lower().split()))
    pool = met.withColumn("keyword", F.when(holds, 1.0).otherwise(0.0)).withColumn("similarity", F.coalesce("_similarity", F.lit(0.0)))
    pool = pool.withColumn("score", scoring.blend(F.col("similarity"), F.col("keyword"), scoring.recency(F.col("created_at"), as_of, "task"), domain)).drop("_near", "_similarity")
    pool = staged(pool, "pool")  # used four times
    whole = pool.agg(F.count("*").alias("eligible"), F.min(F.struct((-F.round("score", 9)).alias("s"), "id"))["id"].alias("_best"))  # one row
    marked = pool.join(F.broadcast(whole)).withColumn("_in", (F.col("score") >= scoring.threshold(F.col("eligible"), "task")) | (F.col("id") == F.col("_best")))
    place = [F.round("score", 9).desc(), F.col("id")]
    kept = marked.where("_in").orderBy(*place)
    size = marked.agg(F.count_if("_in").alias("_passed"))
    spare = marked.where(~F.col("_in") & (F.col("keyword") > 0)).orderBy(*place).limit(wanted)
    spare = spare.withColumn("_n", F.row_number().over(Window.partitionBy().orderBy(*place))).join(F.broadcast(size)).where(F.col("_n") <= wanted - F.col("_passed")).drop("_n", "_passed")
    found = kept.unionByName(spare)
    top = (found if post is None else found.where(post)).orderBy(*place).limit(wanted)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*place))).where(F.col("rank") > offset).select("id", "score", "eligible", "rank")


def merged_with_vectors(pool: DataFrame, vectors: DataFrame, mode: str = "supplement") -> DataFrame:
    """``pool`` and vector rows: all that it lacks (supplement), or any only if it is empty (fallback)."""
    if mode == "supplement":
        return pool.unionByName(vectors.join(pool.select("id"), "id", "left_anti"), allowMissingColumns=True)
    size = pool.agg(F.count("*").alias("_size"))
    return pool.unionByName(vectors.join(F.broadcast(size)).where("_size = 0").drop("_size"), allowMissingColumns=True)


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first``, or ``second`` if it has no row; decided in the plan."""
    size = first.agg(F.count("*").alias("_size"))
    return first.unionByName(second.join(F.broadcast(size)).where("_size = 0").drop("_size"))


def nearest(vectors: DataFrame, target: list[float], k: int, column: str = "vector") -> DataFrame:
    """The k rows with the largest cosine to a vector, ties by id."""
    similarity = scoring.dense_cosine(F.col(column), F.array(*map(F.lit, target)).cast("array<double>"))
    return vectors.withColumn("similarity", similarity).orderBy(F.col("similarity").desc(), "id").limit(k)


def summary_by_group(rows: DataFrame, group: str, order: list[tuple[str, bool]], caps: dict[str, int], cap: int = 5) -> DataFrame:
    """At most so many rows a group, with their ``rank`` among all rows and ``more``: how many of the group were left out.

    ``order``: numeric columns, and whether each descends; together they tell all rows apart. Groups
    are few (kinds). No window over everything: each group's head is a bounded window, and a rank is
    the number of rows up to a head, counted between one head and the next.
    """
    limit = F.lit(cap)
    for name, n in caps.items():
        limit = F.when(F.col(group) == name, n).otherwise(limit)
    key = F.struct(*((-F.col(c) if down else F.col(c)).alias(c) for c, down in order))
    keyed = rows.withColumn("_key", key)
    head = keyed.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_key"))).where(F.col("place") <= max([cap, *caps.values()])).where(F.col("place") <= limit)
    cuts = head.agg(F.sort_array(F.collect_list("_key")).alias("_cuts"))  # so many as heads
    slot = F.size(F.filter("_cuts", lambda c: c < F.col("_key")))
    counted = keyed.select("_key").join(F.broadcast(cuts)).groupBy(slot.alias("_slot")).agg(F.count("*").alias("_c"))
    upto = counted.select("_slot", F.sum("_c").over(Window.partitionBy().orderBy("_slot")).cast("int").alias("rank"))  # a row a head
    ranks = cuts.select(F.posexplode("_cuts").alias("_slot", "_key")).join(F.broadcast(upto), "_slot").drop("_slot")
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))  # a row a group
    met = head.join(F.broadcast(ranks), "_key").join(F.broadcast(sizes), group)
    return met.withColumn("more", F.greatest(F.lit(0).cast("long"), F.col("_n") - limit)).drop("_key", "_n")


def in_order(df: DataFrame, keys: list[str], column: str = "code") -> DataFrame:
    """The first row of each key, with ``pos``: the key's first place in the list."""
    wanted = df.sparkSession.createDataFrame([(i, k) for i, k in enumerate(dict.fromkeys(keys))], f"pos int, {column} string")
    met = df.join(F.broadcast(wanted), column)
    first = Window.partitionBy("pos").orderBy("id")
    return met.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


UUID = r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def resolved_ids(identifiers: DataFrame, entities: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """``identifier, id``: a UUID is itself; else the id of a local name, else of a code; null if unknown."""
    met = identifiers.select("identifier").distinct()
    codes = entities.groupBy(F.col("code").alias("identifier")).agg(F.min(F.col("id").cast("string")).alias("_code"))
    met = met.join(codes, "identifier", "left").withColumn("_local", F.lit(None).cast("string"))
    if local is not None:
        names = local.select("identifier", F.col("id").cast("string").alias("_name"))
        met = met.join(names, "identifier", "left").withColumn("_local", F.col("_name")).drop("_name")
    own = F.when(F.col("identifier").rlike(UUID), F.col("identifier"))
    return met.select("identifier", F.coalesce(own, "_local", "_code").alias("id"))

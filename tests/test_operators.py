"""Operators on small rows with known results."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quernstone.operators import analytics, code_index, graph, lifecycle, retrieval, similarity
from quernstone.sources import code_files, tables
from quernstone.streaming import events, queue

NOW = "2024-06-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def rows(df):
    return [tuple(r) for r in df.collect()]


def at(s):
    return datetime.fromisoformat(s)


def test_graph(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("D", "A"), ("B", "D")], "from_entity string, to_entity string").selectExpr("*", "'r' AS repo", "'x' AS relation_type")
    nodes = spark.createDataFrame([(n,) for n in "ABCD"], "name string").selectExpr("*", "'r' AS repo")
    assert {r[1]: r[2] for r in rows(graph.degrees(edges))} == {"A": 3, "B": 3, "C": 2, "D": 2}
    order = [F.col("degree_sum").desc(), "from_entity", "to_entity"]
    top = rows(graph.capped(graph.ranked_edges(nodes, edges), order, 2).select("from_entity", "to_entity", "truncated"))
    assert sorted(top) == [("A", "B", True), ("A", "C", True)]
    pick = lambda *n: nodes.where(F.col("name").isin(*n))
    assert graph.subgraph(edges, pick("A", "B")).count() == 1 and graph.subgraph(edges, pick("Z")).count() == 0
    assert graph.neighbours(edges, pick("D")).count() == 2
    loop = spark.createDataFrame([("r", "A", "A")], "repo string, from_entity string, to_entity string")
    assert rows(graph.degrees(loop)) == [("r", "A", 2)]
    seen = spark.createDataFrame([("r", "E"), ("r", None), ("q", "F")], "repo string, entity_name string")
    more = nodes.unionByName(spark.createDataFrame([("E", "r"), ("F", "r")], "name string, repo string"))
    assert [r["name"] for r in graph.orphans(more, edges, seen).collect()] == ["F"]


def test_repositories_that_share_names_stay_apart(spark):
    """Windows, neighbours, detail, context, orphans and deletions of one repository leave the other's rows alone."""
    from quernstone.operators import records

    both = lambda items, kind: spark.createDataFrame([(r, *i) for r in "ab" for i in items], kind)
    entities = both([("x",), ("y",)], "repo string, name string")
    relations = both([("x", "y", "t")], "repo string, from_entity string, to_entity string, relation_type string")
    observations = both([("x", "seen", 1)], "repo string, entity_name string, observation string, id int")
    own = entities.where("repo = 'a'")
    assert graph.subgraph(relations, own).count() == 1 and graph.neighbours(relations, own).count() == 1
    assert graph.entity_detail(relations, observations, "a", "x").count() == 2
    assert graph.context(relations, observations, "a", observations.select("observation")).count() == 1
    assert graph.orphans(entities, relations.where("repo = 'b'"), observations.where("repo = 'b'")).count() == 2
    left = records.without_entities(own.where("name = 'x'"), entities, relations, observations)
    assert [df.count() for df in left] == [3, 1, 1]


def test_degrees_by_changes(spark):
    kind = "repo string, from_entity string, to_entity string"
    first, more, gone = ([("r", "a", "b"), ("r", "a", "a"), ("q", "a", "b")], [("r", "b", "c")], [("r", "a", "a"), ("q", "a", "b")])
    df = lambda items: spark.createDataFrame(items, kind)
    changes = graph.degree_changes(df(first), df(first).where("false")).unionByName(graph.degree_changes(df(more), df(gone)))
    assert sorted(rows(graph.summed_degrees(changes))) == sorted(rows(graph.degrees(df([x for x in first + more if x not in gone]))))


def test_contained_names(spark):
    texts = spark.createDataFrame([(1, "Café ABC-abc"), (2, None), (3, ""), (None, "xABCy")], "id int, content string")
    names = spark.createDataFrame([("ABC",), ("abc",), ("Caf",), ("é A",), ("",), (None,), ("ABC",)], "name string")
    for limit in (1 << 20, 70):  # in one automaton, and in several
        assert sorted(rows(graph.contained_names(texts, names, limit)), key=str) == sorted([(1, "ABC"), (1, "abc"), (1, "Caf"), (1, "é A"), (None, "ABC")], key=str)
    assert rows(graph.contained_names(texts, names.where("false"))) == []


def test_names_are_shipped_and_searched_in_bounded_pieces(spark):
    import pyarrow as pa

    seen = []
    contained = graph._contained
    graph._contained = lambda texts, some, kind: seen.append(some) or contained(texts, some, kind)
    try:
        texts = spark.createDataFrame([(i, f"a name{i}\U0001f600 b" * 3) for i in range(1500)], "id int, content string").coalesce(1)
        names = spark.createDataFrame([(f"name{i}\U0001f600",) for i in range(1500)], "name string")
        assert sorted(rows(graph.contained_names(texts, names, 50_000))) == [(i, f"name{i}\U0001f600") for i in range(1500)]
    finally:
        graph._contained = contained
    assert len(seen) > 1 and all(isinstance(s, pa.Array) and s.nbytes < 50_000 for s in seen)  # no list of Python strings


def test_bursts(spark):
    log = [(1, "s", "q", 5, at("2024-01-01T10:00")), (2, "s", "q", 5, at("2024-01-01T10:05")), (3, "s", "q", 5, at("2024-01-01T10:09")), (4, "s", None, 5, at("2024-01-01T10:10")), (5, "s", None, 5, at("2024-01-01T10:21"))]
    df = spark.createDataFrame(log, "id long, action string, query string, memory_id long, created_at timestamp_ntz")
    got = sorted((r["id"], r["burst"], r["created_at"].strftime("%H:%M")) for r in analytics.bursts(df.withColumn("repo", F.lit("r")), 10, ["repo"]).collect())
    assert got == [(1, 3, "10:09"), (4, 1, "10:10"), (5, 1, "10:21")]


def test_decay(spark):
    m = [("a", 4, at("2024-01-01"), "active", ["x"]), ("b", 4, None, "active", ["x"]), ("c", 4, at("2024-01-01"), "active", ["keep"]), ("d", 4, at("2024-01-01"), "archived", ["x"]), ("e", 1, None, "active", ["x"]), ("f", 4, at("2024-05-30"), "active", [])]
    df = spark.createDataFrame(m, "id string, importance int, last_used_at timestamp_ntz, status string, tags array<string>")
    got = {r["id"]: (r["importance"], r["decayed"], r["status"]) for r in lifecycle.decayed(df, now(), immune=["keep"]).collect()}
    assert got == {"a": (3, True, "active"), "b": (3, True, "active"), "c": (4, False, "active"), "d": (4, False, "archived"), "e": (1, True, "active"), "f": (4, False, "active")}
    assert {r["id"] for r in lifecycle.decayed(df, now(), least=2.0).where("decayed and status = 'archived'").collect()} == {"e"}


def test_hybrid_engine(spark):
    pool = spark.createDataFrame([(f"m{i}", i / 10, 0.0, 0.0, 0.0) for i in range(10)], "id string, similarity double, keyword double, recency double, domain double")
    got = rows(retrieval.hybrid(pool, "memory", small=0.0, large=0.2).select("id", "rank", "eligible").orderBy("rank"))
    assert got == [("m9", 1, 10), ("m8", 2, 10), ("m7", 3, 10), ("m6", 4, 10), ("m5", 5, 10)]
    assert rows(retrieval.hybrid(pool, "memory").select("id")) == [("m9",)]  # none reaches 0.4: the best stays
    pages = [r[0] for p in range(5) for r in rows(retrieval.hybrid(pool, "memory", p * 2, 2, small=0.0, large=0.0).select("id"))]
    assert sorted(pages) == [f"m{i}" for i in range(10)]
    few = rows(retrieval.hybrid(pool, "memory", post=F.col("id") != "m9", small=0.0, large=0.3).select("id"))
    assert few == [("m8",)]
    extra = spark.createDataFrame([("m1", 1.0), ("v", 0.9)], "id string, similarity double")
    assert retrieval.merged_with_vectors(pool, extra).count() == 11 and retrieval.merged_with_vectors(pool, extra, "fallback").count() == 10
    assert retrieval.merged_with_vectors(pool.where("false"), extra, "fallback").count() == 2


def test_bm25_and_cosine(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, "delta epsilon zeta"), (4, None), (5, "")], "id int, body string")
    got = {r["id"]: r["bm25"] for r in retrieval.bm25(df, "bet", ["body"]).collect()}
    assert set(got) == {1} and got[1] < 0
    assert rows(retrieval.bm25(df, "", ["body"])) == [] and retrieval.bm25(df, '"alpha beta"', ["body"]).count() == 1
    assert [r["id"] for r in retrieval.bm25(df, "alpha g", ["body"]).collect()] == [2]
    assert [r["id"] for r in retrieval.bm25(df, "ALPHA_gam", ["body"]).collect()] == [2] and rows(retrieval.bm25(df, "漢字", ["body"])) == []
    odd = spark.createDataFrame([(1, "Café of of the. of the"), (2, "prof the")], "id int, body string")
    assert [r["id"] for r in retrieval.bm25(odd, 'cafe "of the"', ["body"]).collect()] == [1]
    hits = odd.select(retrieval.phrase_hits(retrieval.text.folded(F.col("body")), ("of", "the")), retrieval.phrase_hits(retrieval.text.folded(F.col("body")), ("of", "of")))
    assert rows(hits) == [(2, 1), (0, 0)]
    cosine = {r["id"]: r["c"] for r in df.select("id", retrieval.tf_cosine("body", "beta beta alpha").alias("c")).collect()}
    assert cosine[1] == pytest.approx(1.0) and cosine[2] == pytest.approx(1 / (2**0.5 * 5**0.5)) and cosine[3] == cosine[4] == cosine[5] == 0
    assert [r["c"] for r in df.select(retrieval.tf_cosine("body", "the").alias("c")).distinct().collect()] == [0.0]


def test_similar_pairs_match_brute_force(spark):
    import random
    from collections import Counter
    from math import sqrt

    rng = random.Random(4)
    bodies = [" ".join(rng.choice(["kappa", "lam", "mu", "nu", "xi", "rho", "tau", "phi"][: rng.randrange(2, 9)]) for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, content string")
    vectors = [Counter(b.split()) for b in bodies]
    norm = [sqrt(sum(c * c for c in v.values())) for v in vectors]
    wanted = {}
    for i, v in enumerate(vectors):
        for j, w in enumerate(vectors):
            if i != j and norm[i] and norm[j] and (s := sum(v[t] * w[t] for t in v) / norm[i] / norm[j]) >= 0.7 - 1e-12:
                wanted.setdefault(i, []).append((-round(s, 9), j))
    wanted = sorted((i, j) for i, x in wanted.items() for _, j in sorted(x)[:3])
    for block, common in ((1024, 2048), (16, 3)):
        assert sorted((r["a"], r["b"]) for r in similarity.similar_pairs(df, "content", 0.7, 3, block=block, common=common).collect()) == wanted
    # within a scope, and with the rows open to all
    scoped = df.withColumn("repo", F.concat(F.lit("r"), F.col("id") % 4)).withColumn("open", F.col("id") % 5 == 0)
    some = {}
    for i, v in enumerate(vectors):
        for j, w in enumerate(vectors):
            if i != j and (i % 4 == j % 4 or j % 5 == 0) and norm[i] and norm[j] and (s := sum(v[t] * w[t] for t in v) / norm[i] / norm[j]) >= 0.7 - 1e-12:
                some.setdefault(i, []).append((-round(s, 9), j))
    some = sorted((i, j) for i, x in some.items() for _, j in sorted(x)[:3])
    for block, common in ((1024, 2048), (4, 2)):
        assert sorted((r["a"], r["b"]) for r in similarity.similar_pairs(scoped, "content", 0.7, 3, "repo", "open", block, common).collect()) == some


def test_similar_pairs_ship_a_unit_once_a_share(spark):
    """The number of cells, and of units shipped to them, hangs on the shares that a task holds, not on the blocks that meet."""
    rows = [(i, " ".join(f"w{(i * k) % 97} v{i % 7}" for k in range(1, 4)), None if i % 10 == 3 else f"r{i % 2}", i % 4 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, content string, repo string, open boolean")
    found, work = similarity.pairs_with_work(df, "content", 0.6, 3, "repo", "open", 8, 16)
    assert work.count() == 3
    again, more = similarity.pairs_with_work(df, "content", 0.6, 3, "repo", "open", 8, 16, held=400)
    cells, units = more.agg(F.count("*"), F.sum("units")).first()
    assert cells > 3 and units < 8 * 400
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))
    # a row without a scope agrees with no other
    scope, free = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    assert found.count() > 400 and all(free[r["b"]] or scope[r["a"]] is not None and scope[r["a"]] == scope[r["b"]] for r in found.collect())


def test_similar_pairs_shuffle_no_more_when_shares_are_many(spark):
    """Shares meet where they were written: forty times as many of them write no copies of units."""
    rows = [(i, " ".join(f"w{(i * k * k + k) % 1500}" for k in range(1, 60)), f"r{i % 2}", i % 5 == 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, content string, repo string, open boolean")
    context = spark.sparkContext._jsc.sc()

    def written(held):
        def total():
            context.listenerBus().waitUntilEmpty()
            return context.statusStore().executorSummary("driver").totalShuffleWrite()

        before = total()
        found, _ = similarity.pairs_with_work(df, "content", 0.3, 3, "repo", "open", 1024, 64, held=held)
        return total() - before, sorted(map(tuple, found.collect()))

    (few, one), (many, other) = written(similarity.HELD), written(3000)
    assert one == other and len(one) > 2000 and many < 2 * few


def test_similar_pairs_of_large_counts(spark, monkeypatch):
    """Counts above 127, of common terms and others, and an id in two rows, whose terms are put together."""
    from math import sqrt

    bodies = {1: {"kappa": 300, "lam": 128, "rho": 5}, 2: {"kappa": 127, "lam": 300, "xi": 200}, 3: {"xi": 1000, "rho": 129}, 4: {"lam": 1, "xi": 1}, 5: {"tau": 260, "kappa": 1}}
    texts = [(i, " ".join(" ".join([w] * n) for w, n in v.items())) for i, v in bodies.items()]
    texts += [(6, "lam xi xi"), (6, "kappa xi")]
    bodies[6] = {"lam": 1, "xi": 3, "kappa": 1}
    df = spark.createDataFrame(texts, "id int, content string")
    cosine = lambda v, w: sum(n * w.get(t, 0) for t, n in v.items()) / sqrt(sum(n * n for n in v.values()) * sum(n * n for n in w.values()))
    wanted = sorted((a, b, round(cosine(v, w), 6)) for a, v in bodies.items() for b, w in bodies.items() if a != b and cosine(v, w) >= 0.01)
    for common, named in ((1, 1), (1, 3), (2048, similarity.NAMED)):
        monkeypatch.setattr(similarity, "NAMED", named)
        found = similarity.similar_pairs(df, "content", 0.01, 9, common=common)
        assert sorted((a, b, round(x, 6)) for a, b, x in found.collect()) == wanted


def test_similar_pairs_of_named_rows(spark):
    """Ties among ids that are text, of different lengths, and among many equal similarities."""
    names = [f"n{i}" for i in range(30)]
    df = spark.createDataFrame([(n, f"kappa lam w{i}") for i, n in enumerate(names)], "id string, content string")
    for block in (4, 1024):
        found = similarity.pairs_with_work(df, "content", 0.6, 3, None, None, block, 2, held=24)[0]
        assert sorted((r["a"], r["b"]) for r in found.collect()) == sorted((n, m) for n in names for m in sorted(x for x in names if x != n)[:3])


def test_similar_pairs_rule_most_pairs_out(spark):
    """Of all pairs of the larger table, less than a tenth are added up in full."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang IN ('de', 'fr')").selectExpr("doc_id AS id", "text AS content", "source AS repo", "doc_id % 5 = 0 AS open")
    found, work = similarity.pairs_with_work(docs, "content", 0.6, 5, "repo", "open", 1024, 2048)
    met, exact = work.agg(F.sum("pairs"), F.sum("exact")).first()
    assert found.count() > 1000 and exact < 0.1 * 2 * met


def test_blocks_without_a_common_term_never_meet(spark):
    df = spark.createDataFrame([(i, f"{'kappa lam mu' if i < 40 else 'rho tau phi'} w{i % 7}") for i in range(80)], "id int, content string")
    found, work = similarity.pairs_with_work(df, "content", 0.6, 3, None, None, 40, 3)
    assert work.count() == 1 + 1 + 0 or work.agg(F.sum("pairs")).first()[0] < 80 * 79 // 2
    assert found.where("(a < 40) != (b < 40)").count() == 0 and found.select("a").distinct().count() == 80


def test_symbol_ranking(spark):
    s = [(1, "getUser", "utils.ts", True), (2, "getUser", "api/x.ts", False), (3, "getUserData", "data/y.ts", True)]
    df = spark.createDataFrame([(i, n, p, e, None, None) for i, n, p, e in s], "id int, name string, file_path string, exported boolean, doc_comment string, signature string")
    got = {r["id"]: (r["tier"], r["score"]) for r in code_index.ranked_symbols(df, "getUser").collect()}
    assert got == {1: (1, 1.0), 2: (1, 0.0), 3: (2, 0.0)}
    assert {r["score"] for r in code_index.ranked_symbols(df, " ").collect()} == {1.0}


def test_code(spark):
    files = spark.createDataFrame([("a.ts", "one\r\nTwo foo Foo\nx"), ("b.ts", None)], "file_path string, content string")
    assert rows(code_index.grep(files, "FOO").select("file_path", "line_no", "at")) == [("a.ts", 2, 4)]
    assert rows(code_index.grep(files, "f.o", regex=True).select("line_no", "at")) == [(2, 4)]
    symbols = spark.createDataFrame([(1, "r", "a.ts", "Outer", "class", 1, 20), (2, "r", "a.ts", "inner", "method", 5, 10), (3, "r", "b.ts", "x", "class", 1, 5)], "id int, repo string, file_path string, name string, kind string, start_line int, end_line int")
    points = spark.createDataFrame([("r", "a.ts", 7, 1), ("r", "a.ts", 15, 2), ("r", "c.ts", 1, 3)], "repo string, file_path string, line int, k int")
    got = {r["k"]: r["symbol_id"] for r in code_index.enclosing(points, symbols, ["repo", "file_path"], "line", "k").collect()}
    assert got == {1: 2, 2: 1, 3: None}
    assert dict(rows(code_index.parents(symbols, ["class"]))) == {1: None, 2: 1, 3: None}
    assert sorted(rows(code_index.directory_rollup(symbols.withColumn("file_path", F.concat(F.lit("d/"), "file_path")), 1).where("kind = 'class'"))) == [("", "class", 2), ("d", "class", 2)]


def test_the_latest_row_does_not_depend_on_the_order_of_ties(spark):
    table = [(1, 7, "2024-01-01", f"agent{i}") for i in range(9)]
    for items in (table, table[::-1]):
        df = spark.createDataFrame(items, "task_id int, id int, claimed_at string, agent string").coalesce(1).withColumn("released_at", F.lit(None).cast("string"))
        assert rows(analytics.active_claims(df)) == [(1, "agent8", "2024-01-01")]


def test_ranked_edges_are_of_all_repositories(spark, sf):
    from quernstone.plans import QUERIES
    from quernstone.plans.bindings import Tables

    t = Tables(spark, sf)
    known = dict(rows(t.relations.where("from_entity LIKE 'supplier %'").select("from_entity", "repo").distinct()))
    assert {known.get(r["from_entity"]) for r in QUERIES["kg_edges_ranked"](spark, sf).collect()} >= {"kg0", "kg1"}


def test_the_unified_graph_has_the_entities_of_all_repositories(spark, sf):
    from quernstone.plans import QUERIES
    from quernstone.plans.bindings import Tables

    assert QUERIES["unified_graph"](spark, sf).where("domain = 'kg'").count() == Tables(spark, sf).entities.count()


def test_postings_are_stored_without_a_shuffle_and_their_filters_reach_the_files(spark, tmp_path):
    from quernstone.operators import text_index

    df = spark.createDataFrame([(i, "thing an" + " of" * (i % 3)) for i in range(50)] + [(50, None), (51, "")], "id int, body string").repartition(3)
    made = retrieval.packed_postings(df)
    assert "Exchange hashpartitioning" not in (plan := made._jdf.queryExecution().toString()) and "rangepartitioning" not in plan
    made.write.parquet(f"file://{tmp_path}/p")
    back = retrieval.unpacked(spark.read.parquet(f"file://{tmp_path}/p"))
    assert sorted(rows(back.where("term = 'of'"))) == [("of", i, i % 3) for i in range(50) if i % 3]
    assert "StringStartsWith(term,th)" in back.where(F.col("term").startswith("th"))._jdf.queryExecution().toString()
    assert sorted(rows(retrieval.unpacked(retrieval.repacked(back)))) == sorted(rows(back))
    grams = text_index.trigram_index(df.withColumnRenamed("body", "content"), ["content"], rows=20).grams
    assert grams.where("gram = 'thi'").count() == 50 and grams.where("gram = 'thi'").select("part").distinct().count() > 1


def test_deletion_of_tasks_sorts_no_rows(spark):
    from quernstone.operators import records

    tasks = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9)], "id int, parent_id int")
    notes = spark.createDataFrame([(1, 1), (2, 3), (3, None), (4, 9)], "id int, task_id int")
    left, comments = records.deleted_tasks(tasks, notes, spark.createDataFrame([(1,), (1,), (9,), (None,)], "id int"))
    assert sorted(rows(left.select("id", "parent_id"))) == [(2, None), (3, 2), (4, None)]
    assert sorted(rows(comments), key=str) == [(2, 3), (3, None)]
    for df in (left, comments):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort" not in plan


def test_ids_that_repeat_in_other_files_name_no_further_symbols(spark):
    symbols = spark.createDataFrame([(1, "r", "a.ts", "one", 1, 20), (1, "r", "b.ts", "other", 1, 20), (1, "q", "a.ts", "third", 1, 20)], "id int, repo string, file_path string, name string, start_line int, end_line int")
    points = spark.createDataFrame([("r", "a.ts", 7, 1), ("r", "b.ts", 7, 2), ("r", "c.ts", 7, 3)], "repo string, file_path string, line int, k int")
    got = code_index.enclosing(points, symbols, ["repo", "file_path"], "line", "k").select("k", "symbol_id", "symbol")
    assert sorted(rows(got)) == [(1, 1, "one"), (2, 1, "other"), (3, None, None)]


def test_extraction(spark):
    body = "// adds\n// numbers\nfunction add(a) {\n}\n\n/* block\n   more */\nclass Foo extends Bar {\nconst k = 1\nlet f = async (x) => x\nimport y\nget /users list\ninterface I {\nx := 5\nname: \"v\"\n.cls {\n<div class='a'>\ntype T = int\n"
    got = [(n, k, line) for n, k, line, *_ in code_files.generic_symbols(body)]
    assert got == [("add", "function", 3), ("Foo", "class", 8), ("k", "variable", 9), ("f", "function", 10), ("get sers", "route", 12), ("I", "interface", 13), ("x", "variable", 14), ("name", "key", 15), (".cls", "class", 16), ("<div>", "class", 17), ("T", "type", 18)]
    notes = {n: c for n, *_, c in code_files.generic_symbols(body)}
    assert notes["add"] == "adds\nnumbers" and notes["Foo"] == "block more" and notes["k"] is None
    md = list(code_files.markdown_symbols("# T\ntext\n\n## S\n\n```py\n# no\n```\n### Deep\n"))
    assert [(n, k, a, b) for n, k, a, b, *_ in md] == [("T", "heading1", 1, 2), ("S", "heading2", 4, 4), ("code-block:py", "code_block", 6, 8), ("Deep", "heading", 9, 9)]
    files = spark.createDataFrame([("a.md", "markdown", "# X"), ("b.go", "go", "func Main() {"), ("c", None, None)], "file_path string, language string, content string")
    assert {(r["file_path"], r["name"]) for r in code_files.extracted(files).collect()} == {("a.md", "X"), ("b.go", "Main")}


@pytest.mark.parametrize(
    ("line", "wanted"),
    [
        ("async function go!(x)", ("function", "go!")),
        ("def a.b(c):", ("function", "a.b")),
        ("const f: (a) => b", ("function", "f")),
        ("handler = async (x) => x", ("function", "handler")),
        ("const x", ("variable", "x")),
        ("val y: Int", ("variable", "y")),
        ("let a b", None),
        ("n := make(x)", None),
        ("n := 3", ("variable", "n")),
        ("max-size: 10", ("key", "max-size")),
        ("on = 'x'", ("key", "on")),
        ("a = b", None),
        ("a = 'b", None),
        ("protocol P.Q {", ("interface", "P.Q")),
        ("typedef int_t", ("type", "int_t")),
        ("POST '/x/y' z", ("route", "post x/y'")),
        ("delete it", ("route", "delete t")),
        ("get 5", None),
        ("import class X", None),
        ("</div>", None),
        ("<my-tag a>", ("class", "<my-tag>")),
        (".a-b {", ("class", ".a-b")),
        (".a-b :", None),
        ("});", None),
        ("functional x", None),
    ],
)
def test_declarations(line, wanted):
    assert code_files.declared(line) == wanted


def test_comments_above_declarations():
    body = "/** One.\n * two\n */\n\ndef a()\n// gone\nx + y\ndef b()\n{- h -}\ndef c()\n#!/bin/sh\n/* open\ndef d()"
    assert [(n, c) for n, *_, c in code_files.generic_symbols(body)] == [("a", "One. * two"), ("b", None), ("c", "{- h -}")]


def test_discovery(spark, tmp_path):
    for p, body in {"src/a.py": "x\ny", "node_modules/z.js": "no", ".hidden/b.py": "no", ".agents/c.md": "yes", "src/gen/d.ts": "no", "note.bin": "no", "src/keep.log.ts": "k", "src/__init__.py": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(body)
    rules = [("", "*.log.ts"), ("src", "gen/"), ("src", "!keep.log.ts")]
    got = {r["file_path"]: (r["language"], r["lines"]) for r in code_files.discovered(spark, str(tmp_path), rules).collect()}
    assert got == {"src/a.py": ("python", 2), ".agents/c.md": ("markdown", 1), "src/keep.log.ts": ("typescript", 1), "src/__init__.py": ("python", 0)}


def test_walk_with_nested_rules(spark, tmp_path):
    """The walk in rounds finds what a walk of the whole tree on the driver finds; rules of a folder hold below it."""
    import os

    tree = {"a/b/c/d/e.py": "1", "a/b/keep.py": "", "a/b/drop.py": "", "a/x.py": "", "a/gen/y.py": "", "z.py": "", "node_modules/q.js": "", ".git/h.py": "", "b/gen/y.py": "", "a/b/.gitignore": "drop.py\n# a comment\n", "a/.gitignore": "gen/\n*.log.py\n", "a/b/n.log.py": "", "b/n.log.py": "", "a/b/c/.gitignore": "!n.log.py\n", "a/b/c/n.log.py": ""}
    for p, body in tree.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(body)
    (tmp_path / "empty").mkdir()
    rules = [(os.path.dirname(p), line) for p in sorted((p for p in tree if p.endswith(".gitignore")), key=lambda p: p.count("/")) for line in tree[p].split("\n")]
    hidden = lambda p: any(x in code_files.EXCLUDED or (x.startswith(".") and x not in code_files.DOT_FOLDERS) for x in p.split("/")[:-1])
    wanted = sorted(p for p in tree if not hidden(p) and not code_files.ignored(p, rules))
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        assert sorted(r["file_path"] for r in code_files.walked(spark, folder).collect()) == wanted
    assert "a/b/c/n.log.py" in wanted and "a/b/n.log.py" not in wanted and "b/gen/y.py" in wanted
    assert sorted(r["file_path"] for r in code_files.discovered(spark, str(tmp_path)).collect()) == [p for p in wanted if p.endswith(".py")]
    assert code_files.walked(spark, str(tmp_path / "empty")).collect() == []


def test_tables(spark):
    base = spark.createDataFrame([(1, "a", 10, {"k": "1"}), (2, "b", 10, None)], "id int, v string, t int, m map<string,string>")
    new = spark.createDataFrame([(1, "z", 10, {"j": "2"}), (3, "c", 5, None), (2, "old", 1, None)], "id int, v string, t int, m map<string,string>")
    assert sorted((r["id"], r["v"]) for r in tables.upserted(base, new, ["id"], "t").collect()) == [(1, "z"), (2, "b"), (3, "c")]
    assert [r["id"] for r in tables.inserted(base, new, ["id"], ["t"]).collect()] == [3]
    got = {r["id"]: (r["v"], r["m"]) for r in tables.updated(base, new, "id", ["m"]).collect()}
    assert got == {1: ("a", {"k": "1", "j": "2"}), 2: ("b", None)}
    raw = spark.createDataFrame([(None, '["a"]', "{bad"), ("t", "nope", '{"x":"1"}')], "title string, tags string, metadata string")
    assert sorted(map(str, rows(tables.decoded(raw)))) == ["('Untitled', ['a'], {})", "('t', [], {'x': '1'})"]
    lines = spark.createDataFrame([('{"id":1,"title":"x"}',), ('{"id":2}',), ("bad",)], "json string")
    assert rows(tables.imported(spark, lines, "id int, title string, v string", ["title"], {"v": F.lit("1.0")})) == [(1, "x", "1.0")]
    assert sorted(r[0] for r in rows(tables.exported(base.select("id", "m")))) == ['{"id":1,"m":{"k":"1"}}', '{"id":2,"m":null}']


def test_queue(spark):
    def job(i, key, status="pending", attempts=0, lease=None, backoff=None, digest="h", t="2024-05-01"):
        return (i, "m", key, status, attempts, lease and at(lease), backoff and at(backoff), digest, at(t), at(t))

    kind = "id int, entity_kind string, entity_id string, status string, attempts int, lease_until timestamp_ntz, backoff_until timestamp_ntz, content_hash string, created_at timestamp_ntz, updated_at timestamp_ntz"
    jobs = spark.createDataFrame([job(1, "a"), job(2, "b", "claimed", lease="2024-05-31"), job(3, "c", "claimed", lease="2024-06-02"), job(4, "d", backoff="2024-06-03"), job(5, "e", "poison", 5), job(6, "f", "done")], kind)
    assert [r["id"] for r in queue.claimed(jobs, now(), 5).orderBy("id").collect()] == [1, 2]
    failed = {r["id"]: (r["status"], r["attempts"], r["backoff_until"]) for r in queue.failed(jobs.withColumn("attempts", F.col("id")), now()).collect()}
    assert failed[1] == ("pending", 2, at("2024-06-01T00:00:02")) and failed[4][0] == "poison" and failed[3][2] == at("2024-06-01T00:00:08")
    assert {r["id"] for r in queue.purged(jobs, now()).collect()} == {1, 2, 3, 4}
    assert {r["id"]: r["status"] for r in queue.reconciled(jobs, now()).collect()}[2] == "pending"
    new = spark.createDataFrame([job(10, "a", digest="h"), job(11, "b", digest="x"), job(12, "b", digest="y", t="2024-05-02"), job(13, "e", digest="h"), job(14, "z")], kind)
    got = {r["entity_id"]: (r["id"], r["status"]) for r in queue.enqueued(jobs, new).collect()}
    assert got["a"] == (1, "pending") and got["b"] == (12, "pending") and got["e"] == (13, "pending") and got["z"] == (14, "pending") and len(got) == 7
    assert {r["status"] for r in queue.retried(jobs).where("id = 5").collect()} == {"pending"}
    done = queue.completed(jobs, jobs.where("id = 3").select("id"), now())
    assert {r["id"] for r in done.where("status = 'done'").collect()} == {3, 6}


def test_transitions(spark):
    tasks = spark.createDataFrame([(1, "in_progress", None), (2, "pending", 1), (3, "in_progress", None), (4, "blocked", None)], "id int, status string, parent_id int").withColumn("in_progress_at", now()).withColumn("finished_at", F.lit(None).cast("timestamp_ntz")).withColumn("updated_at", now())
    changes = spark.createDataFrame([(1, "completed", "x"), (2, "pending", None), (3, "completed", " "), (4, "completed", "x")], "id int, new_status string, comment string")
    got = {r["id"]: r["problem"] for r in lifecycle.checked_transitions(tasks, changes).collect()}
    assert got == {1: "open children", 2: None, 3: "comment required", 4: "blocked to completed"}
    ok = spark.createDataFrame([(3, "completed", "done")], "id int, new_status string, comment string")
    moved = {r["id"]: (r["status"], r["finished_at"] is not None) for r in lifecycle.moved(tasks, ok, now()).collect()}
    assert moved[3] == ("completed", True) and moved[1] == ("in_progress", False)


def test_streams(spark, sf, tmp_path):
    like = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(like.schema).parquet(f"{sf}/events.parquet*")
    events.run_available(stream.select("event_id"), str(tmp_path)).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/data").count() == like.count()
    events.run_available(stream.select("event_id"), str(tmp_path)).awaitTermination()  # nothing new
    assert spark.read.parquet(f"{tmp_path}/data").count() == like.count()


def test_empty_tables(spark, sf):
    from quernstone.plans.bindings import Tables

    t = Tables(spark, sf)
    m = t.memories.where("false")
    pool = m.selectExpr("id", "0D AS similarity", "0D AS keyword", "0D AS recency", "0D AS domain")
    assert rows(retrieval.hybrid(pool, "memory")) == [] and rows(retrieval.bm25(m, "x", ["title"])) == []
    assert rows(graph.ranked_edges(t.entities.where("false"), t.relations.where("false"))) == []
    assert rows(analytics.keep_newest(t.actions.where("false"), 5)) == [] and rows(analytics.bursts(t.actions.where("false"), 10, ["repo"])) == []
    assert rows(code_index.code_graph(t.symbols.where("false"), t.refs.where("false"))) == []


def test_documentation(spark):
    from quernstone.functions import documentation as D

    raw = "/**\n * Adds.\n * More.\n * @param a first\n * @deprecated\n */"
    assert D.parse_doc(raw) == {"summary": "Adds.", "description": ["More."], "tags": [{"tag": "@param", "text": "a first"}, {"tag": "@deprecated", "text": ""}], "deprecated": True}
    assert D.serialized_doc(raw) == "[DEPRECATED] Adds.\nMore.\n@param a first\n@deprecated" and D.serialized_doc("/** */") is None
    assert D.clean_doc("/// a\n// b\n# c") == ["a", "b", "c"]
    df = spark.createDataFrame([(raw,), (None,)], "c string").select(D.doc_struct(F.col("c")).alias("d")).select("d.summary", "d.deprecated")
    assert sorted(map(str, rows(df))) == ["('Adds.', True)", "(None, False)"]
    assert D.rendered_tree([("", "class", 2), ("d", "class", 1), ("d/e", "fn", 1)]) == ". (class 2)\n  d/ (class 1)\n    e/ (fn 1)"
    assert D.rendered_dead_code({}, [], []) == "" and "1 dead" in D.rendered_dead_code({"scanned": 2, "dead": 1}, [], [])
    steps = spark.createDataFrame([(["a", "b"],), (["x" * 400],), (None,)], "s array<string>").select(D.next_steps(F.col("s")))
    assert [len(r[0]) for r in rows(steps)] == [4, 303, 0]


def test_manifests(spark):
    from quernstone.sources import manifests as M

    body = '{"main":"./a.js","bin":{"x":"./a.js","y":"/b.js"},"exports":{".":{"import":"c.mjs","types":false}},"browser":{"a":false}}'
    assert M.entry_points(body) == [("a.js", "manifest"), ("b.js", "bin"), ("c.mjs", "manifest")] and M.entry_points("{") == [] and M.entry_points("[]") == []
    files = spark.createDataFrame([("r", "package.json", body), ("r", "z.js", "#!/usr/bin/node\n"), ("r", "b.js", "x")], "repo string, file_path string, content string")
    symbols = spark.createDataFrame([("r", "b.js", False), ("r", "z.js", False), ("r", "q.js", False), ("r", "b.js", True)], "repo string, file_path string, exported boolean")
    got = sorted(map(str, rows(M.entry_kind(symbols, M.manifest_entries(files), files).select("file_path", "exported", "entry_kind"))))
    assert got == ["('b.js', False, 'bin')", "('b.js', True, 'public-api')", "('q.js', False, None)", "('z.js', False, 'shebang')"]


def test_worker_and_watcher(spark, tmp_path):
    kind = "id int, entity_kind string, entity_id string, status string, attempts int, lease_until timestamp_ntz, backoff_until timestamp_ntz, content_hash string, created_at timestamp_ntz, updated_at timestamp_ntz"
    jobs = spark.createDataFrame([(i, "m", k, "pending", 0, None, None, "h", at("2024-05-01"), at("2024-05-01")) for i, k in enumerate("abcd")], kind)
    entities = spark.createDataFrame([("m", "a"), ("m", "b"), ("m", "d")], "entity_kind string, entity_id string")
    after, made = queue.worker_step(jobs, entities, now(), lambda df: df.where("entity_id <> 'b'").select("id", F.lit(1.0).alias("v")), most=3)
    assert {r["entity_id"]: (r["status"], r["attempts"]) for r in after.collect()} == {"a": ("done", 0), "b": ("pending", 1), "c": ("done", 0), "d": ("pending", 0)}
    assert [r["id"] for r in made.collect()] == [0]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x")
    seen = []
    for _ in range(2):
        events.run_available(events.watch(spark, str(tmp_path / "in"), "*.txt"), str(tmp_path), lambda df, n: seen.append(df.count())).awaitTermination()
    assert sum(seen) == 1


def test_small_lifecycle(spark):
    df = spark.createDataFrame([("Build", ["phase:old", "x"]), (None, ["Phase:a"])], "phase string, tags array<string>")
    assert [r["tags"] for r in lifecycle.with_phase_tag(df).collect()] == [["x", "phase:build"], []]
    assert lifecycle.due(None, at("2024-01-02")) and not lifecycle.due(at("2024-01-01T12:00"), at("2024-01-02")) and lifecycle.due(at("2024-01-01"), at("2024-01-02"))
    parts = spark.range(1).select(lifecycle.structured_content(decision=F.lit("use it"), reason=F.lit(None).cast("string"), outcome=F.lit("ok")))
    assert rows(parts) == [("Decision: use it\n\nOutcome: ok",)]


def test_action_rows(spark):
    calls = [
        ("memory-write", '{"id":"m1","repo":"r"}', '{"createdCount":2,"count":9}'),
        ("task-delete", '{"id":"t1","memory_id":"m2","scope":{"repo":"s"}}', '{"results":[1,2,3]}'),
        ("handoff-write", '{"title":"x"}', '{"handoff":{"id":"h"}}'),
        ("plain", "bad", "bad"),
    ]
    df = spark.createDataFrame(calls, "tool string, args string, response string")
    assert sorted(map(str, rows(tables.action_rows(df)))) == sorted(map(str, [("write", "r", None, "m1", None, 2), ("delete", "s", None, "m2", "t1", 3), ("write", "unknown", "x", None, "h", 0), ("plain", "unknown", None, None, None, 0)]))


def test_extracted_mentions_take_whole_texts(spark):
    words = [w for i in range(130) for w in (f"Name{i}", "plain", f"call_{i}", "Name0", "The", "Ab")]
    names = list(dict.fromkeys(w for w in words if w not in ("plain", "The", "Ab")))
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "Redis Kafka"), (3, "")], "id long, content string")
    got = sorted((r["doc"], r["pos"], r["name"], r["type"]) for r in graph.extracted_mentions(docs).collect())
    assert got == [(1, i, n, "identifier") for i, n in enumerate(names)] + [(2, 0, "Redis", "concept"), (2, 1, "Kafka", "concept")]


def test_creation_fails_on_repeats(spark):
    from quernstone.operators import records

    base = spark.createDataFrame([("r", "a")], "repo string, name string")
    assert records.created(base, base.withColumn("name", F.lit("b")), ["repo", "name"]).count() == 2
    with pytest.raises(Exception, match="exists already: r, a"):
        records.created(base, base, ["repo", "name"]).collect()


def test_percentiles_of_many_values(spark):
    import math
    import random

    rng = random.Random(2)
    items = [(g, rng.choice([rng.random(), rng.randrange(5) * 1.0])) for g in "ab" for _ in range(1 if g == "b" else 3000)]
    df = spark.createDataFrame(items, "g string, v double")
    for r in analytics.nearest_rank(df, ["g"], "v", {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect():
        values = sorted(v for g, v in items if g == r["g"])
        assert r["n"] == len(values) and [r[p] for p in ("p1", "p50", "p95", "p100")] == [values[max(1, math.ceil(len(values) * q)) - 1] for q in (0.01, 0.5, 0.95, 1.0)]


def test_postings_agree_with_texts(spark):
    import random

    rng = random.Random(8)
    df = spark.createDataFrame([(i, " ".join(rng.choice("theta thing an Änd ing Ingot".split()) for _ in range(rng.randrange(9)))) for i in range(200)], "id int, body string")
    index = retrieval.Index(retrieval.postings(df), retrieval.lengths(df))
    for query in ("th ing", "an", "zz", "th zz", ""):
        one, two = ({r["id"]: round(r["bm25"], 9) for r in retrieval.bm25(df, query, ["body"], None, i).collect()} for i in (index, None))
        assert one == two and (query != "an" or one)


def test_vector_index_recall(spark):
    """Every twentieth row against all rows: the index finds 0.9 and more of the ten nearest, the exact mode all."""
    import numpy as np

    from quernstone.operators import vector_index
    from quernstone.plans.retrieval_queries import PROBED

    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    table = sorted(v.collect())
    x = np.array([r["vector"] for r in table], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(x @ x.T, 9)
    wanted = {(r["id"], table[j]["id"]) for i, r in enumerate(table) if r["id"] % 20 == 0 for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (-near[i, j], table[j]["id"]))[:10]}
    index = vector_index.build(v, cells=PROBED[1])
    assert index.rows.count() == len(table)
    asked = v.where("id % 20 = 0")
    got = {(r["query"], r["id"]) for r in vector_index.search(index, asked, 10, PROBED[0]).collect()}
    assert len(got & wanted) >= 0.9 * len(wanted)
    assert {(r["query"], r["id"]) for r in vector_index.search(index, asked, 10, block=300).collect()} == wanted


def test_vector_index_of_awkward_rows(spark):
    from quernstone.operators import vector_index

    nan = float("nan")
    items = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0]), (8, [1.0, 0.0]), (9, [None, 1.0])]
    v = spark.createDataFrame(items, "id int, vector array<double>")
    got = vector_index.search(vector_index.build(v, cells=2), v, 2).orderBy("query", "rank").collect()
    assert [(r["query"], r["id"]) for r in got] == [(1, 2), (1, 8), (2, 1), (2, 8), (3, 1), (3, 2), (8, 1), (8, 2)]
    none = v.where("false")
    assert vector_index.search(vector_index.build(none), v, 2).collect() == []


def test_trigrams_prune_parts_and_find_what_a_scan_finds(spark):
    from quernstone.operators import text_index

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id AS id", "text AS content", "source AS title")
    odd = spark.createDataFrame([(10**6, "a%b_c ÄÖÜ straße", None), (10**6 + 1, None, "xyzzy 漢字 here"), (10**6 + 2, "", ""), (10**6 + 3, "ab", "İstanbul XYZZY")], "id long, content string, title string")
    both = docs.unionByName(odd)
    index = text_index.trigram_index(both, ["content", "title"], rows=50)
    parts = index.texts.select("part").distinct().count()
    assert parts > 15
    for query in ("xyzzy", "XyZzY", "token = ", "äöü", "漢字 h", "a%c", "ab", "", "zzzqq", "src3", "tra_h", "straße", "General Public"):
        wanted = sorted(r["id"] for r in both.where(retrieval.substring(query, "content", "title")).select("id").collect())
        assert sorted(r["id"] for r in text_index.substring_search(index, query).select("id").collect()) == wanted, query
    read = text_index.may_hold(index, "xyzzy")
    assert read.count() == 2  # rows read in full, of over a thousand
    assert read.select("part").distinct().count() <= 2 and "PartitionFilters: [part#" in read._jdf.queryExecution().toString()  # and parts


def test_index_follows_changes(spark, tmp_path):
    """After rows came, changed, went and came again, compacted or not, the index is the one built anew."""
    from quernstone.operators import text_index

    def state(index):
        return sorted(map(tuple, index.postings.select("term", "id", "tf").collect())), sorted(map(tuple, index.lengths.select("id", "length").collect()))

    def frame(items):
        return spark.createDataFrame(items, "id long, body string")

    now = {i: f"word{i % 3} and th{i} more{'' if i % 2 else ' words'}" for i in range(20)}
    store = text_index.IndexStore(spark, f"file://{tmp_path}/index")
    store.create(frame(list(now.items())))
    steps = [({3: "changed text", 40: "new text"}, [5]), ({5: "back again"}, [3, 40]), ({3: None, 6: ""}, [99]), ({}, [0, 1]), ({1: "one more"}, [])]
    for i, (changed, gone) in enumerate(steps):
        number = store.apply(frame(list(changed.items())), frame([(g, None) for g in gone]))
        store.apply(frame(list(changed.items())), frame([(g, None) for g in gone]), number)  # a repeated step changes nothing
        now = {k: v for k, v in {**now, **changed}.items() if k not in gone}
        rows_ = frame(list(now.items()))
        anew = retrieval.Index(retrieval.postings(rows_), retrieval.lengths(rows_))
        assert state(store.index()) == state(anew)
        if i == 2:
            store.compact()
            assert [kind for _, kind in store.generations()] == ["base"] and state(store.index()) == state(anew)
    got = retrieval.indexed_bm25(store.index(), ("th",)).collect()
    assert {r["id"]: round(r["bm25"], 9) for r in got} == {r["id"]: round(r["bm25"], 9) for r in retrieval.indexed_bm25(anew, ("th",)).collect()}
    # a generation without its marker doesn't count
    (tmp_path / "index" / "000000000099-delta").mkdir()
    assert state(store.index()) == state(anew)


def test_index_follows_a_stream(spark, tmp_path):
    from quernstone.operators import text_index

    kind = "id long, body string, deleted boolean, version long"
    store = text_index.IndexStore(spark, f"file://{tmp_path}/index")
    store.create(spark.createDataFrame([(1, "one"), (2, "two")], "id long, body string"))
    for n, items in enumerate([[(1, "uno", False, 1), (1, "eins", False, 2)], [(2, None, True, 3), (3, "drei", False, 4)], [(3, "tres", False, 5)]]):
        spark.createDataFrame(items, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        text_index.follow(store, stream, compact_after=2).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in store.index().postings.collect()) == [("eins", 1, 1), ("tres", 3, 1)]


def test_a_rewritten_table_is_not_answered_from_the_old_index(spark, sf, tmp_path):
    import shutil

    from quernstone.plans import QUERIES

    shutil.copytree(sf, tmp_path / "sf")
    assert QUERIES["memory_search_bm25"](spark, str(tmp_path / "sf")).count() > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("text", F.lit("quite other words"))
    (tmp_path / "sf" / "documents.parquet").unlink()
    docs.coalesce(1).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    assert QUERIES["memory_search_bm25"](spark, str(tmp_path / "sf")).count() == 0
    assert QUERIES["memory_search_like"](spark, str(tmp_path / "sf")).count() == 0


def test_numbers_of_one_group_over_many_tasks(spark):
    """Rows of one group, and of a null one, get their numbers from several ranges, none of which holds the group."""
    from quernstone.operators import prefix

    df = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, None).otherwise("one").alias("repo"), (F.col("id") * 7919 % 5000).alias("at"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        cut = prefix.ranged(df, ["repo"], ["at", "id"])
        sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
        assert len(sizes) >= 12 and max(sizes) < 1000
        got = sorted((r["repo"] or "", r["_n"], r["at"]) for r in prefix.numbered(df, ["repo"], ["at", "id"]).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    wanted = []
    for repo in ("", "one"):
        own = sorted(i * 7919 % 5000 for i in range(5000) if (i % 10 == 0) == (repo == ""))
        wanted += [(repo, n, at) for n, at in enumerate(own, 1)]
    assert got == wanted
    assert prefix.numbered(df.where("false"), ["repo"], ["id"]).collect() == []


def test_bursts_over_many_ranges(spark):
    """A run goes on over the border of a range."""
    df = spark.range(4000).selectExpr("id", "'r' AS repo", "IF(id < 3000, 'a', 'b') AS action", "CAST(NULL AS STRING) AS query", "1L AS memory_id", "timestampadd(SECOND, CAST(id AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') AS created_at")
    got = sorted((r["id"], r["burst"]) for r in analytics.bursts(df, 1, ["repo"]).collect())
    assert got == [(0, 3000), (3000, 1000)]


def test_interval_sweep_matches_brute_force(spark):
    import random
    import time

    from quernstone.operators import intervals

    rng = random.Random(2)
    spans = [(i, rng.choice("pq"), s, s + rng.choice([0, 3, 20, 200])) for i, s in enumerate(rng.randrange(1, 300) for _ in range(200))]
    points = [(i, rng.choice("pqr"), rng.randrange(1, 320)) for i in range(300)]
    symbols = spark.createDataFrame([(i, f, f"s{i}", "class" if i % 2 else "function", a, b, f) for i, f, a, b in spans], "id long, file_path string, name string, kind string, start_line int, end_line int, repo string")
    asked = spark.createDataFrame([*points, (900, None, 5), (901, "p", None)], "k long, file_path string, line int")
    wanted = {k: min(((b - a, a, i) for i, g, a, b in spans if g == f and a <= x <= b), default=(0, 0, None))[2] for k, f, x in points} | {900: None, 901: None}
    assert {r["k"]: r["symbol_id"] for r in code_index.enclosing(asked, symbols, ["file_path"], "line", "k").collect()} == wanted
    around = {i: max(((c, -d, j) for j, h, c, d in spans if j % 2 and h == f and j != i and c <= a and d >= b), default=(0, 0, None))[2] for i, f, a, b in spans}
    assert dict(rows(code_index.parents(symbols, ["class"]))) == around
    # one file of 100,000 lines and symbols, nested and side by side
    n = 100_000
    large = spark.range(n).selectExpr("id", "'f' AS file_path", "concat('s', id) AS name", "CAST(id + 1 AS INT) AS start_line", "CAST(IF(id % 1000 = 0, id + 1000, id + 2) AS INT) AS end_line")
    lines = spark.range(n).selectExpr("id AS k", "'f' AS file_path", "CAST(id + 1 AS INT) AS line")
    began = time.time()
    assert code_index.enclosing(lines, large, ["file_path"], "line", "k").where("symbol_id IS NOT NULL").count() == n
    assert time.time() - began < 60
    assert intervals.BIN < n  # swept by several tasks


def test_queue_state_survives_a_restart(spark, tmp_path):
    """Commands in several runs of one stream; each goes on from the checkpoint, leases end by timers."""
    from quernstone.streaming import queue_state

    kind = "entity_kind string, entity_id string, command string, id long, at timestamp_ntz"
    steps = [
        [("k", "a", "enqueue", 1, "2024-01-01 10:00:00"), ("k", "a", "claim", 2, "2024-01-01 10:00:10"), ("k", "b", "enqueue", 3, "2024-01-01 10:00:00"), ("k", "b", "claim", 4, "2024-01-01 10:00:01"), ("k", "c", "fail", 5, "2024-01-01 10:00:00")],
        [("k", "b", "fail", 6, "2024-01-01 10:00:30"), ("k", "z", "enqueue", 7, "2024-01-01 18:00:00")],
        [("k", "z", "claim", 8, "2024-01-02 18:00:00"), ("k", "b", "claim", 9, "2024-01-02 18:00:00"), ("k", "b", "complete", 10, "2024-01-02 18:00:05")],
    ]
    wanted = [{"a": ("claimed", 0), "b": ("claimed", 0)}, {"a": ("pending", 0), "b": ("pending", 1), "z": ("pending", 0)}, {"a": ("pending", 0), "b": ("done", 1), "z": ("claimed", 0)}]
    for i, items in enumerate(steps):
        df = spark.createDataFrame([(*r[:4], at(r[4])) for r in items], kind)
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        queue_state.run_jobs(queue_state.job_states(stream, 60, "1 minute"), f"{tmp_path}/q").awaitTermination()
        got = {r["entity_id"]: (r["status"], r["attempts"]) for r in queue_state.current_jobs(spark, f"{tmp_path}/q").collect()}
        assert got == wanted[i], i

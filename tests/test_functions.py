"""Column functions and query-text parsers."""

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import querytext as Q
from quernstone.functions import scoring, text


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_tokens(spark):
    assert values(spark, text.tokens, ["The quick_brown  fox-2.0, yang the.!", "", "untuk"]) == [["quick_brown", "fox-2.0", "the."], [], []]
    assert values(spark, text.fts_tokens, ["Café fox-2.0 NAÏVE"]) == [["cafe", "fox", "2", "0", "naive"]]
    assert values(spark, text.word_tokens, ["a bc D9"]) == [["bc", "d9"]]
    assert values(spark, text.stub_tokens, ["The Café is on fire!"]) == [["café", "fire"]]


def test_small_functions(spark):
    assert values(spark, text.issue_refs, ["#12 and #3, #12", "none"]) == [[3, 12], []]
    assert values(spark, text.slug, ["--Hello, World!", "ok"]) == ["hello-world", "ok"]
    assert values(spark, text.line_count, ["", "a", "a\nb\n"]) == [0, 1, 3]
    assert values(spark, text.language_of, ["a/b.TSX", "x/Makefile", "noext", "a.b/c", "d.unknown", "Dockerfile", ".env"]) == ["typescriptreact", "makefile", None, None, None, "dockerfile", None]
    assert values(spark, text.repo_name, ["org/team/x", "x", '{"owner":"o","repo":"r"}']) == ["x", "x", "r"]
    assert values(spark, text.repo_owner, ["org/team/x", "x"]) == ["org", ""]
    assert values(spark, text.name_variants, ["a-b.c_d"])[0] == ["a-b.c_d", "a.b.c_d", "aB.c_d", "a-b-c_d", "a-b.c-d"]
    assert values(spark, lambda c: text.completion_score(c, "Src1"), ["src1", "src12", "xsrc1", "s-r_c1", "no"]) == [100, 75, 50, 25, 0]
    assert values(spark, text.doc_summary, ["a  b\nc", "x" * 200, "short\n" + "y" * 200]) == ["a b c", "x" * 139 + "…", "short"]
    assert values(spark, text.valid_entity_name, ["Kafka", "the", "12", "--", "ab"]) == [True, False, False, False, False]
    assert values(spark, text.metadata_title, ["[agent:x] t", " [on 2024-01-02]", "[x] agent:", "t"]) == [True, True, False, False]
    line = "x" * 60 + "HIT" + "y" * 60
    assert values(spark, lambda c: text.snippet(c, F.lit(60), 3), [line]) == ["…" + "x" * 40 + "HIT" + "y" * 40 + "…"]
    assert values(spark, lambda c: text.parts_in_order(c, text.camel_parts("FooBar")), ["getFooBar", "BarFoo"]) == [True, False]
    assert text.camel_parts("getHTTPServer") == ["get", "HTTP", "Server"]


def test_scores(spark):
    half = values(spark, lambda c: scoring.decay(c, 30.0), [0.0, -5.0, 30.0, 60.0, 1e9], "double")
    assert half[:4] == [1.0, 1.0, 0.5, 0.25] and 0 <= half[4] < 1e-9
    assert values(spark, scoring.confidence, [0.7, 0.4, 0.399], "double") == ["high", "medium", "low"]
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    got = values(spark, lambda c: scoring.recency(c.cast("timestamp_ntz"), now), ["2024-01-01 00:00:00", None])
    assert got == [0.5, 0.5]
    assert values(spark, lambda c: scoring.overlap(F.split(c, ","), text.strings(["a"])), ["a,b,A,c"]) == [0.5]
    both = values(spark, lambda c: scoring.dense_cosine(c, F.array(F.lit(1.0), F.lit(0.0))), [[2.0, 0.0], [0.0, 0.0], [1.0]], "array<double>")
    assert both == [1.0, 0.0, 0.0]
    assert values(spark, lambda c: scoring.threshold(c, "memory"), [5, 6], "int") == [0.1, 0.4]


@settings(max_examples=50, deadline=None)
@given(*[st.floats(0, 1)] * 4)
def test_blend_stays_in_bounds(a, b, c, d):
    w = scoring.WEIGHTS
    assert -1e-9 <= a * w["similarity"] + b * w["keyword"] + c * w["recency"] + d * w["domain"] <= 1 + 1e-9


NOW = datetime(2024, 3, 13, 15, 30)  # a Wednesday


@pytest.mark.parametrize(
    ("query", "rest", "since", "until"),
    [
        ("bugs last month", "bugs", datetime(2024, 2, 1), datetime(2024, 2, 29, 23, 59, 59, 999000)),
        ("last week's work", "'s work", datetime(2024, 3, 4), datetime(2024, 3, 10, 23, 59, 59, 999000)),
        ("this week", "", datetime(2024, 3, 11), None),
        ("a Yesterday b", "a b", datetime(2024, 3, 12), datetime(2024, 3, 12, 23, 59, 59, 999000)),
        ("today", "", datetime(2024, 3, 13), datetime(2024, 3, 13, 23, 59, 59, 999000)),
        ("past 2 weeks x", "x", datetime(2024, 2, 28), None),
        ("last 3 days", "", datetime(2024, 3, 10), None),
        ("past_hour", "", datetime(2024, 3, 13, 14, 30), None),
    ],
)
def test_time_windows(query, rest, since, until):
    assert Q.time_window(query, NOW) == Q.Window(rest, since, until)


def test_time_window_edges():
    assert Q.time_window("nothing", NOW) is None and Q.time_window("", NOW) is None
    assert Q.time_window("this week", datetime(2024, 3, 17)).since == datetime(2024, 3, 11)  # a Sunday belongs to the week before
    assert Q.time_window("last month", datetime(2024, 1, 5)).since == datetime(2023, 12, 1)


def test_query_text():
    assert Q.expanded("Fix auth? now") == "fix auth? now login security token session permission authorization authentication system"
    assert Q.full_text('data-pipeline "exact  Phrase" x*') == Q.Match((("exact", "phrase"),), ("data", "pipeline", "x"))
    assert len(Q.full_text("a b c d e f g h i j").prefixes) == 8 and Q.full_text("  ") == Q.Match()
    got = Q.tagged("find tag:a,b unknown:x lang:py repo:r tags:b,c", "memory")
    assert got.query == "find unknown:x" and got.filters == {"current_tags": ["a", "b", "c"], "scope": {"language": "py", "repo": "r"}}
    assert Q.tagged("is_global:1 stack:x", "standard").filters == {"is_global": True, "stack": ["x"]}
    assert Q.merged({"tags": ["a"], "v": 1}, {"tags": ["a", "b"], "v": 2}) == {"tags": ["a", "b"], "v": 2}
    assert Q.issue_numbers("issue 544, #3 and issues #12") == [3, 12, 544]
    assert Q.inferred_mode({"query": "x", "id": None}, [("id", "detail"), ("query", "search")], "recap") == "search"
    assert Q.page(None, None) == (0, 20) and Q.page(3, 1000) == (200, 100) and Q.page(0, 0) == (0, 1)
    assert Q.offset_of(Q.cursor(40)) == 40 and Q.offset_of("%%") == 0 and Q.offset_of(None) == 0
    assert Q.safe_pattern("a+b") == "a+b"
    for bad in ("(a+)+", "(x*)*y", "a" * 201, "(", ""):
        with pytest.raises((ValueError, __import__("re").error)):
            Q.safe_pattern(bad)


@given(st.integers(1, 50), st.integers(1, 100), st.integers(0, 400))
def test_pages_partition(number, size, total):
    seen = [i for p in range(1, total // size + 2) for i in range(*(lambda o, n: (o, min(total, o + n)))(*Q.page(p, size)))]
    assert seen == list(range(total))

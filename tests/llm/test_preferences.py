"""Preference formatting against plain Python."""

from quernstone.llm import preferences

T = preferences.Template()


def render(turn):
    return f"{T.opening}{turn[0] or 'user'}{T.after_role}{turn[1] or ''}{T.closing}"


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def mask(turns):
        out, at = [], 0
        for turn in turns:
            body = render(turn)
            if turn[0] == "assistant":
                out.append(f"{at + len(T.opening) + len(turn[0]) + len(T.after_role)}:{at + len(body)}")
            at += len(body)
        return ",".join(out)

    text = lambda turns: "".join(map(render, turns))
    return n, text(chosen[:n]), text(chosen[n:]), text(rejected[n:]), mask(chosen[n:]), mask(rejected[n:])


def test_formatting(spark):
    u, a = "user", "assistant"
    cases = {
        1: ([(u, "hé"), (a, "x"), (u, "y"), (a, "😀z")], [(u, "hé"), (a, "x"), (u, "y"), (a, "w"), (u, "more")]),
        2: ([(u, "q")], []),
        3: ([(u, "q"), (a, "r")], [(u, "q"), (a, "r")]),
        4: ([(None, None), (a, None)], [(None, None), (a, "")]),
        5: ([("system", ""), (a, "1")], [("system", "s"), (a, "1")]),
    }
    rows = [(k, side, i, r, t) for k, pair in cases.items() for side, turns in zip(("chosen", "rejected"), pair, strict=True) for i, (r, t) in enumerate(turns)]
    rows += [(6, "other", 0, "user", "x"), (None, "chosen", 0, "user", "x")]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").repartition(3)
    found = {r["pair_id"]: tuple(r)[1:] for r in preferences.formatted(df).collect()}
    assert found == {k: brute(*pair) for k, pair in cases.items()}


def test_weaker_replies(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (2, 0, "user", "q"), (2, 1, "assistant", "only"), (3, 0, "user", "none"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["pair_id"], r["side"], r["turn"]): r["text"] for r in preferences.weaker_replies(df).collect()}
    assert got[1, "rejected", 3] == "a" and got[1, "chosen", 3] == "b" and got[2, "rejected", 1] == "" and {k[0] for k in got} == {1, 2}
    assert preferences.formatted(preferences.weaker_replies(df.where("false"))).collect() == []


def test_query_agrees_with_its_sql(spark, sf):
    import duckdb

    from quernstone.llm import queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    wanted = con.sql(queries.ORACLE["op4_chat_formatting"])
    found = queries.op4_chat_formatting(spark, sf)
    assert found.columns == wanted.columns
    assert sorted(map(tuple, found.collect())) == sorted(wanted.fetchall())


def test_awkward_turns(spark):
    """Ties by role and text, a null number first, texts and conversations of any length, columns of any name."""
    long = [(9, "chosen", i, "assistant" if i % 2 else "user", "é" * (i % 7)) for i in range(4000)]
    rows = [(1, "chosen", 5, "user", "b"), (1, "chosen", 5, "assistant", "z"), (1, "chosen", 5, "user", None), (1, "chosen", None, "system", "s"), (1, "rejected", 1, "system", "s"), (2, "chosen", 0, "assistant", "x" * 300_000), *long]
    df = spark.createDataFrame([(*r, "mine", 7) for r in rows], "pair_id long, side string, turn long, role string, text string, _c string, prompt int")
    found = {r["pair_id"]: tuple(r)[1:] for r in preferences.formatted(df).collect()}
    first = [("system", "s"), ("assistant", "z"), ("user", None), ("user", "b")]
    assert found[1] == brute(first, [("system", "s")])
    assert found[2] == brute([("assistant", "x" * 300_000)], [])
    assert found[9] == brute([(r, t) for _, _, _, r, t in long], [])

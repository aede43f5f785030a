"""Whitening, collocations and SimHash against plain Python, on the small tables and on awkward rows."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from quernstone.llm import collocations, queries, simhash, whitening


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")


def awkward_rows():
    rng = random.Random(3)
    words = "alpha beta gamma delta One two THREE fire water earth".split()
    long = " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n", "\t"]) for _ in range(300_000))
    rows = [(1, None, "en"), (2, "", None), (3, " \t\n ", "en"), (4, "one", "de"), (5, "one two", None), (6, long, "en"), (None, "no id here at all", None), (None, None, None)]
    rows += [(10 + i, "hot words stay together; New York, new york! été naïve 漢字 x", "fr") for i in range(30)]
    return rows + [rows[5], rows[8]]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(*r, "x", 1, 2, b"z", 3) for r in awkward_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, n int, fp long, packed binary, root int")


# 11


def plain_whitening(vectors):
    x = [[int(np.floor(64.0 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = np.array(sorted({tuple(v) for v in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    c = ((fit * n - sums) / n).astype(float)
    cov = c.T @ c / n
    values, axes = np.linalg.eigh(cov)
    keep = [i for i in np.argsort(-values) if values[i] > 1e-10 * values.max()][:16]
    own = np.array(x, dtype=object) * n - sums
    return n, [int((d * d).sum()) for d in own], ((own / n).astype(float) @ axes[:, keep]) / np.sqrt(values[keep]), values[keep] / np.trace(cov), keep


def test_whitening_equals_a_plain_decomposition(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    kept = table.collect()
    n, deviation, white, share, _ = plain_whitening([r["embedding"] for r in kept])
    found = defaultdict(dict)
    for r in queries.op11_embedding_whitening(spark, sf).collect():
        found[r["vec_id"]][r["component"]] = r
    assert set(found) == {r["vec_id"] for r in kept}
    signs = {}
    for row, d, w in zip(kept, deviation, white, strict=True):
        own = found[row["vec_id"]]
        assert sorted(own) == list(range(1, 17))
        for k in range(16):
            r = own[k + 1]
            assert (r["n"], r["deviation"]) == (n, d) and r["identity_error"] < 1e-8
            assert r["explained"] == pytest.approx(share[k], rel=1e-9)
            assert abs(r["whitened"]) == pytest.approx(abs(w[k]), abs=1e-6)
            if abs(w[k]) > 1e-3:
                assert signs.setdefault(k, r["whitened"] * w[k] > 0) == (r["whitened"] * w[k] > 0)


def test_whitening_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, []), (None, [2.0, 5.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0]), (8, [-inf, 0.0]), (9, [1e300, 1.0, 3.0]), (10, [-1e300, 1.0, 2.5]), (11, [4.0])]
    df = spark.createDataFrame([(i, v, 1, "w") for i, v in rows], "vec_id long, embedding array<double>, n int, whitened string")
    got = whitening.whiten(df).collect()
    assert sorted(Counter(r["vec_id"] for r in got).items(), key=str) == sorted({1: 2, None: 2, 7: 4, 9: 1, 10: 1}.items(), key=str)
    two = [r for r in got if r["vec_id"] in (1, None, 7)]
    assert {r["n"] for r in two} == {3}  # the repeated row is fitted once
    n, deviation, _, share, _ = plain_whitening([[1.0, 2.0], [2.0, 5.0], [3.0, 1.0]])
    assert {r["deviation"] for r in two} == set(deviation)
    assert {r["component"]: r["explained"] for r in two} == pytest.approx(dict(enumerate(share, 1)))
    assert {r["deviation"] for r in got if r["vec_id"] in (9, 10)} == {None}  # past 64 bits
    assert whitening.whiten(df.where("false")).collect() == []
    same = spark.createDataFrame([(i, [1.5, 2.5]) for i in range(3)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).collect() == []


def test_whitening_with_a_constant_dimension(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(a), 2.0, float(b), float(a)]) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1, 2} and max(r["identity_error"] for r in got) < 1e-9


# 12


def plain_collocations(rows, least=10, top=2000, longest=3):
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        rows = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(100 * c >= 50 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in f.items() if len(q) > len(p) and c >= least and p[0] in q):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def mined(df, how=collocations.Mining()):
    return sorted(tuple(r) for r in collocations.collocations(df, how).select(*COLUMNS).collect())


def test_collocations_of_awkward_texts(awkward):
    assert mined(awkward) == plain_collocations(awkward_rows())
    assert mined(awkward.where("false")) == []


def test_collocations_with_small_limits_lose_nothing(awkward, monkeypatch):
    """Full buckets, many counts put out and texts cut in stretches give the same phrases."""
    monkeypatch.setattr(collocations, "STRETCH", 50)
    how = collocations.Mining(buckets=1 << 6, words=4, phrases=8, top=5)
    some = awkward.where("doc_id IS NULL OR doc_id != 6")
    rows = [r for r in awkward_rows() if r[0] != 6]
    assert mined(some, how) == plain_collocations(rows, top=5)


def test_collocations_of_four_words(spark):
    rows = [(i, "a b c d" if i < 12 else "b c d", "en") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert mined(df, collocations.Mining(longest=4)) == plain_collocations(rows, longest=4)


def test_collocations_equal_sql(spark, sf):
    connection = duckdb.connect(config={"memory_limit": "4GB", "max_temp_directory_size": "1GB"})
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = connection.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE['op12_phrase_collocations']})").fetchall()
    assert sorted(tuple(r) for r in queries.op12_phrase_collocations(spark, sf).select(*COLUMNS).collect()) == sorted(want)


def test_passes_prune_what_cannot_be_frequent(spark, docs):
    """The second pass counts a small part of the pairs, though the exact counts alone decide."""
    how, context = collocations.Mining(), spark.sparkContext
    found = collocations.counted(docs, 1, how, None, None)
    frequent = found.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg({"n": "sum"}).where("`sum(n)` >= 10")
    maps = [context.broadcast(x) for x in (collocations.phrase_bitmap(frequent, how), collocations.bucket_bitmap(found, how))]
    pruned = collocations.counted(docs, 2, how, *maps).where("phrase IS NOT NULL").select("lang", "phrase").distinct().count()
    none = [context.broadcast(b"\xff" * (how.buckets // 8))] * 2
    everything = collocations.counted(docs, 2, how, *none).where("phrase IS NOT NULL").select("lang", "phrase").distinct().count()
    assert 0 < pruned < everything / 20


# 13


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def expected(pairs):
    classes = plain_components([fp for _, fp in pairs])
    least = {}
    for (key, _), c in zip(pairs, classes, strict=True):
        if key is not None:
            least[c] = min(key, least.get(c, key))
    return sorted(((k, f"{fp:016x}", least.get(c)) for (k, fp), c in zip(pairs, classes, strict=True)), key=str)


def test_simhash_of_the_table(spark, sf, docs):
    pairs = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op13_simhash_near_dedup(spark, sf).collect()]
    assert sorted(got, key=str) == expected(pairs)


def test_simhash_of_awkward_texts(awkward):
    pairs = [(r[0], plain_fingerprint(r[1])) for r in awkward_rows()]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(awkward).collect()]
    assert sorted(got, key=str) == expected(pairs)
    assert simhash.near_duplicates(awkward.where("false")).collect() == []


def near(seed, centres, members, most):
    """Fingerprints around a few centres, with a run of bits that all share."""
    rng, out = random.Random(seed), []
    for _ in range(centres):
        centre = rng.getrandbits(64) & ~0xFFFFF | 0x5A5A5
        for _ in range(members):
            out.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, most))))
    return sorted(set(out))


@pytest.mark.parametrize("block", [4, 64, 8192])
def test_simhash_links_of_dense_and_skewed_fingerprints(spark, block):
    fps = near(5, 12, 60, 5) + near(6, 300, 1, 0)
    df = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp,) for fp in fps], "fp long")
    edges = simhash.links(df, simhash.Hashing(block=block)).collect()
    unsigned = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in edges]
    assert all((a ^ b).bit_count() <= 3 for a, b in unsigned)
    place = {fp: i for i, fp in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in unsigned:
        root[find(place[a])] = find(place[b])
    mine, want = [find(i) for i in range(len(fps))], plain_components(fps)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_simhash_emits_a_forest_a_bucket():
    fps = np.array([1 << i for i in range(60)] + [0], np.uint64)  # each two differ in two bits
    first, second = simhash.forest(fps, np.ones(len(fps), bool), 3)
    assert len(first) == len(fps) - 1 and sorted(second) == sorted(set(range(len(fps))) - {0})


@pytest.mark.parametrize("chosen", [[3], [-1, 3], [1, 1], [0, -1, 2], [1, 0, 0], [0, 0, 0, 0], [-1, 0, 0, 1]])
def test_thresholds_find_every_link(spark, chosen):
    """Any thresholds that sum up keep every link: the general pigeonhole principle."""
    fps = near(8, 3, 12, 3)
    df = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp,) for fp in fps], "fp long")
    bits = np.array_split(np.random.default_rng(0).permutation(64), len(chosen))
    assert sum(t + 1 for t in chosen) == 4
    members = simhash.signatures(df, [b.tolist() for b in bits], chosen)
    met = members.alias("x").join(members.alias("y"), "bucket").where("(x.home OR y.home) AND x.fp != y.fp").selectExpr("x.fp AS a", "y.fp AS b").distinct().collect()
    pairs = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in met}
    assert all((a, b) in pairs or (b, a) in pairs for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3)


def test_thresholds_are_the_cheapest():
    cost, chosen = simhash.allocated([[0, 5, 9, 30, 90], [0, 1, 2, 3, 50], [0, 100, 200, 300, 400]], 3)
    assert (cost, chosen) == (8, [0, 2, -1])
    skewed = simhash.part_costs(10**6, np.full(64, 0.5), list(range(16)), simhash.Hashing(), 10.0**11)
    plain = simhash.part_costs(10**6, np.full(64, 0.5), list(range(16, 32)), simhash.Hashing(), 10.0**6)
    assert skewed[1] > plain[1] and simhash.allocated([skewed, plain, plain, plain], 3)[1][0] == -1

"""The queries' results against plain Python, on the small tables and on awkward rows."""

import binascii
import hashlib
import random
import re
from fractions import Fraction

import public_tokenizers as tok
import pytest
from pyspark.sql import functions as F

from quernstone.llm import bpe, fingerprints, langid, media, mixing, near_dedup, pii, queries, token_counts, token_shards

AWKWARD = [
    (1, "Hello world, hello world again", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, "   \n\t ", "en", None),
    (5, "hello WORLD, hello world   again", "en", "b"),
    (6, "write a.b@c.d_e@f.g or +1 (743) 555-3824, 4111 1111 1111 1111, 10.0.0.256 10.0.0.25", "en", "b"),
    (7, "漢字 😀 naïve café ﬁne", "fr", "b"),
    (8, "x" * 3000 + " " + "12" * 900 + "<|endoftext|>  end", None, "b"),
    (8, "x" * 3000 + " " + "12" * 900 + "<|endoftext|>  end", None, "b"),
    (None, "no id here", "en", "c"),
    (10, "one two", "en", "a"),
    (11, "One TWO", "en", "a"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, la, s, None if t is None else len(t), "x", 1) for i, t, la, s in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, band string, _t int")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


def rows(df):
    return [r.asDict() for r in df.collect()]


def both(docs, awkward):
    return docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(awkward.select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 10**6))


def by_id(found):
    return sorted(found, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))


# 1


def test_media(docs, awkward):
    df = both(docs, awkward)
    texts = sorted(r["text"] or "" for r in rows(df))
    found = rows(media.media_report(df))
    wanted = []
    for t in texts:
        raw = t.encode()
        n = max(1, -(-len(raw) // 576)) * 576
        payload = raw + b"\xff" * (n - len(raw))
        png = media.to_png(payload)
        wanted.append((len(raw), n, hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), 576, n // 576))
    got = [(r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"], r["width"], r["height"]) for r in found]
    assert sorted(got) == sorted(wanted)


def test_media_stores_a_payload_of_a_shard_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "same text") for i in range(50)], "doc_id long, text string").coalesce(1)
    index = media.media_columns(df, folder=f"file://{tmp_path}/s")
    assert index.select("shard", "offset").distinct().count() == 1
    import tarfile

    (shard,) = (tmp_path / "s").iterdir()
    with tarfile.open(shard) as tar:
        assert [m.name for m in tar.getmembers()] == [hashlib.sha256(media.padded("same text")).hexdigest() + ".png"]


def test_media_rolls_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").coalesce(1)
    found = rows(media.with_payload_features(media.media_columns(df, media.Shards(shard_bytes=4000), folder=f"file://{tmp_path}/s")))
    assert len({r["shard"] for r in found}) > 2 and len(found) == 20


def test_damaged_bytes_are_noticed():
    png = bytearray(media.to_png(media.padded("abc")))
    png[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(png))


# 2


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_components(items, width, percent):
    sets = [shingle_set(t, width) for _, t in items]
    parent = list(range(len(items)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(items)):
        groups.setdefault(root(i), []).append(items[i][0])
    return [(items[i][0], len(sets[i]), min((x for x in groups[root(i)] if x is not None), default=None)) for i in range(len(items))]


def near_copies(edits, n=60, seed=1):
    """A base, many edits of it that differ from each other more than from it, and chains."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(200)]
    out = [" ".join(base)]
    for _ in range(n):
        edit = list(base)
        for _ in range(edits):
            edit[rng.randrange(200)] = word()
        out.append(" ".join(edit))
    chain = [word() for _ in range(150)]
    for i in range(12):
        chain = list(chain)
        chain[i * 12] = word()
        chain[i * 12 + 3] = word()
        out.append(" ".join(chain))
    passage = [word() for _ in range(40)]
    for _ in range(40):
        out.append(" ".join(passage + [word() for _ in range(12)]))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("words", "percent", "edits"), [(3, 85, 5), (5, 80, 4)])
def test_near_duplicates(spark, docs, awkward, words, percent, edits):
    more = spark.createDataFrame([(10**7 + i, t) for i, t in enumerate(near_copies(edits))], "doc_id long, text string")
    df = both(docs, awkward).select("doc_id", "text").unionByName(more)
    items = [(r["doc_id"], r["text"]) for r in rows(df)]
    got = rows(near_dedup.near_duplicates(df, near_dedup.Sketching(words=words, percent=percent, block=16)))
    wanted = brute_components(items, words, percent)
    wanted = [(i, n, i if n == 0 else c) for i, n, c in wanted]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(wanted, key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({c for _, _, c in wanted}) < len(wanted) - 60


def test_sketches_merge():
    import numpy as np

    own = near_dedup.Sketcher(near_dedup.Sketching())
    a, b = own.shingles(" ".join(map(str, range(300)))), own.shingles(" ".join(map(str, range(200, 500))))
    assert (np.maximum(own.registers(a), own.registers(b)) == own.registers(np.union1d(a, b))).all()


def test_likelihood_is_near_the_similarity():
    import numpy as np

    how = near_dedup.Sketching(fine=1000)
    own = near_dedup.Sketcher(how)
    a = own.shingles(" ".join(map(str, range(1000))))
    for start in (20, 50, 100, 190):
        b = own.shingles(" ".join(map(str, range(start, 1000))))
        r, s = own.registers(a, 1000), own.registers(b, 1000)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(near_dedup.estimate(r, s, len(a), len(b), how.base) - true) < 0.04
        may = near_dedup.may_link(r[None], s[None], np.array([len(a)]), np.array([len(b)]), how, 0.05)[0]
        assert may == (true >= 0.75) or abs(true - 0.75) < 0.04


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r["node"]: r["root"] for r in rows(near_dedup.components(spark.createDataFrame(edges, "a long, b long")))}
    low = {}
    for a, b in edges:
        low.setdefault(a, a), low.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {n: r for n, r in low.items() if n in got} and {n for e in edges for n in e if e[0] != e[1]} == set(got)


def test_deduplicated(awkward):
    kept = rows(near_dedup.deduplicated(awkward))
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, 1, 2, 3, 4, 6, 7, 8, 10]


def test_null_ids_keep_their_links(spark):
    base = [f"w{i}" for i in range(200)]
    near = lambda i: " ".join([*base[:i], "changed", *base[i + 1 :]])
    items = [(None, near(3)), (2, " ".join(base)), (None, near(90)), (None, near(90)), (7, "some other words here now"), (None, "alone " * 9)]
    got = rows(near_dedup.near_duplicates(spark.createDataFrame(items, "doc_id long, text string")))
    wanted = [(i, n, c) for i, n, c in brute_components(items, 5, 80)]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(wanted, key=key)


def test_namesakes_are_told_apart(spark):
    """Sets that share 64 bits of their digest are classes of their own."""
    found = spark.createDataFrame([(i, 0, 5, t, 3, b"") for i, t in enumerate((1, 1, 2, 3, 1))], "_key long, _text long, cid long, tell long, n_shingles long, registers binary").withColumn("name", F.col("cid"))
    got = rows(near_dedup.told_apart(found))
    assert len({r["cid"] for r in got}) == 3 and len({(r["cid"], r["tell"]) for r in got}) == 3 and {r["name"] for r in got} == {5}


def test_one_stray_in_a_large_bucket(spark):
    n, block = 10_000, 512
    inside = spark.range(n).select(F.lit(1).cast("long").alias("band"), F.lit(0).alias("number"), F.col("id").alias("cid"), F.when(F.col("id") < n - 1, 0).otherwise(9).cast("long").alias("root"), (F.col("id") < n - 1).alias("large"), F.lit(100).alias("n_shingles"))
    dealt = near_dedup.dealt_members(inside, near_dedup.Sketching(block=block))
    blocks = -(-(n - 1) // block)
    assert dealt.where("root = 0").count() == n - 1 and dealt.where("root = 9").count() == blocks + 1
    met = dealt.alias("p").join(dealt.alias("q"), ["band", "x", "y"]).where("p.root = 9 AND q.root = 0").select("q.cid").distinct().count()
    assert met == n - 1


def test_pairs_at_the_bound_reach_verification(spark):
    import numpy as np

    how = near_dedup.Sketching()
    own = near_dedup.Sketcher(how)
    rng = np.random.default_rng(395)  # registers agree less than the sets, by over 0.05
    hashes = np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64))
    rng.shuffle(hashes)
    one, two = (own.registers(x, how.fine) for x in (hashes[:180], np.concatenate([hashes[:160], hashes[180:]])))
    shared = int((one[: how.registers] == two[: how.registers]).reshape(how.bands, how.rows).all(axis=1).argmax())
    full = {1: hashes[:180], 2: np.concatenate([hashes[:160], hashes[180:]])}
    sets = spark.createDataFrame([(c, 180, x.tobytes(), np.sort(full[c]).tobytes()) for c, x in ((1, one), (2, two))], "cid long, n_shingles long, registers binary, hashes binary")
    inside = spark.createDataFrame([(7, shared, c, c, c == 2) for c in (1, 2)], "band long, number int, cid long, root long, large boolean")
    assert rows(near_dedup.remaining_links(inside, sets, how)) == [{"a": 1, "b": 2}]


def test_sets_of_far_sizes_never_meet(spark):
    """Blocks are of one size class; two sets meet if, and as the classes are coarse nearly only if, their sizes allow a link."""
    how = near_dedup.Sketching(block=4, percent=85, words=3)
    sizes = [50 + 7 * i for i in range(120)]
    inside = spark.createDataFrame([(7, 0, c, c, False, n) for c, n in enumerate(sizes)], "band long, number int, cid long, root long, large boolean, n_shingles long")
    dealt = near_dedup.dealt_members(inside, how)
    met = {tuple(sorted(r)) for r in dealt.alias("p").join(dealt.alias("q"), ["band", "x", "y"]).where("p.cid < q.cid AND (p.mine != q.mine OR p.x = p.y)").select("p.cid", "q.cid").collect()}
    may = {(a, b) for a in range(120) for b in range(a + 1, 120) if 100 * sizes[a] >= 85 * sizes[b]}
    assert may <= met and all(sizes[a] >= 0.85 ** 2.01 * sizes[b] for a, b in met)


def test_a_block_of_linked_members_gives_a_forest(spark):
    """Members of one bucket, each in a component of its own, all near copies: links, not pairs, leave the blocks."""
    import numpy as np

    how = near_dedup.Sketching(block=16)
    own = near_dedup.Sketcher(how)
    rng = np.random.default_rng(5)
    core = rng.integers(0, 2**64, 400, dtype=np.uint64)
    items = [np.unique(np.concatenate([core, rng.integers(0, 2**64, 8, dtype=np.uint64)])) for _ in range(120)]
    fine = [own.registers(x, how.fine) for x in items]
    first = [f[: how.rows].tobytes() for f in fine]
    one = [c for c, f in enumerate(first) if f == max(set(first), key=first.count)]  # members of one bucket of the first band
    sets = spark.createDataFrame([(c, len(items[c]), fine[c].tobytes(), items[c].tobytes()) for c in one], "cid long, n_shingles long, registers binary, hashes binary")
    inside = spark.createDataFrame([(7, 0, c, c, False) for c in one], "band long, number int, cid long, root long, large boolean")
    got = near_dedup.remaining_links(inside, sets, how).collect()
    blocks = -(-len(one) // how.block)
    assert len(one) > 40 and len(one) - 1 <= len(got) <= len(one) * (blocks + 1)  # of all pairs, that many leave
    assert len(near_dedup.components(spark.createDataFrame([tuple(r) for r in got], "a long, b long")).select("root").distinct().collect()) == 1


def test_deduplicated_takes_rows_of_one_id_by_their_texts(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(60)) for w in "abcd")
    items = [(1, a), (1, b), (1, a), (1, f"{a} more"), (2, f"{a} end"), (3, b), (4, c), (5, c), (5, d), (None, a), (None, "e f g"), (None, "e f g"), (6, ""), (6, ""), (6, " "), (6, None), (None, ""), (None, "")]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(items)], "doc_id long, text string, place int")
    kept = rows(near_dedup.deduplicated(df))
    got = sorted(((r["doc_id"] or 0), repr(r["text"])[:3]) for r in kept)
    wanted = [(0, "''"), (0, "''"), (0, "'e "), (1, "'a0"), (1, "'b0"), (4, "'c0"), (5, "'d0"), (6, "' '"), (6, "''"), (6, "Non")]
    assert got == wanted


# 3


def own_canonical(text):
    """The canonical form, from the definition: NFKC, full case folding, NFKC, single spaces."""
    import unicodedata

    form = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"\s+", " ", form).strip()


def test_canonical_form():
    import xxhash

    for text in ["", "  A\t b ", "ﬁne CAFÉ", "Straße\u00a0x", "Å \u2003 Ω", "x" * 5000 + "\n"]:
        assert fingerprints.canonical(text) == own_canonical(text).encode()
        assert fingerprints.digest(fingerprints.canonical(text)) == xxhash.xxh128(own_canonical(text).encode()).hexdigest()


def test_colliding_digests_stay_apart(spark, awkward, monkeypatch):
    rows_ = [(i, f"text {i % 3}", "one") for i in range(30)] + [(40, "alone", "two")]
    df = spark.createDataFrame(rows_, "key long, text string, fingerprint string").withColumn("form", F.encode("text", "UTF-8"))
    found = {r["key"]: r["group_id"] for r in rows(fingerprints.named_groups(df))}
    assert found == {**{i: i % 3 for i in range(30)}, 40: 40}


def test_hot_bucket_is_salted(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SALT_ROWS", 100)
    df = spark.createDataFrame([(i, "same  Text" if i % 2 else "same text") for i in range(1500)] + [(2000, "x")], "doc_id long, text string")
    report = rows(fingerprints.grouped_report(df))
    assert sorted((r["doc_id"], r["group_id"]) for r in report) == [*((i, 0) for i in range(1500)), (2000, 2000)]


def test_rows_of_one_id_fill_several_ranges(spark):
    rng = random.Random(6)
    items = [(7, f"t{rng.random()}") for _ in range(400)] + [(i, f"u{i}") for i in range(40)]
    df = spark.createDataFrame(items, "doc_id long, text string")
    placed = fingerprints.dealt(df).groupBy(F.spark_partition_id().alias("p")).agg(F.sum((F.col("key") == 7).cast("int")).alias("n"))
    assert sum(r["n"] > 40 for r in rows(placed)) >= 3
    report = rows(fingerprints.edit_report(df))
    assert len(report) == 440 and sorted(r["n_chars"] for r in report) == sorted(len(t) for _, t in items)


def test_edit_report(docs, awkward):
    for df in (docs, awkward.select("doc_id", "text")):
        tied = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
        items = [(r["doc_id"], r["text"] or "") for r in sorted(rows(tied), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tie"]))]
        wanted = []
        import xxhash

        for i, (key, text) in enumerate(items):
            after = items[(i + 1) % len(items)][1]
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            own, its, changed = (xxhash.xxh128(own_canonical(x).encode()).hexdigest() for x in (text, after, edited))
            wanted.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, float(own == changed), float(own == its)))
        got = [tuple(r.values()) for r in rows(fingerprints.edit_report(df).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"))]
        key = lambda x: (x[0] is not None, x[0] or 0)
        assert sorted(got, key=key) == sorted(wanted, key=key)


def test_exact_groups(spark, awkward):
    found = {(r["doc_id"], r["group_id"]) for r in rows(fingerprints.exact_groups(awkward))}
    assert (5, 1) in found and (1, 1) in found and (11, 10) in found and (3, 2) in found and (4, 2) in found
    many = spark.createDataFrame([(i, "Ａ  copy" if i % 2 else "a copy") for i in range(1500)], "doc_id long, text string")
    assert {r["group_id"] for r in rows(fingerprints.exact_groups(many))} == {0}


def test_report_holds_groups(spark, sf, docs):
    least = {}
    for r in rows(docs):
        form = fingerprints.canonical(r["text"])
        least[form] = min(r["doc_id"], least.get(form, r["doc_id"]))
    wanted = {r["doc_id"]: least[fingerprints.canonical(r["text"])] for r in rows(docs)}
    found = rows(queries.op3_document_fingerprints(spark, sf))
    assert len(found) == len(wanted) and {r["doc_id"]: r["group_id"] for r in found} == wanted and len(least) < len(wanted)


def test_report_of_awkward_rows(awkward):
    report = rows(fingerprints.grouped_report(awkward))
    assert len(report) == awkward.count()
    assert sorted((r["doc_id"] or 0, r["group_id"] or 0) for r in report) == [(0, 0), (1, 1), (2, 2), (3, 2), (4, 2), (5, 1), (6, 6), (7, 7), (8, 8), (8, 8), (10, 10), (11, 10)]


# 4: see test_preferences.py

# 5


def test_language_held_out(spark, sf):
    found = rows(queries.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id"))
    assert all(r["held_out"] == (binascii.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held_out"]]
    assert len(held) > 20 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def brute_language(taught, texts, profile):
    """Predictions from the definition, a trigram at a time."""
    import numpy as np

    def letter(point):
        return 2 * np.random.default_rng([profile.seed, point]).integers(0, 2, profile.dim, np.int8).astype(int) - 1

    def vector(text):
        padded = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " ")
        points = [0 if c == " " else ord(c) for c in padded]
        if not any(points):
            return None
        total = sum(np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in zip(points, points[1:], points[2:], strict=False))
        return total / np.linalg.norm(total)

    sums = {}
    for text, lang in taught:
        if lang and (v := vector(text)) is not None:
            sums[lang] = sums.get(lang, 0) + v
    names = sorted(sums)
    out = []
    for text in texts:
        v = vector(text)
        cosines = [0 if v is None else float(sums[x] @ v / np.linalg.norm(sums[x])) for x in names]
        out.append("und" if v is None else names[int(np.argmax(cosines))])
    return out


def test_language_against_brute_force_and_other_scripts(spark):
    words = {"en": "the cat sat on a mat and ran", "fr": "le café noir est près du château", "ru": "кот сидит на окне и смотрит", "uk": "кіт сидить на вікні і дивиться", "el": "η γάτα κάθεται στο παράθυρο", "zh": "猫坐 在窗边 看着 外面 的雨"}
    rng = random.Random(1)
    made = [(lang, (" " if lang != "zh" else "").join(rng.choice(text.split()) for _ in range(24))) for lang, text in words.items() for _ in range(8)]
    df = spark.createDataFrame([(i, t, la) for i, (la, t) in enumerate(made)], "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 2 = 0"))
    found = {r["doc_id"]: r["lang_pred"] for r in rows(langid.identify(df, model))}
    assert [found[i] for i in range(len(made))] == brute_language([(t, la) for i, (la, t) in enumerate(made) if i % 2 == 0], [t for _, t in made], model.profile)
    assert sum(found[i] == la for i, (la, _) in enumerate(made)) >= len(made) - 2


def test_vectors_do_not_depend_on_their_neighbours():
    import numpy as np

    own = langid.Encoder(langid.Profile(grams=50, texts=3))
    texts = ["one text", "zwei Texte über", None, "три слова", "  ", "four"]
    whole = own.encode(texts)
    for text, vector in zip(texts, whole, strict=True):
        (alone,) = langid.Encoder(langid.Profile()).encode([text])
        assert (alone is None and vector is None) or np.array_equal(alone, vector)


def test_language_cases(awkward, empty):
    model = langid.fit(awkward)
    assert set(model.langs) == {"en", "fr"}
    found = {r["doc_id"]: r for r in rows(langid.identify(awkward, model))}
    assert [found[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and found[7]["lang_pred"] == "fr"
    assert {r["lang_pred"] for r in rows(langid.identify(awkward, langid.fit(empty)))} == {"und"}


# 6 and 10


def test_bpe_matches_the_library(docs, awkward):
    import tiktoken

    ranks = bpe.codec(queries.VOCABULARY).ranks
    library = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = both(docs, awkward)
    back = bpe.encode_documents(df, queries.VOCABULARY).withColumn("decoded", bpe.decoded(F.col("ids"), queries.VOCABULARY))
    for r in rows(back):
        ids = library.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids) and bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    one = rows(bpe.round_trip(df, queries.VOCABULARY).select("ids", "n_tokens", "decoded"))
    assert sorted(map(str, one)) == sorted(map(str, rows(back.select("ids", "n_tokens", "decoded"))))


def test_bpe_trees_agree():
    rng = random.Random(5)
    own = bpe.codec(queries.VOCABULARY)
    pieces = ["".join(rng.choice("abcé the漢😀") for _ in range(rng.randrange(1, 16))).encode()[:64] for _ in range(500)]
    assert own.merge_short(pieces, 64) == [own.merge_long(p) for p in pieces]


def test_decoding_checks_ids():
    with pytest.raises(ValueError):
        bpe.codec(queries.VOCABULARY).decode((60000).to_bytes(4, "little"))


def test_token_counts_match_the_library(docs, awkward):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.COUNTING.path)
    for how in (queries.COUNTING, token_counts.Counting(queries.COUNTING.path, 100, 50)):
        for r in rows(token_counts.token_counts(both(docs, awkward), how)):
            assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False))


def test_token_counts_of_awkward_texts():
    rng = random.Random(2)
    own = token_counts.Counter(queries.COUNTING)
    parts = ["a", "b", " ", "  ", "\n", "\t ", "é", "漢", "1", ".", "<|endoftext|>", "\xa0", " ", "'s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    assert own.count(texts) == [len(own.tokenizer.encode(t, add_special_tokens=False)) for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_token_counts_of_other_vocabularies(name, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tok.path(name))
    library.no_truncation()
    own = token_counts.Counter(token_counts.Counting(tok.path(name)))
    texts = [r["text"] for r in rows(docs.limit(30))]
    assert own.count(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]


# 7

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        found += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text or "") if good(kind, m[0])]
    return sorted(found)


def pii_texts():
    rng = random.Random(9)
    parts = ["a", "b.c", "@", "x@y.z", "_", " ", "-", "+", "1", "42", ".", "255", "256", "4111 1111 1111 1111", "(743)", "555-3824", "+1 (743) 555-3824", "10.0.0.1", "é", "😀", "\n", "00", "4111-1111-1111-1112"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(1500)]


def test_personal_data(spark, docs, awkward):
    more = spark.createDataFrame([(10**7 + i, t) for i, t in enumerate(pii_texts())], "doc_id long, text string")
    df = both(docs, awkward).select("doc_id", "text").unionByName(more).where("doc_id is not null")
    text = {r["doc_id"]: r["text"] for r in rows(df)}
    for r in rows(pii.personal_data(df)):
        base = base_spans(text[r["doc_id"]])
        names = [f"{k}:{a}:{b}" for a, _, b, k in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest(), (text[r["doc_id"]], names, r)
        assert [r[f"n_{k}"] for k in BASE] == [sum(x[3] == k for x in base) for k in BASE]
        assert set(names) <= set(r["spans"].split(",") if r["spans"] else [])


def test_long_runs_are_safe(spark):
    long = ["a" * 200_000, "1" * 100_000, "1 2-" * 30_000, "a.b" * 50_000 + "@" + "c.d" * 20_000, "+1" * 20_000, "1.2." * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in rows(pii.personal_data(df))}
    assert found[3]["n_email"] == 1 and found[0]["spans"] == "" and len(found) == 6


def test_redaction(spark):
    text = "é write a.b@c.de, 10.0.0.1 or +1 (743) 555-3824; card 4111 1111 1111 1111."
    df = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, None, None, None, None), (3, "clean", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: r for r in rows(pii.redact(df))}
    assert found[1]["text"] == "é write [EMAIL], [IP] or [PHONE]; card [CARD]."
    assert found[1]["n_chars"] == len(found[1]["text"]) and found[2]["text"] is None and found[3]["text"] == "clean"


def test_chosen_cells():
    kind = 1 << pii.BITS
    model = pii.Model({3: 0.95, kind + 1: 0.2}, {0: 0.9, 1: 0.9})
    assert model.chosen() == [3]


def test_trees_against_plain_python():
    """One tree of depth one is the split with the largest gain, found by trying all."""
    import math

    import numpy as np

    rng = random.Random(4)
    x = [[rng.randrange(3), rng.randrange(2), rng.randrange(4)] for _ in range(40)]
    n = [rng.randrange(1, 9) for _ in x]
    hits = [min(k, rng.randrange(9)) if r[2] > 1 else 0 for r, k in zip(x, n, strict=True)]
    how = pii.Boosting(trees=1, depth=1)
    got = pii.boosted(np.array(x), np.array(n, float), np.array(hits, float), how)
    slope, curve = [h - k / 2 for h, k in zip(hits, n, strict=True)], [k / 4 for k in n]
    gain = lambda rows_: sum(slope[i] for i in rows_) ** 2 / (sum(curve[i] for i in rows_) + 1)
    best = max(((f, v) for f in range(3) for v in range(3)), key=lambda t: gain([i for i, r in enumerate(x) if r[t[0]] <= t[1]]) + gain([i for i, r in enumerate(x) if r[t[0]] > t[1]]))
    for side in (lambda r: r[best[0]] <= best[1], lambda r: r[best[0]] > best[1]):
        part = [i for i, r in enumerate(x) if side(r)]
        step = how.rate * sum(slope[i] for i in part) / (sum(curve[i] for i in part) + 1)
        assert all(math.isclose(got[i], step) for i in part)


def test_calibration_is_the_isotonic_fit():
    import numpy as np

    score = np.array([0.1, 0.2, 0.3, 0.4, 0.4])
    steps = pii.calibrated(score, np.array([4.0, 4, 4, 2, 2]), np.array([0.0, 3, 1, 2, 2]))
    assert steps == [(0.1, 4.0, 0.0), (0.2, 8.0, 4.0), (0.4, 4.0, 4.0)]


def hidden_texts():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    luhn = lambda: next(c for c in iter(lambda: "4" + "".join(rng.choice("0123456789") for _ in range(15)), None) if good("card", c))
    phone = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    ip = lambda: ".".join(str(rng.randrange(10, 250)) for _ in range(4))
    plain = [f"{word()} {x} {word()}" for _ in range(60) for x in (f"{word()}@{word()}.com", ip(), luhn(), f"+1 {phone()}", f'token = "{rng.randbytes(20).hex()}"')]
    mail, card = word(), luhn()
    hidden = {"email": f"{mail} [at] {word()} [dot] com", "ip": ip().replace(".", "[.]"), "phone": phone(), "card": f"{card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]}"}
    return plain, hidden, f"+1 {phone()} {luhn()}", rng.randbytes(20).hex()


def test_secrets_of_a_small_table_are_found(spark):
    """All forty-digit tokens of a table too small for a threshold of their kind."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pattern = re.compile(r"token = \"([0-9a-f]{40})\"")
    wanted = {r["doc_id"]: len(pattern.findall(r["text"])) for r in rows(docs) if pattern.search(r["text"] or "")}
    found = {r["doc_id"]: r["n_secret"] for r in rows(pii.personal_data(docs)) if r["n_secret"]}
    assert sum(wanted.values()) >= 13 and all(found.get(k, 0) >= n for k, n in wanted.items())
    for n in (1, 2, 3):  # whatever the size
        one = docs.where(F.col("doc_id").isin(sorted(wanted)[:n]))
        assert sum(r["n_secret"] for r in rows(pii.personal_data(one))) >= n


def test_hidden_items_are_added(spark):
    plain, hidden, joined, secret = hidden_texts()
    texts = [*plain, *(f"see {x} there" for x in hidden.values()), f"see {joined} there", f"see {secret} there", "version 1.2.3 of 2024-03-01, page 12 345, 4111 1111 1111 1112"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in rows(pii.personal_data(df))}
    at = len(plain)
    for i, (kind, value) in enumerate(hidden.items()):
        assert found[at + i]["spans"] == f"{kind}:4:{4 + len(value)}", (kind, value, found[at + i])
        assert all(found[at + i][f"n_{k}"] == 0 for k in BASE)
    cut = joined.rindex(" ")
    assert found[at + 4]["spans"] == f"phone:4:{4 + cut},card:{5 + cut}:{4 + len(joined)}"
    assert found[at + 5]["secret_spans"] == "secret:4:44" and found[at + 5]["spans"] == ""
    assert found[at + 6]["n_spans"] == 0
    clean = {r["doc_id"]: r["text"] for r in rows(pii.redact(df))}
    assert clean[at] == "see [EMAIL] there" and clean[at + 4] == "see [PHONE] [CARD] there" and clean[at + 5] == "see [SECRET] there" and clean[at + 6] == texts[at + 6]


def test_very_many_matches_in_one_text(spark):
    import time

    part = "é a.b@c.de 10.0.0.1 +1 (743) 555-3824; 4111111111111111 x "
    text = part * 20_000
    began = time.time()
    (r,) = rows(pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert [r[f"n_{k}"] for k in BASE] == [20_000] * 4 and r["n_spans"] == 80_000
    assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(text)).encode()).hexdigest()
    (clean,) = rows(pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert clean["text"] == "é [EMAIL] [IP] [PHONE]; [CARD] x " * 20_000
    assert time.time() - began < 90


# 8


def brute_shards(items, how):
    """Records of each shard from plain sorting of all sequences."""
    import numpy as np

    ids = [k for k, *_ in items if k is not None]
    size = sum(len((t or "").encode()) for *_, t in items)
    shards = max(1, round(size / how.bytes_a_token / how.length / how.shard))
    low, span = min(ids), max(max(ids) - min(ids) + 2, 1024 * shards)
    found = []
    for key, tie, spread, text in items:
        stream = [*token_shards.encoder(how).encode_ordinary(text or ""), how.end]
        for j, at in enumerate(range(0, len(stream), how.length)):
            place = int(token_shards.place_of(np.array([key - low + 1 if spread is None else spread % span]), np.array([j]), span, how)[0])
            found.append((min(int(place / span * shards), shards - 1), place, j, key or -1, tie, stream[at : at + how.length]))
    out = []
    for shard in sorted({x[0] for x in found}):
        tails = []
        for x in sorted(x for x in found if x[0] == shard):
            if len(x[-1]) == how.length:
                out.append((shard, x[-1]))
                continue
            tails += x[-1]
            if len(tails) >= how.length:
                out.append((shard, tails[: how.length]))
                tails = tails[how.length :]
        if tails:
            out.append((shard, tails))
    return out


def test_token_shards(spark, docs, awkward, tmp_path):
    df = both(docs, awkward)
    how = token_shards.Layout(queries.LAYOUT.path, queries.LAYOUT.pattern, length=64, shard=37)
    index = sorted(rows(token_shards.materialise(df, how, f"file://{tmp_path}/t")), key=lambda r: r["slot"])
    assert [r["slot"] for r in index] == list(range(len(index)))
    items = [(r["doc_id"], r["tie"], r["spread"], r["text"]) for r in rows(token_shards.spread_rows(df).withColumn("tie", F.xxhash64("text")))]
    own = sorted(((r["doc_id"], r["text"]) for r in rows(df)), key=str)
    assert sorted(((k, t) for k, _, _, t in items), key=str) == own
    ids = [k for k, _ in own]
    assert all((spread is not None) == (k is None or ids.count(k) > 1) for k, _, spread, _ in items)
    wanted = brute_shards(items, how)
    stored = [x.tolist() for x in token_shards.read_from(f"file://{tmp_path}/t", how)]
    assert stored == [ids for _, ids in wanted] and [r["shard"] for r in index] == [s for s, _ in wanted]
    assert [r["n_tokens"] for r in index] == [len(ids) for _, ids in wanted]
    resumed = [x.tolist() for x in token_shards.read_from(f"file://{tmp_path}/t", how, 50)]
    assert resumed == stored[50:]
    sizes = [p.stat().st_size for p in sorted((tmp_path / "t").glob("tokens-*"))]
    assert len(sizes) > 5 and all(s % how.stride == 0 for s in sizes)
    import numpy as np

    for r in index[::17]:
        (path,) = (tmp_path / "t").glob(f"tokens-{r['shard']:08d}.bin")
        body = path.read_bytes()[r["byte_offset"] : r["byte_offset"] + how.stride]
        assert hashlib.sha256(body[4:]).hexdigest() == r["ids_sha256"] and np.frombuffer(body, "<u4", 1)[0] == r["n_tokens"]
    # neither the split of the table nor the number of writing tasks changes a slot
    for other in (df.repartition(3), df.coalesce(1)):
        assert sorted(map(str, rows(token_shards.materialise(other, how)))) == sorted(map(str, index))


@pytest.mark.parametrize("key", ["CAST(NULL AS LONG)", "CAST(IF(id % 3 > 0, 7, id) AS LONG)"])
def test_rows_without_an_own_id_spread_over_all_shards(spark, key):
    """A third and more of 100,000 rows have no id, or one id; half of them are alike. No shard holds more than its share."""
    text = F.when(F.col("id") % 2 == 0, "one and the same text").otherwise(F.concat(F.lit("text of number "), F.col("id").cast("string")))
    df = spark.range(100_000).select(F.expr(key).alias("doc_id"), text.alias("text"))
    how = token_shards.Layout(queries.LAYOUT.path, queries.LAYOUT.pattern, length=8, shard=2000)
    got = [r["n"] for r in token_shards.materialise(df, how).groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(got) > 30 and max(got) < 1.2 * sum(got) / len(got)


def test_shards_of_ids_spread_over_all_numbers(spark):
    items = [(-(2**63), "a b"), (2**63 - 1, "c"), (5, "d e f"), (6, "g"), (None, None)]
    df = spark.createDataFrame(items, "doc_id long, text string")
    how = token_shards.Layout(queries.LAYOUT.path, queries.LAYOUT.pattern, length=4)
    got = rows(token_shards.materialise(df, how))
    assert sum(r["n_tokens"] for r in got) == sum(len(token_shards.encoder(how).encode_ordinary(t or "")) + 1 for _, t in items)


# 9


def test_feistel_is_a_permutation():
    import numpy as np

    from quernstone.llm.shared import permuted, unpermuted

    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        got = permuted(np.arange(n), n, 12345)
        assert sorted(got.tolist()) == list(range(n))
        assert (unpermuted(got, n, 12345) == np.arange(n)).all()


def test_targets():
    mix = mixing.Mix()
    assert mixing.targets([100, 100, 100], mix) == [200, Fraction(500, 3), Fraction(250, 3)]
    assert mixing.targets([0, 10], mix) == [0, 15]
    assert mixing.targets([], mix) == []


@pytest.mark.parametrize("block", [16, 256])
def test_mix(docs, awkward, block):
    df = both(docs, awkward)
    mix = mixing.Mix(block=block, shard_slots=64)
    got = rows(mixing.mixed(df, mix))
    again = rows(mixing.mixed(df.repartition(3), mix))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["taken"])
    assert sorted(got, key=key) == sorted(again, key=key)
    given = rows(df)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((r["doc_id"] or -1, size(r["text"])) for r in given)
    totals, source = {}, {}
    for r in given:
        totals[r["source"]] = totals.get(r["source"], 0) + size(r["text"])
        source[r["doc_id"]] = r["source"]
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(names, mixing.targets([totals[n] for n in names], mix), strict=True))
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == totals[s] and r["target"] == float(wanted[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(taken[s] == int(wanted[s]) for s in names)


def test_draws_are_a_permutation_of_the_slots():
    import numpy as np

    mix = mixing.Mix(shard_slots=10)
    totals = np.array([37, 5, 0, 61])
    got = [x for shard in range(11) for s, j in mixing.drawn(shard, totals, mix, 4) for x in zip(s.tolist(), j.tolist(), strict=True)]
    assert sorted(got) == [(s, j) for s, n in enumerate(totals.tolist()) for j in range(n)]


def test_draws_of_very_many_slots():
    """Beyond 10 ** 9 slots a shard's counts are still drawn, not rounded: they vary about the source's share."""
    import numpy as np

    mix = mixing.Mix(shard_slots=1000)
    totals = np.array([3 * 10**11, 10**12, 7])
    counts = [sum(np.bincount(s, minlength=3) for s, _ in mixing.drawn(shard, totals, mix)) for shard in range(400)]
    first = np.array([c[0] for c in counts])
    share = totals[0] / totals.sum()
    assert abs(first.mean() - 1000 * share) < 3 and 0.8 < first.var() / (1000 * share * (1 - share)) < 1.25


def test_runs_follow_the_blocks():
    assert mixing.runs([(0, 5, 2, 0), (5, 9, 2, 0), (9, 12, 1, 2)]) == [(0, 12), (0, 11)]
    assert mixing.runs([(0, 4, 1, 0), (8, 12, 1, 0)]) == [(0, 4), (8, 12)]
    assert mixing.runs([(0, 5, 0, 0), (5, 9, 3, 0), (9, 12, 0, 1)]) == [(5, 10), (5, 9), (5, 9)]
    assert mixing.cut_words("  a b\nc  d ", [(0, 4), (0, 1), (1, 3), (3, 4)]) == ["  a b\nc  d ", "  a ", "b\nc  ", "d "]


def test_apply_mix(spark, docs, awkward):
    df = both(docs, awkward)
    df = df.where("doc_id != 1000008").withColumn("rid", F.lit("own")).withColumn("parts", F.col("doc_id") * 2)
    words = lambda t: re.findall(mixing.WORDS, t or "")
    wanted, got = {}, {}
    for r in rows(mixing.mixed(df)):
        if r["taken"]:
            wanted[r["doc_id"]] = r["taken"]
    texts = {r["doc_id"]: r["text"] for r in rows(df)}
    for r in rows(mixing.apply_mix(df)):
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"]) and r["rid"] == "own" and r["parts"] == (None if r["doc_id"] is None else 2 * r["doc_id"])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words(r["text"]))
    assert got == wanted


def test_apply_mix_of_rows_alike(spark):
    rows_ = [(None, "a b c d e f g h", "s", i % 3) for i in range(300)] + [(1, "x y z", "t", 0)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string, extra int").repartition(5)
    mix = mixing.Mix(block=4, shard_slots=16)
    got = rows(mixing.mixed(df, mix))
    taken = sum(r["taken"] for r in got)
    assert len(got) == 301 and sum(len(r["text"].split()) for r in rows(mixing.apply_mix(df, mix))) == taken


# all


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES][1].startswith("MinHash") and len(corpus_pipeline.STAGES) == 5
    ids = {r["doc_id"] for r in rows(docs)}
    found = rows(corpus_pipeline.run(spark, sf))
    assert found and all(r["round_trip"] and r["doc_id"] in ids for r in found)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
    kept = brute_components([(r["doc_id"], r["text"]) for r in rows(spark.read.parquet(f"{sf}/documents.parquet"))], 5, 80)
    first = {i for i, n, c in kept if n == 0 or i == c}
    assert {r["doc_id"] for r in found} <= first and {r["doc_id"] for r in rows(docs)} == {r["doc_id"] for r in found}
    assert not any("@mail" in r["text"] for r in rows(docs))
    assert rows(stage_empty(spark, columns)) == []


def stage_empty(spark, columns):
    import corpus_pipeline

    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").select(*columns)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    return empty


def test_empty_tables(spark, empty):
    assert rows(media.media_report(empty)) == [] and rows(near_dedup.near_duplicates(empty)) == []
    assert rows(fingerprints.edit_report(empty)) == [] and rows(fingerprints.exact_groups(empty)) == []
    assert rows(langid.identify(empty, langid.fit(empty))) == [] and rows(bpe.encode_documents(empty, queries.VOCABULARY)) == []
    assert rows(pii.personal_data(empty)) == [] and rows(pii.redact(empty)) == []
    assert rows(token_shards.materialise(empty, queries.LAYOUT)) == []
    assert rows(mixing.mixed(empty)) == [] and rows(mixing.apply_mix(empty)) == []
    assert rows(token_counts.token_counts(empty, queries.COUNTING)) == []


def test_columns_with_clashing_names_keep_their_values(spark, docs):
    """Extra columns named as those that operators make on the way, values and all."""
    names = "_t _base _wide _spans _b0 _w0 _u0 row rid key kept class mine several _key _text _kept _cid cid tell name band number a b parts copy block lang_pred score held text2 _id _copies _copy".split()
    df = docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    import corpus_pipeline

    for out in (near_dedup.deduplicated(df), pii.redact(df), mixing.apply_mix(df), corpus_pipeline.language(spark, df, "")):
        assert out.columns == df.columns
        found = rows(out)
        assert found and all(r[n] == f"{n}{r['doc_id']}" for r in found for n in names)


def test_registered_queries_hold_to_their_contracts(spark, sf, docs):
    """Names and types of the columns that each query promises, a row a document."""
    long, text, yes, real = "bigint", "string", "boolean", "double"
    promised = {
        "op1_media_columns": [("doc_id", long), ("n_bytes", long), ("payload_bytes", long), ("payload_sha256", text), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", text), ("feature", text)],
        "op2_minhash_near_dedup": [("doc_id", long), ("n_shingles", long), ("component_id", long), ("kept", yes)],
        "op3_document_fingerprints": [("doc_id", long), ("n_chars", long), ("edited_sha256", text), ("fingerprint", text), ("edited_fingerprint", text), ("near_edited", real), ("near_next", real)],
        "op5_language_id": [("doc_id", long), ("held_out", yes), ("lang_pred", text), ("score", real)],
        "op6_byte_bpe": [("doc_id", long), ("n_tokens", long), ("ids_sha256", text), ("decoded_sha256", text)],
        "op7_pii": [("doc_id", long), ("n_email", long), ("n_ip", long), ("n_card", long), ("n_phone", long), ("base_sha256", text), ("spans", text)],
        "op9_mixing": [("doc_id", long), ("size", long), ("source_size", long), ("target", real), ("taken", long)],
        "op10_token_counts": [("doc_id", long), ("n_bytes", long), ("n_tokens", long), ("over_limit", yes)],
    }
    n = docs.count()
    for name, columns in promised.items():
        out = queries.QUERIES[name](spark, sf)
        assert out.dtypes[: len(columns)] == columns, name
        assert out.count() == n, name
    by = {r["doc_id"]: r["text"] or "" for r in rows(docs)}
    for r in rows(queries.op10_token_counts(spark, sf)):
        assert r["n_bytes"] == len(by[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > 512)
    for r in rows(queries.op6_byte_bpe(spark, sf)):
        assert r["decoded_sha256"] == hashlib.sha256(by[r["doc_id"]].encode()).hexdigest()


def test_very_long_texts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghiäß漢") for _ in range(rng.randrange(1, 9)))
    long = " ".join(word() for _ in range(150_000))
    texts = [long, long + " end", "other text", long]
    df = spark.createDataFrame([(i, t, "xx", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: r["n_bytes"] for r in rows(media.media_report(df))} == {i: len(t.encode()) for i, t in enumerate(texts)}
    assert [r["component_id"] for r in by_id(rows(near_dedup.near_duplicates(df)))] == [0, 0, 2, 0]
    report = by_id(rows(fingerprints.grouped_report(df)))
    assert [r["group_id"] for r in report] == [0, 1, 2, 0] and [r["n_chars"] for r in report] == [len(t) for t in texts]
    assert {r["lang_pred"] for r in rows(langid.identify(df, langid.fit(df)))} == {"xx"}
    how = token_shards.Layout(queries.LAYOUT.path, queries.LAYOUT.pattern)
    assert sum(r["n_tokens"] for r in rows(token_shards.materialise(df, how))) == sum(len(token_shards.encoder(how).encode_ordinary(t)) + 1 for t in texts)
    mixed = rows(mixing.mixed(df))
    assert sum(r["taken"] for r in mixed) == int(1.5 * sum(r["size"] for r in mixed))

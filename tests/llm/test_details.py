"""Details of single operators against plain Python: stored forms, draws slot by slot, planted data, clashing columns."""

import math
import random
import re
import struct
import zlib
from collections import Counter
from itertools import count

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import media, mixing, pii, queries, shared, token_counts, token_shards


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


def read_png(data):
    """Samples of an 8-bit greyscale PNG: an own reader, of chunks with their checksums and all five filters."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + chunk)
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        body += chunk if kind == b"IDAT" else b""
        at += 12 + size
    width, height, bits, colour, *rest = head
    assert (bits, colour, rest) == (8, 0, [0, 0, 0])
    raw, out, above = zlib.decompress(body), b"", bytes(width)
    for y in range(height):
        kind, line, now = raw[y * (width + 1)], raw[y * (width + 1) + 1 : (y + 1) * (width + 1)], bytearray(width)
        for x in range(width):
            a, b, c = now[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            now[x] = (line[x] + (0, a, b, (a + b) // 2, near)[kind]) & 255
        above = bytes(now)
        out += above
    assert len(raw) == height * (width + 1)
    return out


def plain_feature(samples):
    n, c = len(samples), Counter(samples)
    mean = sum(samples) / n
    deviation = math.sqrt(max(0.0, sum(v * v * k for v, k in c.items()) / n - mean * mean))
    entropy = -sum(k / n * math.log2(k / n) for k in c.values())
    cuts = [i * n // 64 for i in range(65)]
    bright = "".join("1" if sum(samples[a:b]) * n > sum(samples) * (b - a) else "0" for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    return f"{mean:.4f}:{deviation:.4f}:{entropy:.4f}:{int(bright, 2):016x}"


def test_stored_media_read_by_another_reader(spark, tmp_path):
    texts = [None, "", "a", "é漢😀" * 700, "x" * 575, "y" * 576, "z" * 577, " \n\t" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = media.media_columns(df, folder=f"file://{tmp_path}/m")
    found = {r["doc_id"]: r for r in rows(media.with_payload_features(index))}
    for key, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = found[key]
        (path,) = [p for p in (tmp_path / "m").rglob("*") if p.is_file() and str(r["shard"]).endswith(p.name)]
        with open(path, "rb") as file:
            file.seek(r["offset"])
            stored = file.read(r["length"])
        assert read_png(stored) == payload and r["feature"] == plain_feature(payload) and r["media_bytes"] == len(stored)


def test_mix_slot_by_slot(spark):
    """The draw by hand: each source's stream of words, its slots one after another, until its target is reached."""
    rng = random.Random(9)
    items = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "b", None, "c"])) for i in range(200)]
    df = spark.createDataFrame(items, "doc_id long, text string, source string")
    mix = mixing.Mix(block=16, shard_slots=32)
    hashed = rows(df.select("doc_id", "source", F.size(F.split("text", " ")).alias("n"), F.xxhash64("text").alias("alike"), "text"))
    for r in hashed:
        r["size"] = len(r["text"].split())
    key = spark.createDataFrame([(r["doc_id"], r["size"], r["alike"]) for r in hashed], "doc_id long, size long, alike long").select("doc_id", F.xxhash64(F.lit(mix.seed), "doc_id", "size", "alike").alias("h"))
    place = {r["doc_id"]: r["h"] for r in rows(key)}
    names = sorted({r["source"] for r in hashed}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in hashed if r["source"] == s) for s in names]
    taken = Counter()
    for number, (name, size, target) in enumerate(zip(names, sizes, mixing.targets(sizes, mix), strict=True)):
        stream = [r["doc_id"] for r in sorted((r for r in hashed if r["source"] == name), key=lambda r: (place[r["doc_id"]], r["doc_id"])) for _ in range(r["size"])]
        blocks, left = -(-size // mix.block), int(target)
        for j in count():
            if not left:
                break
            epoch, at = divmod(j, blocks)
            block = int(shared.permuted(np.array([at]), blocks, mixing._key(mix, number, epoch))[0])
            words = stream[block * mix.block : (block + 1) * mix.block][:left]
            taken.update(words)
            left -= len(words)
    got = {r["doc_id"]: r["taken"] for r in rows(mixing.mixed(df, mix))}
    assert got == {i: taken[i] for i, _, _ in items}


CLASHING = "sid int, block string, low long, shard string, offset long, place double, number int, tie string, n_tokens string, size long, alike int, start long, target string, copy int, path string, length long, spread int, n_bytes string".split(", ")


def test_columns_of_clashing_names_change_nothing(docs, tmp_path):
    plain = docs.select("doc_id", "text", "source")
    more = plain.select("*", *(F.lit(7).cast(c.split()[1]).alias(c.split()[0]) for c in CLASHING), F.lit(1).alias("odd `name`"))
    layout = token_shards.Layout(queries.LAYOUT.path, queries.LAYOUT.pattern, length=64, shard=37)
    for run in (
        lambda df: media.media_report(df).drop("shard", "offset", "length"),
        lambda df: token_shards.materialise(df, layout),
        mixing.mixed,
        lambda df: token_counts.token_counts(df.select("doc_id", "text", *(df.columns[3:])), queries.COUNTING).select("doc_id", F.col("n_tokens").cast("string")) if "n_tokens" not in df.columns else token_counts.token_counts(df.drop("n_tokens"), queries.COUNTING).select("doc_id", F.col("n_tokens").cast("string")),
    ):
        assert sorted(map(str, rows(run(more)))) == sorted(map(str, rows(run(plain))))


def luhn(rng):
    while True:
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, digits)))
        if total % 10 == 0:
            return digits


def planted_items(rng, n):
    """Hidden forms of each kind, and decoys that look like them."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    ip = lambda: ".".join(str(rng.randrange(10, 250)) for _ in range(4))
    phone = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    four = lambda c: ".".join(c[i : i + 4] for i in range(0, 16, 4))
    for _ in range(n):
        yield "email", f"{word()} [at] {word()} [dot] com", True
        yield "email", f"{word()} at {word()} dot org", True
        yield "ip", ip().replace(".", "[.]"), True
        yield "phone", phone(), True
        yield "phone", f"001 {phone()}", True
        yield "card", four(luhn(rng)), True
        yield "secret", f'token = "{rng.randbytes(20).hex()}"', True
        card = luhn(rng)
        yield "card", four(card[:-1] + str((int(card[-1]) + 1) % 10)), False
        yield "ip", f"{rng.randrange(300, 999)}[.]{rng.randrange(10, 99)}[.]{rng.randrange(10, 99)}[.]{rng.randrange(10, 99)}", False
        yield "phone", f"{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}", False
        yield "email", f"look at {rng.randrange(10, 99)} dot {rng.randrange(10, 99)}", False


def test_recall_and_precision_of_planted_forms(spark):
    """Hidden forms and decoys of every kind planted between the words of real documents: recall and precision of what the trees add."""
    rng = random.Random(21)
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect() if r["text"]]
    items = list(planted_items(rng, 30))
    hosts = rng.sample(docs, len(items))
    texts, where = {r["doc_id"]: r["text"] for r in docs}, {}
    for (kind, value, real), host in zip(items, hosts, strict=True):
        words = host["text"].split(" ")
        cut = rng.randrange(len(words) + 1)
        before = " ".join(words[:cut]) + " "
        texts[host["doc_id"]] = before + value + " " + " ".join(words[cut:])
        where[host["doc_id"]] = (kind, len(before), len(before) + len(value), real)
    found = rows(pii.personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    hits, wanted, wrong = Counter(), Counter(), Counter()
    for r in found:
        if r["doc_id"] not in where:
            continue
        kind, low, high, real = where[r["doc_id"]]
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in f"{r['spans']},{r['secret_spans']}".split(",") if s)]
        met = [s for s in spans if s[1] < high and s[2] > low]
        if real:
            wanted[kind] += 1
            hits[kind] += any(k == kind and (b - a) >= 0.8 * (high - low if kind != "secret" else 40) for k, a, b in met)
        else:
            wrong[kind] += bool(met)
    for kind in wanted:
        recall, precision = hits[kind] / wanted[kind], hits[kind] / max(1, hits[kind] + wrong[kind])
        print(f"{kind}: recall {recall:.2f}, precision {precision:.2f}")
        assert recall >= 0.9 and precision >= 0.9, (kind, hits, wanted, wrong)

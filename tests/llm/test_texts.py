"""Edge cases and brute-force checks of the operators on texts: encoding, decontamination, near-duplicates, sharding."""

import base64
import binascii
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import bpe, decontam, neardup, samples, sharding

DOCS = "doc_id long, text string"


def docs(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    return df.withColumn("score", F.lit("x")).withColumn("spans", F.lit(1)).withColumn("n", F.lit(2)).withColumn("v", F.lit(3)) if extra else df


# --- byte-level BPE ---


def library_tokens():
    with open(bpe.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokens():
    return library_tokens()


ODD = ["", None, " ", "a" * 5_000, "  lead", "don't we'll 'S", "日本語テキスト 123 ²½", "\x1c\x1d x", "\n\n \t a", "<|endoftext|>", "é ﬁ ß É", "😀" * 50, "ab" * 3_000]


def test_bpe_equals_the_library_and_round_trips(spark, tokens):
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choice(["a", "'", "re", " ", "\n", "é", "日", "1", "!", "  ", "\xa0"]) for _ in range(draw.randrange(400))) for _ in range(40)]
    got = {r.doc_id: r for r in bpe.digests(docs(spark, texts, True), chunk=50, overlap=16).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(docs(spark, texts, True), chunk=50, overlap=16).collect()}
    raw = {r.doc_id: bytes(r.raw) for r in bpe.decode(bpe.encode(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = tokens.encode_ordinary(t or "")
        assert ids[i] == want
        assert got[i].n_tokens == len(want) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and raw[i] == (t or "").encode()


def test_bpe_repeated_rows_stay_apart(spark):
    df = spark.createDataFrame([(1, "x " * 400), (1, "x " * 400), (1, "y " * 400), (None, "z")], DOCS)
    out = bpe.digests(df, chunk=100, overlap=16).collect()
    assert sorted(r.n_tokens for r in out if r.doc_id == 1) == [401, 401, 401] and len(out) == 4


def test_bpe_empty_table(spark):
    assert bpe.digests(docs(spark, ["a"]).where("doc_id < 0")).count() == 0


# --- decontamination ---


def words8(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute8(texts, items, window):
    for t in texts:
        w, hit, found = words8(t), set(), set()
        for i, x in items:
            y = words8(x)
            for a in range(max(1, len(y) - window + 1) if y else 0):
                p = y[a : a + window]
                for b in range(len(w) - len(p) + 1):
                    if w[b : b + len(p)] == p:
                        hit.update(range(b, b + len(p)))
                        found.add(str(i))
        yield len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [300_000, 3])
def test_decontamination_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "PHRASES", most)
    draw = random.Random(3)
    vocabulary = ["The", "a", "é", "日本", "x1", "no", "yes"]
    texts = [None, "", "...", *[draw.choice([" ", ", ", "\n"]).join(draw.choice(vocabulary) for _ in range(draw.randrange(80))) for _ in range(60)]]
    items = [(0, None), (1, ""), (2, "yes"), (11, "the a"), *[(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(1, 9)))) for i in range(20, 30)]]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(0))
    got = {r.doc_id: tuple(r)[1:] for r in decontam.counted(decontam.find(docs(spark, texts, True), bench, window=5, shard_bytes=400)).collect()}
    assert [got[i] for i in range(len(texts))] == list(brute8(texts, items, 5))
    assert decontam.counted(decontam.find(docs(spark, texts).where("doc_id < 0"), bench, window=5)).count() == 0
    cut = decontam.decontaminate(docs(spark, texts, True).withColumn("_row", F.lit("own")).withColumn("block", F.lit(5)).withColumn("n_chars", F.length("text").cast("long")), bench, window=5, shard_bytes=400)
    for r in cut.collect():
        left = len(words8(r.text))
        assert (r["_row"], r.block) == ("own", 5)
        assert left == got[r.doc_id][0] - got[r.doc_id][1] and r.n_chars == (None if r.text is None else len(r.text))
        if not got[r.doc_id][4]:
            assert r.text == texts[r.doc_id]


@pytest.mark.parametrize("most", [300_000, 3])
def test_decontamination_of_one_long_item_and_repeated_rows(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "PHRASES", most)
    words = [f"w{i}" for i in range(30_000)]
    items = [("long", " ".join(words)), (None, "no id here"), ("a", "x y z"), ("a", "x y z")]
    texts = [" ".join(["before", *words[20_000:20_025], "after"]), "See: No ID here!", "x y z x y z", "w1 w2 w3"] + ["q x y z"] * 40
    df = spark.createDataFrame([(7, t) for t in texts], DOCS).repartition(3)
    got = sorted((r.n_words, r.n_hit, tuple(r["items"])) for r in decontam.find(df, spark.createDataFrame(items, "item_id string, text string")).collect())
    assert got == sorted([(27, 25, ("long",)), (4, 3, ()), (6, 6, ("a",)), (3, 0, ())] + [(4, 3, ("a",))] * 40)


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.counted(decontam.find(docs(spark, ["a b"]), none)).first().n_hit == 0
    assert decontam.find(docs(spark, ["a"]).where("doc_id < 0"), none).count() == 0


def test_suffix_array_and_search():
    draw = np.random.default_rng(0)
    text = draw.integers(2, 5, 300)
    index = decontam.FMIndex(text, 5, sample=7)
    assert index.locate(np.arange(index.n)).tolist() == decontam.suffix_array(np.append(text, 0)).tolist()
    phrases = np.array([[0, 2, 3], [4, 4, 2], [0, 0, 4]])
    low, high = index.search(phrases, np.count_nonzero(phrases, axis=1))
    for p, a, b in zip(phrases, low, high, strict=True):
        p = p[p > 0]
        assert sorted(index.locate(np.arange(a, b))) == [i for i in range(300 - len(p) + 1) if (text[i : i + len(p)] == p).all()]


# --- near-duplicates ---


def brute9(texts, width, percent=80):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("seed", "short"), [(0, 8), (1, 1)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, short):
    monkeypatch.setattr(samples, "SMALL_LOOKUP", seed * 10_000)
    draw = random.Random(seed)
    texts = [None, "", " \n", "one two", "One  TWO", "one", "É é a b", "é É a b"]
    for _ in range(6):  # groups of copies with edits, around the limit
        base = [f"w{draw.randrange(500)}" for _ in range(draw.randrange(20, 120))]
        for _ in range(25):
            w = list(base)
            for _ in range(draw.randrange(0, 1 + len(w) // 20)):
                w[draw.randrange(len(w))] = f"e{draw.randrange(10**6)}"
            texts.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"u{draw.randrange(10**6)}" for _ in range(100)) for _ in range(20)]
    draw.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, texts, True), 4, short_list=short, block=7).collect()}
    assert [got[i] for i in range(len(texts))] == brute9(texts, 4)


def test_near_duplicates_of_empty_and_repeated(spark):
    assert neardup.near_duplicates(docs(spark, ["a"]).where("doc_id < 0"), 4).count() == 0
    df = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (2, "a b c d e")], DOCS)
    assert sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(df, 4).collect()) == [(2, 2), (5, 2), (5, 2)]


def test_near_duplicate_stage_keeps_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "only here a b c d"), (None, "same words as in the other one"), (3, "same words as in the other one"), (4, "Same  words as in the other one"), (5, None), (6, ""), (3, "same words as in the other one")], DOCS).withColumn("kept", F.lit(1))
    got = sorted((r.doc_id or 0, r.text or "") for r in neardup.stage(spark, df, "").collect())
    assert got == sorted([(0, "only here a b c d"), (0, "same words as in the other one"), (3, "same words as in the other one"), (3, "same words as in the other one"), (5, ""), (6, "")])


def test_block_overlaps():
    sets = [np.array(sorted(s)) for s in ({1, 2, 3}, {2, 3, 4}, {9}, {3, 9})]
    assert neardup.overlaps(sets, np.array([0, 3]), np.array([1, 2]), width=2).tolist() == [[2, 0], [1, 1]]


# --- sharding ---


def brute10(df, shards=40):
    """Sizes, digests and near-equal contiguous shards, from the result alone."""
    by = {}
    for r in df.collect():
        by.setdefault(r.shard, []).append(r)
    return by


def test_shards_are_balanced_gapless_and_keep_groups(spark):
    draw = random.Random(4)
    texts = [None, "", *["é" * draw.randrange(300) for _ in range(1_500)], *["hot"] * 1_200]
    by = brute10(sharding.shard(docs(spark, texts, True), 8))
    total = sum(r.size for rows in by.values() for r in rows)
    seen = {}
    for shard, rows in by.items():
        assert sorted(r.slot for r in rows) == list(range(len(rows))) and 0 <= shard < 8
        assert abs(sum(r.size for r in rows) - total / 8) <= 700 + total / 800
        for r in rows:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, binascii.crc32(raw), "bytes", None)
            seen.setdefault(raw, set()).add(shard)
    assert sum(map(len, by.values())) == len(texts)
    small = {t for t in seen if texts.count(t.decode()) * (len(t) + 16) * 800 <= total}
    assert all(len(seen[t]) == 1 for t in small)


def plain10(rows, shards, buckets, hot_share, salts, group_share):
    """Order, shard and slot of every row (doc_id, text), computed one after another."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    key_of = lambda t: signed(xxhash.xxh64_intdigest((t or "").encode(), 42))
    salt_of = lambda i: signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)) % salts
    often = {k for k, n in Counter(key_of(t) for _, t in rows).items() if n > 1000 and n * hot_share > len(rows)}
    out = []
    for i, t in rows:
        k, raw = key_of(t), (t or "").encode()
        hot = k in often
        out.append(((((k % (1 << 64)) >> 40) % buckets, k if hot else 0, salt_of(i) if hot else 0), k, i, len(raw) + 16, binascii.crc32(raw)))
    out.sort()
    total, byte, at, group = sum(r[3] for r in out), 0, {}, Counter()
    for r in out:
        at.setdefault(r[1], byte)
        group[r[1]] += r[3]
        byte += r[3]
    placed, byte, first = [], 0, {}
    for n, (_, k, i, size, crc) in enumerate(out):
        shard = (at[k] if group[k] * shards * group_share <= total else byte) * shards // total
        first.setdefault(shard, n)
        placed.append((i, size, crc, "bytes", shard, n - first[shard], None))
        byte += size
    return placed


def test_shards_equal_a_plain_computation_also_at_borders(spark):
    """A text that is salted for its rows and small in bytes lies at a border for some seed: it isn't cut."""
    draw = random.Random(2)
    cut = 0
    for k in range(4):
        hot = [f"h{k}{j}" for j in range(3)]
        texts = [*[h for h in hot for _ in range(1_050)], *["x" * draw.randrange(1, 3_000) for _ in range(500)], None, "", "", "y" * 200_000]
        rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 3
        df = spark.createDataFrame(rows, DOCS).repartition(3)
        options = {"n_shards": 4, "buckets": 16, "hot_share": 50, "salts": 8, "group_share": 8}
        got = [tuple(r) for r in sharding.shard(df, **options).collect()]
        want = plain10(rows, 4, 16, 50, 8, 8)
        assert sorted(got, key=repr) == sorted(want, key=repr)
        by_text = {}
        for i, *_, shard, _, _ in got:
            by_text.setdefault(texts[i], set()).add(shard)
        total = sum(r[1] for r in got)
        small = [h for h in hot if 1_053 * 19 * 4 * 8 <= total]
        cut += sum(len(by_text[h]) > 1 for h in small)
        assert small
    assert cut == 0


def test_sharding_salts_a_hot_text(spark):
    texts = ["same text"] * 2_000 + [f"t{i}" for i in range(50)]
    by = brute10(sharding.shard(docs(spark, texts), 10, salts=4))
    sizes = [sum(r.size for r in rows) for rows in by.values()]
    assert len(by) == 10 and max(sizes) - min(sizes) <= 100


def test_sharding_is_native_and_handles_nothing(spark):
    df = sharding.shard(docs(spark, ["a", "b"]), 3)
    assert "Python" not in df._jdf.queryExecution().toString() and df.count() == 2
    assert sharding.shard(docs(spark, ["a"]).where("doc_id < 0"), 3).count() == 0

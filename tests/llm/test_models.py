"""Edge cases, held-out accuracy and brute-force checks of the models, archives, searches and chats."""

import base64
import hashlib
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.llm import ann, chat, langid, quality, samples, toxicity, warc

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
DOCS = "doc_id long, text string, lang string"
WORDS = {"xx": ["aba", "bab", "abba", "baab"], "yy": ["cod", "doc", "ocdo", "dodo"]}


def corpus(spark, n=120, seed=0):
    draw = random.Random(seed)
    rows = [(i, " ".join(draw.choice(WORDS[k]) for _ in range(draw.randrange(5, 30))), k) for i in range(n) for k in [draw.choice(["xx", "yy"])]]
    return spark.createDataFrame(rows, DOCS)


# --- language ---


def test_languages_are_told_apart_and_odd_texts_are_unknown(spark):
    docs = corpus(spark, 400)
    models = langid.fit(docs)
    odd = spark.createDataFrame([(900, None, "xx"), (901, "", None), (902, "123 !?", "yy"), (903, "ABA bab", None), (904, "dodo", "xx"), (904, "dodo", "xx"), (905, "б" * 50, None)], DOCS).withColumn("score", F.lit(1)).withColumn("entropy", F.lit(1))
    got = {r.doc_id: r for r in langid.identify(odd, models).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "xx", "yy"]
    assert all(got[i].score == 0 for i in (900, 901, 902)) and all(0 <= r.score <= 1 for r in got.values())
    assert got[905].lang_pred in ("xx", "yy") and got[905].rejected


def test_language_probabilities_sum_to_one(spark):
    models = langid.fit(corpus(spark))
    s, _, _ = langid.encoded(["aba bab"])
    context = s[3:6].astype(np.uint64)
    base = (context[0] << np.uint64(48)) | (context[1] << np.uint64(32)) | (context[2] << np.uint64(16))
    p = np.exp(models.logs(base | np.arange(1 << 16, dtype=np.uint64), 4).astype(float)).sum(0)
    assert np.allclose(p, 1, atol=1e-3)


class PlainKneserNey:
    """Interpolated Kneser-Ney of four symbols, written plainly over dictionaries."""

    def __init__(self, sequences, order=4):
        self.order, self.tables = order, []
        counts = Counter(tuple(s[i - order + 1 : i + 1]) for s in sequences for i in range(order - 1, len(s)))
        for n in range(order, 0, -1):
            ones, twos = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
            total, kinds = Counter(), Counter()
            for gram, c in counts.items():
                total[gram[:-1]] += c
                kinds[gram[:-1]] += 1
            self.tables.insert(0, (counts, total, kinds, ones / (ones + 2 * twos) if ones and twos else 0.5))
            counts = Counter(gram[1:] for gram in counts)

    def p(self, gram):
        if not gram:
            return 1 / 65_536
        counts, total, kinds, d = self.tables[len(gram) - 1]
        if gram[:-1] not in total:
            return self.p(gram[1:])
        return max(counts[gram] - d, 0) / total[gram[:-1]] + d * kinds[gram[:-1]] / total[gram[:-1]] * self.p(gram[1:])


def test_language_models_equal_plain_kneser_ney():
    draw = random.Random(4)
    texts = {k: [" ".join(draw.choice(w) for _ in range(draw.randrange(1, 12))) for _ in range(30)] for k, w in WORDS.items()}

    def sequences(own):
        s, first, _ = langid.encoded(own)
        return [s[a:b].tolist() for a, b in zip(first[:-1], first[1:])]

    counted = {}
    for k, own in texts.items():
        s, _, _ = langid.encoded(own)
        counted[k] = np.unique(langid.codes(s, 4)[s != langid.START], return_counts=True)
    models = langid.Models(counted)
    plain = [PlainKneserNey(sequences(texts[k])) for k in models.languages]
    asked = ["aba dodo", "zzz", "a", "cod bab 1 doc", "éa", "dododododo"]
    entropy, letters = models.entropies(asked)
    assert letters.all()
    for s, got in zip(sequences(asked), entropy):
        want = [-sum(math.log(m.p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / (len(s) - 3) for m in plain]
        assert np.allclose(got, want, rtol=1e-4)
    assert models.choose(asked)[0] == [models.languages[int(np.argmin([-sum(math.log(m.p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) for m in plain]))] for s in sequences(asked)]


def test_samples_are_the_lowest_hashes(spark, monkeypatch):
    rows = spark.range(6_000).selectExpr("id as doc_id", "CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 = 7 THEN null ELSE string(id % 10) END AS k").unionByName(spark.createDataFrame([(1, "few"), (1, "few")], "doc_id long, k string"))
    got = {(r.k, r.doc_id) for r in samples.lowest(rows, "k", 50).collect()}
    w = Window.partitionBy("k").orderBy(F.xxhash64(F.lit(42), F.col("doc_id")), "doc_id")
    assert got == {(r.k, r.doc_id) for r in rows.withColumn("n", F.row_number().over(w)).where("n <= 50").collect()} and len(got) == 4 * 50 + 1
    assert samples.lowest(rows.where("doc_id < 0"), "k", 5).count() == 0


@pytest.mark.parametrize("small", [0, 10_000])
def test_look_ups_of_hot_keys_equal_a_join(spark, monkeypatch, small):
    monkeypatch.setattr(samples, "SMALL_LOOKUP", small)
    rows = spark.createDataFrame([(i, 7 if i % 3 else i % 20) for i in range(300)] + [(1, 7), (1, 7), (900, 99), (901, None)], "i long, v long")
    table = spark.createDataFrame([(v, v * 2, n) for v, n in [*((v, 5) for v in range(20) if v != 7), (7, 210)]], "v long, n long, weight long")
    got = sorted(((r.i, r.v, r.n) for r in samples.looked_up(rows, "v", table, 3_000).collect()), key=str)
    assert got == sorted(((r.i, r.v, None if r.v in (None, 99) else r.v * 2) for r in rows.collect()), key=str)


def test_language_without_anything_to_learn(spark):
    none = corpus(spark).withColumn("lang", F.lit(None).cast("string"))
    assert langid.fit(none) is None
    assert {r.lang_pred for r in langid.identify(none, None).collect()} == {"und"}
    assert langid.identify(none.where("doc_id < 0"), None).count() == 0


@needs_data
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = langid.op1_langid(spark, DATA).where("held_out").join(docs, "doc_id")
    assert rows.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


# --- quality ---


def test_quality_keeps_trusted_and_drops_junk(spark):
    docs = corpus(spark).unionByName(spark.createDataFrame([(500, "ZQ!! #%$ QZ!! @@" * 20, "xx"), (501, None, "xx"), (502, "", None), (503, "aba bab", None), (504, "dodo cod", "xx"), (504, "dodo cod", "xx")], DOCS)).withColumn("limit", F.lit(0))
    found = quality.judged(docs, spark.range(0, 100).withColumnRenamed("id", "doc_id"))
    kept = {r.doc_id for r in found.where("kept").collect()}
    assert found.count() == docs.count()
    assert 500 not in kept and {501, 502, 503, 504} <= kept and len(set(range(100)) - kept) <= 1


def test_quality_of_an_empty_table_and_a_very_long_text(spark):
    docs, trusted = corpus(spark), spark.range(0, 100).withColumnRenamed("id", "doc_id")
    assert quality.judged(docs.where("doc_id < 0"), trusted).count() == 0
    long = docs.unionByName(spark.createDataFrame([(800, "aba bab " * 90_000, "xx"), (801, "Z#!?" * 150_000, "xx"), (None, "aba bab", "xx"), (None, "#?" * 40, "xx")], DOCS))  # over a chunk of bytes
    found = quality.judged(long, trusted).where("doc_id is null or doc_id >= 800").collect()
    assert sorted(((str(r.doc_id), r.kept) for r in found)) == [("800", True), ("801", False), ("None", False), ("None", True)]


def test_quality_probabilities_sum_to_one(spark):
    model = quality.fit(corpus(spark)).toPandas().sort_values("key")
    symbols = np.arange(quality.SYMBOLS)
    for context in ("aba", "od ", "zzz", "  a"):
        code, _ = quality.codes([context + "a"])
        every = (code[-1] >> quality.BITS << quality.BITS) | symbols
        p = np.exp(quality.log_probabilities(every, model["key"].to_numpy(), model["share"].to_numpy(), model["left"].to_numpy()))
        assert abs(p.sum() - 1) < 1e-6


def test_quality_joins_equal_the_whole_model(spark):
    docs = corpus(spark, 60).repartition(5, "doc_id").unionByName(spark.createDataFrame([(901, None, "xx"), (902, "", None), (903, "\u00dc\U0001f600 7", "zz")], DOCS))
    model = quality.fit(corpus(spark, 30, 1))
    table = model.toPandas().sort_values("key")
    got = {r.doc_id: (r.total, r.n) for r in quality.scores(docs, model).collect()}
    for r in docs.collect():
        code, _ = quality.codes([r.text])
        want = -quality.log_probabilities(code, table["key"].to_numpy(), table["share"].to_numpy(), table["left"].to_numpy()).sum()
        assert got[r.doc_id][1] == len(r.text or "") and abs(got[r.doc_id][0] - want) < 1e-6 * max(1, want)


def test_quality_counts_equal_brute_force(spark):
    texts = ["abc \u00c9\u00e9\n1", None, "", "ab", "abc"]
    got = {r.code: r.n for r in quality.counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    want: dict = {}
    for t in texts:
        s = [quality.START] * 3 + [int(quality.symbols_of()[ord(c)]) for c in t or ""]
        for i in range(3, len(s)):
            code = sum(s[i - j] << (quality.BITS * j) for j in range(4))
            want[code] = want.get(code, 0) + 1
    assert got == want


def test_quality_limit_is_the_language_quantile(spark):
    rows = [("xx", 1 + i / 1000) for i in range(200)] + [("yy", 3.0)]
    got = {r.lang: r for r in quality.limits(spark.createDataFrame(rows, "lang string, log_perplexity double")).collect()}
    assert got["xx"].n == 200 and abs(got["xx"].limit - 1.198) < 0.0015 and got["yy"].limit == 3 and abs(got[None].limit - 1.198) < 0.0015


@needs_data
def test_quality_rejects_the_labelled_junk(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = {r.quality: (r.n, r.kept) for r in quality.op2_quality(spark, DATA).join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
    print("quality: (documents, kept)", kept)
    assert kept[0][1] == 0 and kept[1][1] >= 0.97 * kept[1][0]


def test_quality_without_trusted_text(spark):
    found = quality.judged(corpus(spark, 5), spark.range(0).withColumnRenamed("id", "doc_id"))
    assert found.where("kept").count() == 5 and found.where("log_perplexity is not null").count() == 0


# --- toxicity ---


def test_toxicity_learns_a_word_in_long_texts(spark):
    draw = random.Random(0)
    rows = []
    for i in range(300):
        w = [draw.choice(WORDS["xx"] + WORDS["yy"]) for _ in range(draw.randrange(3, 200))]
        if i % 3 == 0:
            w[draw.randrange(len(w))] = draw.choice(["BADWORD", "badwords", "Badly"])
        rows.append((i, " ".join(w), "xx"))
    docs = spark.createDataFrame(rows, DOCS).withColumn("toxic", F.lit(9))
    labels = spark.range(300).selectExpr("id as doc_id", "int(id % 3 = 0) as toxic")
    model = toxicity.fit(docs.drop("toxic"), labels)
    scored = toxicity.score(docs, model).join(labels, "doc_id").where(samples.remainder("doc_id", 5) == 0)
    assert scored.select(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int"))).first()[0] > 0.9
    odd = spark.createDataFrame([(1, None, None), (2, "", "xx"), (3, "12 34", None)], DOCS)
    assert all(0 <= r.score < 0.5 for r in toxicity.score(odd, model).collect())
    assert toxicity.clean(docs, model).columns == docs.columns


def toxic_model(seed=0):
    draw = np.random.default_rng(seed)
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    real = lambda *shape: draw.normal(0, 0.5, shape).astype(np.float32)
    return toxicity.Model(0.5, real(toxicity.BUCKETS, toxicity.DIM), real(toxicity.BUCKETS, toxicity.DIM), [real(k, toxicity.DIM, toxicity.FILTERS) for k in toxicity.WIDTHS], real(n), real(n), 0.1)


def plain_logit(m, words, heads):
    """Every filter at every place, one number at a time; a window may reach beyond the text, where all is zero."""
    x = [m.words[w].astype(float) + m.heads[h] for w, h in zip(words, heads)] + [np.zeros(toxicity.DIM)] * toxicity.PAD
    total, f = m.shift, 0
    for weights in m.filters:
        for j in range(toxicity.FILTERS):
            best = max(sum(float(x[i + k] @ weights[k][:, j]) for k in range(len(weights))) + m.bias[f] for i in range(len(words)))
            total += max(best, 0) * m.out[f]
            f += 1
    return total


def drawn_texts(seed, n):
    draw = np.random.default_rng(seed)
    return [(draw.integers(1, 40, k).astype(np.int32), draw.integers(1, 40, k).astype(np.int32)) for k in draw.integers(1, 9, n)]


def test_toxicity_scores_equal_a_plain_convolution():
    m, texts = toxic_model(), drawn_texts(1, 12)
    got = m.logits(*toxicity._together(texts))
    assert np.allclose(got, [plain_logit(m, *t) for t in texts], rtol=1e-4, atol=1e-4)


def test_toxicity_gradients_equal_differences():
    m, texts = toxic_model(2), drawn_texts(3, 5)
    labels, weight = np.array([1, 0, 1, 0, 0], np.float32), np.array([1, 2, 0.5, 1, 1])
    _, steps, slope = toxicity.gradients(m, texts, labels, weight)

    def loss():
        p = 1 / (1 + np.exp(-np.array([plain_logit(m, *t) for t in texts])))
        return -(weight * np.log(np.where(labels == 1, p, 1 - p))).sum() / len(texts)

    draw = np.random.default_rng(5)
    for table, (where, g) in zip([m.words, m.heads, *m.filters, m.bias, m.out], steps, strict=True):
        rows = where if isinstance(where, np.ndarray) else np.arange(len(table))
        for _ in range(12):
            k = int(draw.integers(len(rows)))
            at = (rows[k], *(int(draw.integers(d)) for d in table.shape[1:]))
            old = table[at]
            table[at] = old + 1e-3
            high = loss()
            table[at] = old - 1e-3
            low = loss()
            table[at] = old
            assert abs((high - low) / 2e-3 - g[(k, *at[1:])]) < 2e-3
    m.shift += 1e-3
    high = loss()
    m.shift -= 2e-3
    assert abs((high - loss()) / 2e-3 - slope) < 1e-3


def test_toxicity_of_repeated_and_very_long_texts(spark):
    m = toxic_model(6)
    m.languages, m.thresholds = np.zeros((toxicity.BUCKETS, 1), np.float32), np.zeros(2, np.float32)
    long = " ".join(f"word{i % 977}" for i in range(150_000))  # over two chunks of bytes
    df = spark.createDataFrame([(1, long, None), (2, "some words", None), (2, "some words", None), (None, "some words", None)], DOCS)
    got = sorted((str(r.doc_id), r.score) for r in toxicity.score(df, m).collect())
    raw = np.frombuffer(long.encode(), np.uint8)
    words, heads, first = toxicity.features(raw, np.array([0, len(raw)]))
    assert len(got) == 4 and got[1] == got[2] and got[1][1] == got[3][1]
    assert abs(got[0][1] - 1 / (1 + math.exp(-min(30, max(-30, float(m.logits(words, heads, first)[0])))))) < 1e-6


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_toxicity_held_out_accuracy(spark):
    """About a twentieth of the documents labelled as toxic hold no such word."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null")
    found = toxicity.op4_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"))
    right = {r.toxic: r.right for r in found.collect()}
    print("toxicity held out:", right)
    assert right[0] >= 0.98 and right[1] >= 0.88


def test_toxicity_without_one_of_the_classes(spark):
    docs = corpus(spark, 20)
    none = toxicity.fit(docs, spark.range(20).selectExpr("id as doc_id", "0 as toxic"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.where("doc_id < 0"), none).count() == 0


# --- archives ---


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip_and_look_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 3)
    rows = [(3, "http://b.example.com/x", "same"), (1, "https://www.B.example.com:443/x#f", "same"), (2, None, None), (7, "http://a.org", ""), (9, "http://u@é.net/?q=1\r\n", "é\r\n\r\n日"), (9, "http://again", "é\r\n\r\n日"), (None, "http://none", "z")]
    rows += [(100 + i, f"http://h{i}.net/", "hot") for i in range(20)] + [(50, "http://twice", "p"), (50, "http://twice", "q")]
    df = pages(spark, rows).withColumn("key", F.lit(1)).withColumn("offset", F.lit(1))
    folder = f"file://{tmp_path}/w"
    parts = warc.write_index(warc.write_archives(df, folder, archive_rows=4), folder, block_entries=3)
    got = warc.fetch(df, parts).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows)
    first: dict = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for r in got:
        texts = [h or "" for i, _, h in rows if i == r.page_id]
        text = next(t for t in texts if base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() == r.payload_digest)
        assert r.payload_bytes == len(text.encode())
        if r.page_id is not None:
            assert (r.record_type, r.refers_to) == (("response", None) if first[text] == r.page_id else ("revisit", first[text]))
    found = warc.lookup(parts, "com,example,b)/x")
    assert [f["page_id"] for f in found] == [1, 3] and found[0]["payload"] == b"same"
    assert [f["page_id"] for f in warc.lookup(parts, "twice)/")] == [50, 50] and warc.lookup(parts, "nowhere") == []
    with pytest.raises(Exception, match="no record"):
        warc.fetch(pages(spark, [(3, "http://elsewhere", "")]), parts).collect()


@pytest.mark.parametrize("seed", range(3))
def test_index_bisection_equals_a_scan(spark, tmp_path, seed):
    draw = random.Random(seed)
    entries = sorted(((draw.choice("abcé日") * draw.randrange(1, 4), draw.choice([None, *range(-2, 3)]), "x", i, 1) for i in range(200)), key=lambda e: warc._place(*e[:2]))
    df = spark.createDataFrame(entries, "key string, page_id long, archive string, offset long, length long")
    index = warc.Index([tuple(r) for r in warc.write_index(df.repartition(3), f"file://{tmp_path}/i", block_entries=4).collect()])
    for key, page_id, *_ in entries + [("aa", 9, "x", 0, 1), ("zzz", 0, "x", 0, 1), ("", None, "x", 0, 1)]:
        place = warc._place(key, page_id)
        assert sorted(e[3] for e in index.between(place, place)) == sorted(e[3] for e in entries if e[:2] == (key, page_id))
        assert sorted(e[3] for e in index.between((key, False, 0), (key, True, 1 << 63))) == sorted(e[3] for e in entries if e[0] == key)


def test_archives_threshold_and_nothing(spark, tmp_path):
    df = pages(spark, [(1, "http://a", "x"), (2, "http://b", "x")])
    d = warc.write_index(warc.write_archives(df, f"file://{tmp_path}/a", min_bytes=2), f"file://{tmp_path}/a")
    assert {r.record_type for r in warc.fetch(df, d).collect()} == {"response"}
    none = df.where("page_id < 0")
    e = warc.write_index(warc.write_archives(none, f"file://{tmp_path}/b"), f"file://{tmp_path}/b")
    assert warc.fetch(none, e).count() == 0 and warc.lookup(e, "a)/") == []


# --- nearest neighbours ---


def brute5(rows, k):
    ok = {i: v for i, v in rows if v and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q in sorted(i for i in ok if i % 2 == 0):
        best = sorted((-math.fsum(a * b for a, b in zip(ok[q], ok[c], strict=True)), c) for c in ok if c != q)[:k]
        out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return out


def test_neighbours_with_odd_vectors_and_copies(spark):
    nan = float("nan")
    rows = [(0, None), (1, []), (2, [0.0, 0.0, 0.0]), (3, [1.0, nan, 0.0]), (4, [1.0, None, 2.0]), (5, [1.0, 2.0]), (6, [float("inf"), 0.0, 1.0])]
    rows += [(10 + i, [1.0, 0.5, 0.25]) for i in range(9)] + [(30 + i, [float(i), 1.0, -1.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("label", F.lit(None).cast("int"))
    got = sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 2 == 0, k=4).collect())
    assert got == brute5(rows, 4)
    assert ann.nearest(df.where("vec_id < 0"), F.col("vec_id") % 2 == 0).count() == 0


def test_neighbours_of_equal_score_have_the_smallest_ids(spark, monkeypatch):
    """199 different vectors of one inner product with the query, in more than one leaf and chunk."""
    monkeypatch.setattr(ann, "MEMBER_CHUNK", 30)
    monkeypatch.setattr(ann, "PAIRS", 50)
    draw = np.random.default_rng(3)
    x = draw.integers(-8, 9, (200, 64)).astype(float)
    x[:, 0] = 3
    x[0] = np.eye(64)[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") == 0, leaf_rows=40, recall=1.0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(i, i, 3.0) for i in range(1, 21)]


def test_neighbour_products_equal_brute_force():
    draw = np.random.default_rng(4)
    a, b = draw.integers(-1, 2, (30, 8)).astype(float), draw.integers(-1, 2, (300, 8)).astype(float)
    got = np.full((30, 300), -np.inf)
    for i, j, exact in ann._products(a, b, 5):
        got[i, j] = exact
    for i in range(30):
        want = sorted(a[i] @ b.T)[-5:]
        assert sorted(got[i])[-5:] == want and (got[i] >= want[0]).sum() == (a[i] @ b.T >= want[0]).sum()


@pytest.mark.parametrize("kind", ["even", "one long", "mixed", "clustered", "deep"])
def test_neighbours_recall_at_default_settings(spark, monkeypatch, kind):
    leaf_rows = ann.LEAF_ROWS
    if kind == "deep":  # three levels are fitted on the sample, four more part by part
        monkeypatch.setattr(ann, "SAMPLE", 70)
        leaf_rows = 50
    draw = np.random.default_rng(2)
    x = draw.normal(size=(6_000, 64))
    if kind in ("clustered", "deep"):
        x = draw.normal(size=(60, 64))[draw.integers(0, 60, len(x))] + 0.2 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "one long":
        x[7] *= 20
    elif kind == "mixed":
        x *= draw.lognormal(sigma=0.5, size=(len(x), 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, leaf_rows=leaf_rows).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & set([c for c in np.argsort(-(x @ x[q]), kind="stable")[:21] if c != q][:20])) / 20 for q in got])
    print("recall:", kind, recall)
    assert recall >= 0.92 and len(got) == 300


# --- chats ---


@pytest.mark.parametrize("text", ["", "\\", "<|turn|>", "</s>[INST] ok [/INST]", "<\\|", "a\\\\b<|x|>", "[\\INST]", "<<SYS>>\\<</SYS>>"])
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text) and "|>" not in chat.escape(text) and not any(f in chat.escape(text) for f in chat.FOREIGN)
    assert [(r, t) for r, t, _ in chat.read(chat.render("a|>", text) + chat.render("b", text))] == [("a|>", text), ("b", text)]


def test_events_fold_into_messages(spark):
    log = [
        (1, 1, "m1", "message", "user", "hi"), (1, 2, "m2", "message", "assistant", ""), (1, 3, "m2", "delta", "assistant", "he"), (1, 4, "m2", "delta", "assistant", "llo"),
        (1, 5, "m1", "edit", "user", "hi!"), (1, 6, "m2", "regenerate", "assistant", None), (1, 7, "m2", "delta", "assistant", "bye"), (1, 8, "m3", "message", "user", "x"), (1, 9, "m3", "delete", None, None),
        (2, 1, "n1", "delta", None, "alone"), (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, msg_id string, kind string, role string, text string")
    got = sorted(((r.conv_id, r.ord.seq, r.role, r.text) for r in chat.messages(df).collect()), key=str)
    assert got == sorted([(1, 1, "user", "hi!"), (1, 2, "assistant", "bye"), (2, 1, "", "alone"), (None, None, "", "")], key=str)
    assert chat.messages(df.where("seq < 0")).count() == 0


def test_chat_digests_equal_brute_force(spark):
    rows = [(1, 2, "assistant", "B</s>"), (1, 1, "user", None), (1, 2, "assistant", "B</s>"), (1, None, "system", "s\\"), (2, 1, "user", "é"), (3, 1, "assistant", "日")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).withColumn("msg_id", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.formatted(chat.messages(chat.logged(df)))).collect()}
    for c in (1, 2, 3):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in own)
        text = "".join(chat.render(r[2], r[3] or "") for r in own)
        assert tuple(got[c])[1:] == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))


def test_logged_turns_are_streamed_edited_and_regenerated(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], "x" * (t % 5) + f"é{c}</s>日{t}") for c in range(30) for t in range(6)] + [(1, 2, "user", ""), (1, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.logged(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = chat.messages(log.repartition(5)).select("conv_id", "ord.seq.turn", "role", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(c, t, r or "", x or "") for c, t, r, x in rows], key=str)
    # An edit comes after the next turn has begun.
    assert log.where("kind = 'edit' and seq.turn > msg_id.turn").count() == log.where("kind = 'edit' and seq.turn is not null").count() > 0


# --- pipeline ---


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage on its predecessor's rows: scores and limits from the models alone, links of all pairs, windows one by one, the tokeniser's library."""
    import corpus_pipeline as cp
    from test_texts import brute8, brute9, library_tokens, words8

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = [(None, "No id and nothing like it anywhere: plain quick words, kept by all."), (None, None), (10**9, "")]
    now = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    stages = dict(cp.STAGES)

    def run(name):
        nonlocal now
        before = now.collect()
        now = spark.createDataFrame(stages[name](spark, now, SMALL).collect(), now.schema)
        return before, now.collect()

    key = lambda r: (str(r.doc_id), r.text or "")
    before, after = run("toxicity")
    model = toxicity.fit(spark.createDataFrame(before, docs.schema), spark.read.parquet(f"{SMALL}/labels.parquet"))
    raw = [(r.text or "").encode() for r in before]
    score = model.scores(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert sorted(map(key, after)) == sorted(key(r) for r, s in zip(before, score) if s < 0.5)
    before, after = run("quality")
    judged = quality.judged(spark.createDataFrame(before, docs.schema), quality.trusted_ids(spark, SMALL)).where("not kept").collect()
    gone = {r.doc_id for r in judged} - {None}
    assert sorted(map(key, after)) == sorted(key(r) for r in before if r.doc_id not in gone)
    before, after = run("near-duplicates")
    before = sorted((r for r in before if r.doc_id is not None), key=lambda r: r.doc_id)
    kept = [key(r) for r, (_, _, k) in zip(before, brute9([r.text for r in before], 5)) if k]
    assert sorted(key(r) for r in after if r.doc_id is not None) == sorted(kept) and sum(r.doc_id is None for r in after) == 2
    before, after = run("decontamination")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hit = list(brute8([r.text for r in before], items, 10))
    left = {key(r)[0]: len(words8(r.text)) for r in after if r.doc_id is not None}
    assert left == {str(r.doc_id): n - h for r, (n, h, *_) in zip(before, hit) if r.doc_id is not None} and len(after) == len(before)
    assert {key(r) for r, x in zip(before, hit) if not x[4]} <= set(map(key, after))
    tokens = stages["encoding"](spark, now, SMALL).collect()
    tiktoken = library_tokens()
    assert sorted((str(r.doc_id), r.ids) for r in tokens) == sorted((str(r.doc_id), tiktoken.encode_ordinary(r.text or "")) for r in after)
    assert all(r.n_tokens == len(r.ids) for r in tokens)


@needs_data
def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tables, now = [], docs
    for _, stage in cp.STAGES[:-1]:
        now = stage(spark, now, DATA).persist()
        assert now.columns == docs.columns
        tables.append({r.doc_id: r.text for r in now.select("doc_id", "text").collect()})
    clean = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    assert len(clean & tables[1].keys()) >= 0.9 * len(clean)
    assert set(tables[3]) == set(tables[2]) < set(tables[1]) < set(tables[0])
    last = cp.STAGES[-1][1](spark, now, DATA)
    assert {r.doc_id for r in last.select("doc_id").collect()} == set(tables[3])

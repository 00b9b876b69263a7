"""Language-model scores against a plain model, and the trie's levels against sorted arrays."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import lm
from spanloom.llm.trie import EliasFano, Trie, quantised, restored


def tokens(t):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


class Plain:
    def __init__(self, texts):
        self.c1, self.c2, self.c3, self.follow2, self.follow3 = Counter(), Counter(), Counter(), defaultdict(Counter), defaultdict(Counter)
        self.single = Counter()
        for t in texts:
            x = ["<s>", *tokens(t), "</s>"]
            self.single.update(x[1:])
            for a, b in zip(x, x[1:]):
                self.follow2[a][b] += 1
            for a, b, c in zip(x, x[1:], x[2:]):
                self.follow3[a, b][c] += 1
        self.n, self.v = sum(self.single.values()), len(self.single)

    @staticmethod
    def discount(n):
        return lm.DISCOUNTS[min(n, 3) - 1] if n else 0.0

    def p1(self, w):
        return (self.single[w] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def level(self, follow, w, lower):
        total = sum(follow.values())
        if not total:
            return lower
        return (follow[w] - self.discount(follow[w])) / total + sum(map(self.discount, follow.values())) / total * lower

    def score(self, t):
        x = ["<s>", *tokens(t), "</s>"]
        base = full = 0.0
        for i in range(1, len(x)):
            p = self.p1(x[i])
            base += math.log10(p)
            p = self.level(self.follow2.get(x[i - 1], Counter()), x[i], p)
            if i > 1:
                p = self.level(self.follow3.get((x[i - 2], x[i - 1]), Counter()), x[i], p)
            full += math.log10(p)
        return len(x) - 1, sum(w in self.single for w in x[1:]), base, full


def corpus(n, seed=3):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "the", "é", "日本", "x" * 300]
    texts = [" ".join(draw.choices(vocabulary, [1 / (i + 1) for i in range(65)], k=draw.randrange(40))) for _ in range(n)]
    return texts + ["", None, " \n\t", "the the the the", "never seen words here", "hot " * 30_000, "hot a hot b hot c", texts[0], texts[0]]


def rows_of(texts, learnt):
    return [(i, t, learnt(i)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block,shard,hot", [(16 << 20, 24 << 20, 500), (600, 2_000, 8), (1, 30_000, 3)])
def test_same_as_a_plain_model(spark, monkeypatch, block, shard, hot):
    texts = corpus(60)
    rows = [*rows_of(texts, lambda i: i % 5 != 1), (7, texts[7], False), (None, "the w1 w2", None)]
    for name, value in (("SHARD_BYTES", shard), ("SAMPLED", 1), ("BLOCK_BYTES", block), ("HOT", hot)):
        monkeypatch.setattr(lm, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3, "doc_id").withColumn("n", F.lit(1)).withColumn("score", F.lit("x"))
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/lm-{block}")
    got = lm.scored(spark.read.parquet(path)).collect()
    model = Plain([t for _, t, x in rows if x in (True, None)])
    assert len(got) == len(rows)
    want = sorted((model.score(t)[:3] for _, t, _ in rows), key=repr)
    for r, w in zip(sorted(((r.n_tokens, r.n_known, r.base_score) for r in got), key=repr), want, strict=True):
        assert r[:2] == w[:2] and r[2] == pytest.approx(w[2], rel=1e-9)
    assert {r.train_tokens for r in got} == {model.n}
    by_id = {r.doc_id: r for r in got if r.doc_id not in (7,)}
    for i, t, _ in rows:
        if i != 7:
            n, _, _, full = model.score(t)
            assert by_id[i].score == pytest.approx(full, abs=0.002 * n + 1e-9) and by_id[i].score <= full + 1e-9


def test_nothing_learnt_and_an_empty_table(spark):
    rows = [(1, "a b", False), (2, None, False)]
    got = lm.scored(spark.createDataFrame(rows, "doc_id long, text string, learn boolean")).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert lm.scored(spark.createDataFrame([], "doc_id long, text string, learn boolean")).count() == 0


def test_the_model_beats_single_words_on_held_out_text(spark):
    draw = random.Random(5)
    after = {i: draw.sample(range(50), 3) for i in range(50)}

    def text():
        w, out = draw.randrange(50), []
        for _ in range(30):
            out.append(f"w{w}")
            w = draw.choice(after[w])
        return " ".join(out)

    df = spark.createDataFrame([(i, text(), i % 5 != 1) for i in range(400)], "doc_id long, text string, learn boolean")
    got = [r for r in lm.scored(df).collect() if not r.learn]
    assert all(r.score > r.base_score for r in got)


def test_tries_of_shards_hold_the_counts_and_can_be_mapped(spark, tmp_path, monkeypatch):
    texts = ["a b c", "a b d", "a x", "b c"]
    df = spark.createDataFrame(rows_of(texts, lambda i: True), "doc_id long, text string, learn boolean")
    monkeypatch.setattr(lm, "SHARD_BYTES", 8)
    found = Counter()
    hashes = {w: lm.words_of(__import__("pyarrow").array([w]))[0] for w in "abcdx"}
    for r in lm.tries(df).collect():
        (path := tmp_path / str(r.shard)).write_bytes(r.image)
        trie = Trie.open(str(path))
        for u in "abcdx":
            at = trie.first(hashes[u])
            found[u] += int(trie.count[at[0]]) if at[0] >= 0 else 0
            for v in "abcdx":
                top = np.uint64(64 - 32)
                pair = trie.child(0, at, hashes[v] >> top)
                assert (pair == trie.child(0, at, hashes[v] >> top, sweep=True)).all()
                for w in "abcdx":
                    triple = trie.child(1, pair, hashes[w] >> top)
                    assert (triple == trie.child(1, pair, hashes[w] >> top, sweep=True)).all()
                    found[u + v + w] += int(triple[0] >= 0)
    assert {k: n for k, n in found.items() if n} == {"a": 3, "b": 3, "c": 2, "d": 1, "x": 1, "abc": 1, "abd": 1}


@pytest.mark.parametrize("n", [0, 1, 2, 70, 3_000])
@pytest.mark.parametrize("top", [1, 200, 2**20, 2**40, 2**64 - 1])
def test_elias_fano_equals_a_sorted_array(n, top):
    draw = np.random.default_rng(n)
    values = np.sort(draw.integers(0, top, n, dtype=np.uint64, endpoint=True))
    coded = EliasFano(*EliasFano.arrays(values))
    assert (coded.all() == values).all()
    if n:
        i = draw.integers(0, n, 200)
        x = np.concatenate([draw.integers(0, top, 200, dtype=np.uint64, endpoint=True), values[i]])
        assert (coded.access(i) == values[i]).all() and (coded.successor(x) == np.searchsorted(values, x)).all()
        assert sum(a.nbytes for a in EliasFano.arrays(values)) <= 200 + n * (2 + math.log2(max(2, top / n)) + 3) / 8 * 1.3


def test_codes_round_down_a_little():
    p = np.random.default_rng(1).random(10_000) ** 8
    back = restored(quantised(p))
    assert (back <= p * (1 + 1e-9)).all() and (back[p > 1e-18] >= p[p > 1e-18] * 0.999).all()
    assert restored(quantised(np.array([0.0, 1.0]))).tolist() == [0.0, 1.0]

"""Very long texts through the operators whose other tests have short ones."""

import base64
import hashlib
import random

import pytest

from spanloom.llm import chat, divergence, langid, lm, neardup, warc

LONG = 300_000  # words


@pytest.fixture(scope="module")
def long_text():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(5_000)]
    return " ".join(draw.choice(words) for _ in range(LONG))


def test_languages_of_very_long_texts(spark):
    draw = random.Random(1)
    words = {"xx": ["aba", "bab", "abba", "baab"], "yy": ["cod", "doc", "ocdo", "dodo"]}
    text = lambda k, n: " ".join(draw.choice(words[k]) for _ in range(n))
    docs = spark.createDataFrame([(i, text(k, 20), k) for i in range(100) for k in words] + [(900, text("xx", LONG), "xx")], "doc_id long, text string, lang string")
    models = langid.fit(docs)
    odd = spark.createDataFrame([(1, text("xx", LONG)), (2, text("yy", LONG)), (2, text("yy", LONG)), (3, "12 " * LONG)], "doc_id long, text string")
    assert sorted((r.doc_id, r.lang_pred) for r in langid.identify(odd, models).collect()) == [(1, "xx"), (2, "yy"), (2, "yy"), (3, "und")]


def test_archives_of_very_long_pages(spark, tmp_path, long_text):
    rows = [(1, "http://a.net", long_text), (2, "http://b.net", long_text), (2, "http://b.net", long_text), (3, "http://c.net", long_text + "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    got = warc.fetch(df, warc.write_index(warc.write_archives(df, folder), folder)).collect()
    digest = {i: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for i, _, h in rows}
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in got) == sorted((i, len(h.encode()), digest[i], "response" if i in (1, 3) else "revisit") for i, _, h in rows)


def test_chats_with_very_long_turns(spark, long_text):
    rows = [(1, 1, "user", long_text), (1, 2, "assistant", long_text + "</s>"), (1, 3, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.digests(chat.formatted(chat.messages(chat.logged(df)))).collect()[0]
    loss = rows[1][3]
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (3, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in rows).encode()).hexdigest()


def test_near_duplicates_of_very_long_texts(spark, long_text):
    words = long_text.split()
    near = " ".join(w if i % 60 else "other" for i, w in enumerate(words))
    far = " ".join(w if i % 3 else "other" for i, w in enumerate(words))
    df = spark.createDataFrame([(5, long_text), (3, near), (9, far), (7, long_text), (7, long_text), (8, "short text here now")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(df, 4).collect()}
    assert got == {(5, 3), (3, 3), (7, 3), (9, 9), (8, 8)}


def test_counts_of_very_long_texts(spark, long_text):
    df = spark.createDataFrame([("en", "a", long_text), ("en", "b", "w w")], "lang string, source string, text string")
    got = {(r.source, r.part, r.item) for r in divergence.divergence(df, 1).collect()}
    assert got == {("a", "pair", "b"), ("b", "pair", "a")}  # its one term, w, is all that either has
    docs = spark.createDataFrame([(1, long_text, True), (2, long_text, False), (3, "unseen", False)], "doc_id long, text string, learn boolean")
    found = {r.doc_id: r for r in lm.scored(docs).collect()}
    assert found[1].n_tokens == found[2].n_tokens == found[1].n_known == found[1].train_tokens == LONG + 1
    assert found[1].score == pytest.approx(found[2].score) and found[1].score > found[1].base_score and found[3].n_known == 1

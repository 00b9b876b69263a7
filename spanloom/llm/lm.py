"""Operator 13: log probabilities of whole texts under an Elias-Fano trie of word n-grams.

The model is interpolated absolute discounting over one to three words:

    p3(w | u v) = share3(u v w) + left3(u v) * p2(w | v)
    p2(w | v)   = share2(v w) + left2(v) * p1(w)
    p1(w)       = (c(w) + 0.5) / (N + 0.5 * (V + 1))

where a share is a count less its discount (``DISCOUNTS``, by count) over its context's
count, and what the discounts take is left to the shorter context. A text is a start
mark, its words and an end. An unseen word has its own share of p1, so each
distribution sums to one (less what rounding codes down takes).

1. Texts go in blocks of some ``BLOCK_BYTES``. A block finds its different windows of
   three words, counts those of learnt texts, and sends each shard its own: first words,
   the words after each and those after each pair, compressed.
2. A shard holds all windows that begin with its words. It builds their trie
   (``trie.py``), then every window that any block sent is looked up in one sweep, and
   each block gets its answers by position. So a frequent window crosses once a block,
   and the counts and the questions are one shuffle.
3. Blocks and answers meet, and every text is summed up there.

A word with more than 1 / ``HOT`` of the (sampled) words is spread over shards by its
second word; its count and what it leaves are then sums over shards, at most some
2 * ``HOT`` rows. Where words stand changes no result but the rounding of codes.
Answers are written, so a lost executor costs its own share again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .batches import PACKED_SQL, blocks, chunks, column, flat, give_back, lower_ascii, mix, packed as packed_rows, record_batch, run_hashes, runs, tidy, unpacked
from .samples import remainder
from .trie import ID_BITS, Trie, build, packed, quantised, restored, views

#: What is taken from a count of 1, 2, and 3 or more.
DISCOUNTS = (0.7, 1.05, 1.35)
BLOCK_BYTES = 8 << 20
#: Bytes of text for each shard.
SHARD_BYTES = 8 << 20
#: A word that begins more than one of so many windows is spread; one of so many rows is looked at to find them.
HOT, SAMPLED = 500, 16
#: Hashes of the marks (below those that words take) and the scale of a spread word's shares.
START, END, AFTER = (np.uint64(x) for x in (1, 2, 3))
SPREAD_SCALE = 2.0**40


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and each text's number of words."""
    data, at = flat(texts)
    low = lower_ascii(data)
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    starts, ends, first = runs(inside, at)
    return np.maximum(run_hashes(low, starts, ends), np.uint64(4)), np.diff(first)


class Block:
    """The windows of a block of texts: different first words, pairs and triples in order of hashes, and where each window of the texts is among them."""

    def __init__(self, hashes: np.ndarray, n_words: np.ndarray):
        # Each text: start, words, end, and one place after the end.
        self.n = n_words + 1
        begin = np.cumsum(n_words + 3) - (n_words + 3)
        stream = np.full(int((n_words + 3).sum()), END)
        stream[begin] = START
        stream[begin + n_words + 2] = AFTER
        is_word = np.ones(len(stream), bool)
        is_word[begin] = is_word[begin + n_words + 1] = is_word[begin + n_words + 2] = False
        stream[is_word] = hashes
        self.vocabulary, self.local = np.unique(stream, return_inverse=True)
        opens = np.ones(len(stream), bool)
        opens[begin + n_words + 1] = opens[begin + n_words + 2] = False
        self.at = np.flatnonzero(opens)  # a window begins at the start and at each word
        size = np.uint64(len(self.vocabulary))
        a, b, c = (self.local[self.at + k].astype(np.uint64) for k in range(3))
        pair, self.pair_of = np.unique(a * size + b, return_inverse=True)
        triple, self.triple_of = np.unique(self.pair_of.astype(np.uint64) * size + c, return_inverse=True)
        self.pair_first, self.pair_second = (x.astype(np.int64) for x in np.divmod(pair, size))
        self.triple_pair, self.triple_third = (x.astype(np.int64) for x in np.divmod(triple, size))

    def shards(self, n_shards: int, spread: np.ndarray) -> np.ndarray:
        """The shard of each pair."""
        first, second = self.vocabulary[self.pair_first], self.vocabulary[self.pair_second]
        is_spread = np.isin(first, spread)
        with np.errstate(over="ignore"):
            return (mix(np.where(is_spread, first * np.uint64(0x9E3779B97F4A7C15) + second, first)) % np.uint64(n_shards)).astype(np.int64)

    def parts(self, n_shards: int, spread: np.ndarray):
        """For each shard that has any: its pairs and its triples, in order."""
        of_pair = self.shards(n_shards, spread)
        of_triple = of_pair[self.triple_pair]
        pairs, triples = np.argsort(of_pair, kind="stable"), np.argsort(of_triple, kind="stable")
        here = np.arange(n_shards + 1)
        p, t = np.searchsorted(of_pair[pairs], here), np.searchsorted(of_triple[triples], here)
        for s in np.flatnonzero(np.diff(p)):
            yield int(s), pairs[p[s] : p[s + 1]], triples[t[s] : t[s + 1]]


def _counts_of(sorted_ids: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal values."""
    first = np.flatnonzero(np.diff(sorted_ids, prepend=-1))
    return np.diff(np.append(first, len(sorted_ids)))


def _least(n: np.ndarray) -> np.ndarray:
    """Counts in the smallest kind that holds them."""
    return n.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if not len(n) or n.max() <= np.iinfo(k).max))


def _press(arrays: list[np.ndarray]) -> tuple[bytes, int]:
    raw = packed(arrays)
    return pa.Codec("zstd", 1).compress(raw, asbytes=True), len(raw)


def _unpress(data, size: int) -> list[np.ndarray]:
    return views(pa.Codec("zstd").decompress(data, size))


_SENT = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("size", pa.int64())])
_SENT_SQL = "shard int, block long, data binary, size long"
_ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("data", pa.binary()), ("size", pa.int64()), ("word", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("given", pa.float64())])
_ANSWER_SQL = "block long, shard int, data binary, size long, word long, n long, known long, given double"


def _of_block(parts: list[pa.RecordBatch]) -> tuple[Block, np.ndarray]:
    """A block of texts and which of its windows are learnt from."""
    found = [words_of(column(p, "text")) for p in parts]
    block = Block(np.concatenate([h for h, _ in found]), np.concatenate([n for _, n in found]))
    learn = np.concatenate([column(p, "learn").to_numpy(zero_copy_only=False) for p in parts]).astype(bool)
    return block, np.repeat(learn, block.n)


def _sent(n_shards: int, spread: np.ndarray):
    def run(batches):
        for number, parts in blocks(batches, BLOCK_BYTES):
            block, learn = _of_block(parts)
            del parts
            count = np.bincount(block.triple_of, learn, len(block.triple_pair)).astype(np.int64)
            for shard, pairs, triples in block.parts(n_shards, spread):
                first = block.pair_first[pairs]
                top = np.uint64(64 - ID_BITS)
                arrays = [
                    block.vocabulary[first[np.flatnonzero(np.diff(first, prepend=-1))]], _least(_counts_of(first)),
                    (block.vocabulary[block.pair_second[pairs]] >> top).astype(np.uint32), _least(_counts_of(block.triple_pair[triples])),
                    (block.vocabulary[block.triple_third[triples]] >> top).astype(np.uint32), _least(count[triples]),
                ]
                data, size = _press(arrays)
                yield record_batch(_SENT, [shard], [number], [data], [size])
            del block, learn, count, pairs, triples, first, arrays  # before the next block is built

    return run


def _discount(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, np.choose(np.clip(n, 1, 3) - 1, DISCOUNTS), 0.0)


class Merged:
    """All windows that blocks sent to a shard, each once, with its count, and where each block's are among them."""

    def __init__(self, sent: list[list[np.ndarray]]):
        firsts, pairs_of, seconds, triples_of, thirds, counts = ([x[i] for x in sent] for i in range(6))
        self.words, word_of = np.unique(np.concatenate(firsts), return_inverse=True)
        pair = np.repeat(word_of.astype(np.uint64), np.concatenate([x.astype(np.int64) for x in pairs_of])) << np.uint64(ID_BITS) | np.concatenate(seconds)
        pair, pair_of = np.unique(pair, return_inverse=True)
        triple = np.repeat(pair_of.astype(np.uint64), np.concatenate([x.astype(np.int64) for x in triples_of])) << np.uint64(ID_BITS) | np.concatenate(thirds)
        triple, triple_of = np.unique(triple, return_inverse=True)
        self.word_of, self.pair_of, self.triple_of = (np.split(of, np.cumsum([len(x) for x in parts])[:-1]) for of, parts in ((word_of, firsts), (pair_of, seconds), (triple_of, thirds)))
        shift, mask = np.uint64(ID_BITS), np.uint64((1 << ID_BITS) - 1)
        self.pair_word, self.second = (pair >> shift).astype(np.int64), pair & mask
        self.triple_pair, self.third = (triple >> shift).astype(np.int64), triple & mask
        self.c3 = np.bincount(triple_of, np.concatenate(counts), len(triple)).astype(np.int64)
        self.c2 = np.bincount(self.triple_pair, self.c3, len(pair)).astype(np.int64)
        self.c1 = np.bincount(self.pair_word, self.c2, len(self.words)).astype(np.int64)
        self.given1 = np.bincount(self.pair_word, _discount(self.c2), len(self.words))
        self.given2 = np.bincount(self.triple_pair, _discount(self.c3), len(pair))

    def image(self, is_spread: np.ndarray) -> bytes:
        """The trie of all that was counted. A spread word's shares are of ``SPREAD_SCALE``, as its count isn't known here."""
        on1, on2, on3 = self.c1 > 0, self.c2 > 0, self.c3 > 0
        over = np.where(is_spread, SPREAD_SCALE, np.maximum(self.c1, 1))
        share2 = (self.c2 - _discount(self.c2)) / over[self.pair_word]
        c2 = np.maximum(self.c2, 1)
        share3 = (self.c3 - _discount(self.c3)) / c2[self.triple_pair]
        pairs_of = np.bincount(self.pair_word[on2], minlength=len(self.words))[on1]
        triples_of = np.bincount(self.triple_pair[on3], minlength=len(c2))[on2]
        left1 = np.where(is_spread, 0.0, self.given1 / np.maximum(self.c1, 1))
        return build(self.words[on1], pairs_of, self.second[on2], triples_of, self.third[on3], self.c1[on1], quantised(left1[on1]), quantised(share2[on2]), quantised((self.given2 / c2)[on2]), quantised(share3[on3]))


def _looked_up(trie: Trie, merged: Merged) -> tuple[np.ndarray, ...]:
    """Of every word, pair and triple: count and code of what the word leaves; codes of the pair's share and what it leaves; code of the triple's share. All 0 where nothing was counted."""
    word = trie.first(merged.words, sweep=True)
    pair = trie.child(0, word[merged.pair_word], merged.second, sweep=True)
    triple = trie.child(1, pair[merged.triple_pair], merged.third, sweep=True)
    get = lambda values, at: np.where(at >= 0, values[np.maximum(at, 0)], 0).astype(values.dtype) if len(values) else np.zeros(len(at), values.dtype)
    return get(trie.count, word), get(trie.left1, word), get(trie.share2, pair), get(trie.left2, pair), get(trie.share3, triple)


def _answered(spread: np.ndarray, with_image: bool):
    def run(key, rows):
        shard, number = key[0].as_py(), rows["block"].to_pylist()
        order = sorted(range(len(number)), key=number.__getitem__)
        sent = [_unpress(rows["data"][i].as_buffer(), rows["size"][i].as_py()) for i in order]
        merged = Merged(sent)
        del sent
        is_spread = np.isin(merged.words, spread)
        image = merged.image(is_spread)
        own = ~is_spread & (merged.c1 > 0)
        out = [(-1, shard, image if with_image else None, len(image), None, int(merged.c1[own].sum()), int(own.sum()), None)]
        for i in np.flatnonzero(is_spread):
            out.append((-1, shard, None, None, int(merged.words[i].view(np.int64)), int(merged.c1[i]), None, float(merged.given1[i])))
        if not with_image:
            count, left1, share2, left2, share3 = _looked_up(Trie(image), merged)
            for k, i in enumerate(order):
                w, p, t = merged.word_of[k], merged.pair_of[k], merged.triple_of[k]
                data, size = _press([_least(count[w]), left1[w], share2[p], left2[p], share3[t]])
                out.append((number[i], shard, data, size, None, None, None, None))
        give_back()
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ANSWER, strict=True)], schema=_ANSWER)

    return run


def _spread_words(rows: DataFrame) -> np.ndarray:
    """Hashes of words that begin more than 1 / HOT of the windows of a sample of rows, and the start mark: at most 2 * HOT."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch, _, _ in chunks(batches, "text"):
            hashes, _ = words_of(column(batch, "text"))
            word, n = np.unique(hashes, return_counts=True)
            often = n * 2 * HOT > len(hashes)  # what has 1 / HOT of all has half of that in some chunks that together hold it
            yield record_batch(schema, pa.array(np.append(word[often], np.uint64(0)).view(np.int64)), pa.array(np.append(n[often], len(hashes))))

    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(SAMPLED)) == 0)
    counts = sample.mapInArrow(tidy(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "word").limit(2 * HOT).collect()
    total = next((r["n"] for r in found if r["word"] == 0), 0)
    return np.array([START, *(np.int64(r["word"]).view(np.uint64) for r in found if r["word"] and r["n"] * HOT > total)], np.uint64)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("learn", F.lit(True)).alias("learn"))


def _plan(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of shards and words that are spread."""
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 2)).first()[0] or 0
    return -(-size // SHARD_BYTES) or 1, _spread_words(rows)


def tries(docs: DataFrame) -> DataFrame:
    """shard and image (see :class:`trie.Trie`) of the model of all learnt texts of ``docs`` (doc_id, text, learn), for use elsewhere."""
    rows = _rows(docs)
    n_shards, spread = _plan(rows)
    sent = rows.where("learn").mapInArrow(tidy(_sent(n_shards, spread)), _SENT_SQL)
    return sent.groupBy("shard").applyInArrow(_answered(spread, True), _ANSWER_SQL).where("word is null").select("shard", F.col("data").alias("image"))


_SCORED = pa.schema([("doc_id", pa.int64()), ("learn", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _block_scores(n_shards: int, spread: np.ndarray, counts: dict[int, tuple[int, float]], n_all: int, n_different: int):
    """Scores of a block's texts from the answers to its windows."""

    def run(docs, answers):
        parts = list(unpacked(docs["docs"]))
        block, _ = _of_block(parts)
        size = len(block.vocabulary)
        count, left1 = np.zeros(size, np.int64), np.zeros(size)
        share2, left2, share3 = np.zeros(len(block.pair_first)), np.zeros(len(block.pair_first)), np.zeros(len(block.triple_pair))
        found = dict(zip(answers["shard"].to_pylist(), range(answers.num_rows), strict=True))
        for shard, pairs, triples in block.parts(n_shards, spread):
            i = found[shard]
            c, l1, s2, l2, s3 = _unpress(answers["data"][i].as_buffer(), answers["size"][i].as_py())
            first = block.pair_first[pairs]
            word = first[np.flatnonzero(np.diff(first, prepend=-1))]
            count[word], left1[word] = c, restored(l1)
            share2[pairs], left2[pairs], share3[triples] = restored(s2), restored(l2), restored(s3)
        at = np.searchsorted(block.vocabulary, spread)
        for k, word in zip(at, spread, strict=True):
            if k < size and block.vocabulary[k] == word:
                n, given = counts.get(int(word.view(np.int64)), (0, 0.0))
                count[k], left1[k] = n, given / max(n, 1)
                own = block.pair_first == k
                share2[own] *= SPREAD_SCALE / max(n, 1)
        seen_word, seen_pair = count > 0, left2 > 0
        n_texts = counts.get(int(START), (0, 0.0))[0]  # each learnt text has one start and one end
        single = np.where(block.vocabulary == END, n_texts, count)
        single_p = (single + 0.5) / (n_all + 0.5 * (n_different + 1))
        # The token that a window's second place holds: alone, after the first place, and after the pair that the window before begins with.
        token = block.local[block.at + 1]
        word = block.local[block.at]
        p = share2[block.pair_of] + np.where(seen_word[word], left1[word], 1.0) * single_p[token]
        inner = np.ones(len(p), bool)
        starts = np.cumsum(block.n) - block.n
        inner[starts] = False
        here = np.flatnonzero(inner)
        before = block.pair_of[here - 1]
        p[here] = share3[block.triple_of[here - 1]] + np.where(seen_pair[before], left2[before], 1.0) * p[here]
        add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has a token
        out = pa.table(
            [
                pa.chunked_array([column(b, "doc_id") for b in parts]), pa.chunked_array([column(b, "learn") for b in parts]), pa.array(block.n),
                pa.array(add((single[token] > 0).astype(np.int64))), pa.array(add(np.log10(single_p[token]))), pa.array(add(np.log10(p))),
            ],
            schema=_SCORED,
        )
        give_back()
        return out

    return run


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text, learn), learning from those whose ``learn`` is true or null.

    Words are what stands between white space, A-Z in lower case; every text has one
    end after its words, so a null or empty text has one token. base_score is the log10
    probability by p1 alone, score by the whole model. Words are compared by 64-bit
    hashes, inside a context by 32 bits of them. Repeated rows are texts of their own,
    other columns are left out, an empty table gives no rows; if nothing is learnt, all
    scores are 0. A text longer than a block is a block. ``docs`` is read several times
    and must give the same partitions: a table, not a random draw.
    """
    rows = _rows(docs)
    n_shards, spread = _plan(rows)
    sent = rows.mapInArrow(tidy(_sent(n_shards, spread)), _SENT_SQL)
    answers = store.written(sent.groupBy("shard").applyInArrow(_answered(spread, False), _ANSWER_SQL), "answers")
    sums = answers.where("block < 0").groupBy("word").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("given").alias("given")).collect()  # a row for each spread word, and one
    counts = {r["word"]: (r["n"], r["given"]) for r in sums if r["word"] is not None}
    n_all = sum(r["n"] for r in sums)
    # The start mark stands for the ends here: there are as many.
    n_different = sum(r["known"] or 0 for r in sums) + sum(n > 0 for n, _ in counts.values())
    texts = rows.mapInArrow(tidy(packed_rows(BLOCK_BYTES)), PACKED_SQL)
    score = _block_scores(n_shards, spread, counts, n_all, n_different)
    out = texts.groupBy("block").cogroup(answers.where("block >= 0").select("block", "shard", "data", "size").groupBy("block")).applyInArrow(score, "doc_id long, learn boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "learn", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, learning from those whose id's checksum modulo 5 isn't 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False))
    out = scored(docs.withColumn("learn", ~held_out))
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op13_lm_scoring": op13_lm_scoring}
ORACLES: dict[str, str] = {}

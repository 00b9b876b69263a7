"""Operator 8: benchmark decontamination with an FM-index per training shard.

A shard is the texts of some ``SHARD_BYTES``. Its words become symbols: a word
that a test phrase uses keeps a number, every other word is a separator, since no
phrase can span it; what lies between separators and is shorter than the shortest
phrase is left out. Over the symbols a suffix array gives the Burrows-Wheeler
transform, kept as a wavelet matrix with rank counts. All phrases are searched
backwards at once, two ranks a level and a step. Occurrences are found by walking
to sampled suffix positions, and their spans merged.

Phrases are a table, made of the items in parallel. ``PHRASES`` of them at most go
to every task. If there are more, each phrase is filed under the one of its words
that the fewest shards hold, a shard gets the phrases filed under its own words,
and texts and phrases meet by shard: the rows are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .batches import PACKED_SQL, blocks, chunks, column, flat, give_back, lower_ascii, packed, record_batch, run_hashes, runs, tidy, unpacked
from .samples import looked_up

WINDOW, SHARD_BYTES, SAMPLE = 10, 2 << 20, 16
#: Phrases (windows of an item, at most ``WINDOW`` hashes of 8 bytes each) that are sent to every task at most.
PHRASES = 300_000


def word_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words (ASCII letters and digits, all else above ASCII), first word of each text."""
    low = lower_ascii(data)
    inside = (low >= 0x80) | ((low >= 0x30) & (low <= 0x39)) | ((low >= 0x61) & (low <= 0x7A))
    return (low, *runs(inside, at))


class Wavelet:
    """A wavelet matrix over symbols below 2 ** bits: rank(symbol, i) counts it in the first i places."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits = len(values), bits
        self.ones, self.zeros = [], []
        level = values
        for b in range(bits - 1, -1, -1):
            bit = (level >> b) & 1
            count = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(self.n - int(count[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        low = np.zeros(len(symbol), np.int64)
        high = i.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            a, b = ones[low], ones[high]
            low = np.where(bit == 1, zeros + a, low - a)
            high = np.where(bit == 1, zeros + b, high - b)
        return high - low

    def access(self, i: np.ndarray) -> np.ndarray:
        at, out = i.astype(np.int64), np.zeros(len(i), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling; only places that are still tied are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = np.diff(text[order]) != 0
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    tied, step = np.flatnonzero(~(fresh & np.append(fresh[1:], True))), 1
    while len(tied):
        own = order[tied]
        follows = np.where(own + step < n, rank[np.minimum(own + step, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + follows
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[tied] = own
        fresh = np.ones(len(tied), bool)
        fresh[1:] = np.diff(key) != 0
        rank[own] = np.maximum.accumulate(np.where(fresh, tied, 0))
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    return order


class FMIndex:
    """Backward search and location over words (symbols from 2) and separators (1); one 0 ends the text."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        self.text = np.append(symbols, 0)
        order = suffix_array(self.text)
        self.n = len(order)
        counts = np.bincount(self.text, minlength=n_symbols)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.bwt = Wavelet(self.text[order - 1], int(n_symbols).bit_length())
        kept = order % sample == 0
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.places = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [from, to) of each phrase; phrases are right-aligned in a table of symbols."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > k) & (high > low))
            if not len(live):
                break
            symbol = phrases[live, phrases.shape[1] - 1 - k]
            low[live] = self.before[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.bwt.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to a sampled one."""
        rows, out, walked = rows.copy(), np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            here = rows[live]
            found = self.kept[here + 1] > self.kept[here]
            done = live[found]
            out[done] = (self.places[self.kept[rows[done]]] + walked[done]) % self.n
            live, here = live[~found], here[~found]
            symbol = self.bwt.access(here)
            rows[live] = self.before[symbol] + self.bwt.rank(symbol, here)
            walked[live] += 1
        return out


_PHRASE = pa.schema([("words", pa.list_(pa.int64())), ("item", pa.string())])


def phrase_table(items: DataFrame, window: int) -> DataFrame:
    """words (64-bit hashes) and item of every different window of each item."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, data, at in chunks(batches, "text"):
            low, starts, ends, first = word_runs(data, at)
            h = run_hashes(low, starts, ends).view(np.int64)
            for name, a, b in zip(column(batch, "item").to_pylist(), first[:-1], first[1:], strict=True):
                own = h[a:b]
                views = np.lib.stride_tricks.sliding_window_view(own, min(window, len(own))) if len(own) else own.reshape(0, 1)
                for k in range(0, len(views), 20_000):
                    part = views[k : k + 20_000]
                    cut = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                    yield record_batch(_PHRASE, pa.ListArray.from_arrays(cut, pa.array(part.ravel())), [name] * len(part))

    return items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(tidy(run), "words array<long>, item string").distinct()


class Phrases:
    """Phrases as a table of symbols, numbered by their words, and the items that hold each."""

    def __init__(self, phrases: pa.Table, window: int):
        words, item = phrases["words"].combine_chunks(), phrases["item"].combine_chunks().dictionary_encode()
        self.ids = [*item.dictionary.to_pylist(), None]
        size = np.diff(words.offsets.to_numpy()) if len(words) else np.zeros(0, np.int64)
        every = words.flatten().to_numpy().view(np.uint64) if len(words) else np.zeros(0, np.uint64)
        self.words = np.unique(every)
        width = int(size.max(initial=1))
        table = np.zeros((len(size), width), np.int32)
        place = np.arange(width)[None, :] - (width - size[:, None])
        table[place >= 0] = np.searchsorted(self.words, every) + 2  # right-aligned, row by row
        # Equal windows are searched once; the items of phrase p are holders[at[p]:at[p + 1]].
        self.table, inverse = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
        order = np.argsort(inverse.ravel(), kind="stable")
        self.holders = item.indices.fill_null(-1).to_numpy()[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(inverse.ravel(), minlength=len(self.table)))])
        self.sizes = np.count_nonzero(self.table, axis=1)
        self.shortest = int(self.sizes.min(initial=window))

    def items(self, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of each phrase, and which of the phrases each stands for."""
        n = self.at[phrase + 1] - self.at[phrase]
        which = np.repeat(np.arange(len(phrase)), n)
        return self.holders[np.repeat(self.at[phrase], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)], which


def hits(h: np.ndarray, first: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Of one shard, given by its words' hashes and each document's first word (n + 1): words that lie in an occurrence, and the different (document, item) pairs as two columns."""
    covered, none = np.zeros(len(h), bool), np.zeros((0, 2), np.int64)
    if not len(h) or not len(phrases.table):
        return covered, none
    at = np.minimum(np.searchsorted(phrases.words, h), len(phrases.words) - 1)
    symbol = np.where(phrases.words[at] == h, at + 2, 1)
    # Stretches of phrase words within one document, as long as a phrase at least.
    document = np.repeat(np.arange(len(first) - 1), np.diff(first))
    edge = np.ones(len(symbol) + 1, bool)
    edge[1:-1] = ((symbol[1:] == 1) != (symbol[:-1] == 1)) | (document[1:] != document[:-1])
    cut = np.flatnonzero(edge)
    long = (symbol[cut[:-1]] > 1) & (np.diff(cut) >= phrases.shortest)
    begin, size = cut[:-1][long], np.diff(cut)[long]
    if not len(begin):
        return covered, none
    # Stretch by stretch with one separator after each.
    total = int((size + 1).sum())
    place = np.cumsum(size + 1) - (size + 1)
    source = np.arange(total) - np.repeat(place, size + 1) + np.repeat(begin, size + 1)
    is_word = np.ones(total, bool)
    is_word[place + size] = False
    source = np.where(is_word, source, 0)
    index = FMIndex(np.where(is_word, symbol[source], 1), len(phrases.words) + 2)
    low_row, high_row = index.search(phrases.table, phrases.sizes)
    n = high_row - low_row
    which = np.repeat(np.arange(len(n)), n)
    if not len(which):
        return covered, none
    rows = np.repeat(low_row, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    found = index.locate(rows)
    length = phrases.sizes[which]
    word = source[found]
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, word, 1)
    np.add.at(change, word + length, -1)
    met = np.unique(np.stack([document[word], which], 1), axis=0)
    item, of = phrases.items(met[:, 1])
    return np.cumsum(change[:-1]) > 0, np.unique(np.stack([met[of, 0], item], 1), axis=0)


class Shard:
    """The words of some pieces of a table: hashes, starts and ends as bytes of their piece, each document's first word. Pieces are hashed one by one, so that no large arrays are held."""

    def __init__(self, pieces: list[pa.RecordBatch]):
        self.pieces, self.starts, self.ends, hashes, first = pieces, [], [], [], [np.zeros(1, np.int64)]
        for piece in pieces:
            low, starts, ends, own = word_runs(*flat(column(piece, "text")))
            hashes.append(run_hashes(low, starts, ends))
            self.starts.append(starts)
            self.ends.append(ends)
            first.append(own[1:] + first[-1][-1])
        self.hashes, self.first = np.concatenate(hashes), np.concatenate(first)


_ROW = pa.schema([("doc_id", pa.int64()), ("doc_row", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
_ROW_SQL = "doc_id long, doc_row long, n_words long, n_hit long, spans array<int>, items array<string>"


def _edges(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and after-last word of each stretch of hit words."""
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _counted(pieces: list[pa.RecordBatch], phrases: Phrases) -> Iterator[pa.RecordBatch]:
    """A shard's rows (doc_id, doc_row, text) as ``_ROW``."""
    shard = Shard(pieces)
    covered, pairs = hits(shard.hashes, shard.first, phrases)
    where: dict[int, list[str]] = {}
    for d, i in pairs.tolist():
        where.setdefault(d, []).extend([phrases.ids[i]] if i >= 0 else [])
    d = 0
    for piece in pieces:
        own = range(d, d := d + piece.num_rows)
        spans = [np.stack(_edges(covered[shard.first[k] : shard.first[k + 1]]), 1).ravel().tolist() if k in where else [] for k in own]
        n_hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        yield record_batch(_ROW, column(piece, "doc_id"), column(piece, "doc_row"), np.diff(shard.first[own.start : own.stop + 1]), n_hit, spans, [where.get(k, []) for k in own])


def removed(raw: bytes, begin: np.ndarray, end: np.ndarray) -> str:
    """The text without the spans; white space that stood on both sides of one stays once."""
    out, at = [], 0
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        out.append(raw[at:a])
        at = b
        while at < len(raw) and raw[at : at + 1].isspace() and (not any(out) or out[-1][-1:].isspace()):
            at += 1
    return b"".join([*out, raw[at:]]).decode()


def _cut(pieces: list[pa.RecordBatch], phrases: Phrases) -> Iterator[pa.RecordBatch]:
    """A shard's rows with the hit words cut from their texts."""
    shard = Shard(pieces)
    covered, pairs = hits(shard.hashes, shard.first, phrases)
    hit, before, words = np.unique(pairs[:, 0]), 0, 0
    for piece, starts, ends in zip(pieces, shard.starts, shard.ends, strict=True):
        own = hit[(hit >= before) & (hit < before + piece.num_rows)]
        if len(own):
            data, at = flat(column(piece, "text"))
            kept = column(piece, "text").to_pylist()
            for d in own.tolist():
                on, off = _edges(covered[shard.first[d] : shard.first[d + 1]])
                a, base = d - before, shard.first[d] - words
                kept[a] = removed(data[at[a] : at[a + 1]].tobytes(), starts[base + on] - at[a], ends[base + off - 1] - at[a])
            yield pa.RecordBatch.from_arrays([pa.array(kept, f.type) if f.name == "text" else column(piece, f.name) for f in piece.schema], schema=piece.schema)
        else:
            yield piece
        before, words = before + piece.num_rows, words + len(starts)


def _filed(rows: DataFrame, keyed: DataFrame, shard_bytes: int) -> DataFrame:
    """block, words and item of the phrases that a shard may hold: those filed under one of its words. A phrase is filed under the word that the fewest shards hold, and nowhere if no shard holds one of its words."""
    schema = pa.schema([("block", pa.int64()), ("word", pa.int64())])

    def run(batches):
        for number, pieces in blocks(batches, shard_bytes):
            words = np.unique(Shard(pieces).hashes).view(np.int64)
            yield record_batch(schema, np.full(len(words), number), words)

    held = rows.mapInArrow(tidy(run), "block long, word long")
    shards = held.groupBy("word").agg(F.count("*").alias("n"))
    each = keyed.select("item", "words", F.explode(F.array_distinct("words")).alias("word"))
    filed = looked_up(each, "word", each.groupBy("word").agg(F.count("*").alias("weight")).join(shards, "word"), each.count())
    best = filed.groupBy("item").agg(F.first("words").alias("words"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("m")).where("m.n > 0")
    return held.join(best.select("item", "words", F.col("m.word").alias("word")), "word").select("block", "words", "item")


def _by_shard(rows: DataFrame, phrases: DataFrame, act: Callable[[list[pa.RecordBatch], Phrases], Iterator[pa.RecordBatch]], schema, window: int, shard_bytes: int) -> DataFrame:
    """``act`` on every shard of ``rows``, with the phrases that it may hold. ``rows`` is read twice and must give the same partitions."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        return pa.Table.from_batches(act(list(unpacked(docs["docs"])), Phrases(found, window)))

    return rows.mapInArrow(tidy(packed(shard_bytes)), PACKED_SQL).groupBy("block").cogroup(_filed(rows, phrases, shard_bytes).groupBy("block")).applyInArrow(run, schema)


def _sent(items: DataFrame, window: int) -> tuple[DataFrame, pa.Table | None]:
    """The phrases as a table, written if they are many, and in memory too if they are few enough."""
    phrases = phrase_table(items, window)
    few = phrases.limit(PHRASES + 1).toArrow()
    return (phrases, few) if few.num_rows <= PHRASES else (store.written(phrases, "phrases"), None)


def _direct(rows: DataFrame, few: pa.Table, act, schema, window: int, shard_bytes: int) -> DataFrame:
    """``act`` on every shard, with all phrases."""
    sent = rows.sparkSession.sparkContext.broadcast(Phrases(few, window))
    give_back()

    def run(batches):
        for _, pieces in blocks(batches, shard_bytes):
            yield from act(pieces, sent.value)

    return rows.mapInArrow(tidy(run), schema)


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Of each row of ``docs``: n_words, n_hit (words in occurrences), spans (first and after-last word of each stretch of them, flat) and items (ids as strings).

    A phrase is ``window`` consecutive words of an item, or all words of a shorter
    one; null and wordless texts have none. Words of items without an id are hit, but no id is listed.
    Rows are numbered, so those of one doc_id stay apart.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("doc_row"), "text")
    phrases, few = _sent(items, window)
    if few is not None:
        return _direct(rows, few, _counted, _ROW_SQL, window, shard_bytes)
    name = F.concat_ws(":", F.xxhash64("words").cast("string"), F.xxhash64(F.lit(1), "words").cast("string"))
    found = _by_shard(rows, phrases.select("words", name.alias("item")).distinct(), _counted, _ROW_SQL, window, shard_bytes)
    # The names of phrases become those of the items that hold them.
    own = found.select("doc_id", "doc_row", "n_words", "n_hit", "spans", F.explode_outer("items").alias("name")).join(phrases.select(name.alias("name"), "item"), "name", "left")
    return own.groupBy("doc_row").agg(*(F.first(c).alias(c) for c in ("doc_id", "n_words", "n_hit", "spans")), F.collect_set("item").alias("items")).select("doc_id", "doc_row", "n_words", "n_hit", "spans", "items")


def counted(found: DataFrame) -> DataFrame:
    """The digest columns of :func:`find`'s rows."""
    items = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with the hit words cut from their texts; n_chars follows where a text changed. Every row and other column stays."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.struct("n_chars", F.length("text").alias("l")))
    phrases, few = _sent(items, window)
    if few is not None:
        out = _direct(docs, few, _cut, docs.schema, window, shard_bytes)
    else:
        name = F.concat_ws(":", F.xxhash64("words").cast("string"), F.xxhash64(F.lit(1), "words").cast("string"))
        out = _by_shard(docs, phrases.select("words", name.alias("item")).distinct(), _cut, docs.schema, window, shard_bytes)
    if "n_chars" in docs.columns:
        changed = F.length("text") != F.col("n_chars.l")
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars.n_chars")))
    return out


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the words of benchmark passages go, the rest of each text stays."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``."""
    return counted(find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The same by a plain join of all windows.
_SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW})::BIGINT AS n, array_to_string(w[k:k + least(len(w), {WINDOW}) - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id::BIGINT AS doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS phrase FROM (SELECT d.r, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) s)),
hit AS (SELECT r, n, k, item_id FROM dw JOIN win USING (n, phrase)),
words AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, n, k FROM hit)) GROUP BY r),
items AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

QUERIES = {"op8_decontam": op8_decontam}
ORACLES = {"op8_decontam": _SQL}

"""Operator 4: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of two hashed rows: one for the word and one for
its first ``PREFIX`` bytes, which inflected forms share. Filters of several
widths slide over the words, and each filter's largest response in the whole text
(max pooling) feeds a logistic layer. It is trained in numpy, on a bounded sample
of labelled documents; gradients reach only the places that won the pooling.

Thresholds are calibrated by language on a part of the sample that isn't trained
on. The language is guessed from the text by word counts of the same buckets, so
no column besides the text enters a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .batches import chunks, column, give_back, hasher, lower_ascii, record_batch, runs, tidy
from .samples import lowest, matched, remainder

#: Labelled documents of each class (label and language) to learn from at most.
SAMPLE = 1_500
#: Words of all of them at most, dealt evenly to the classes; a document of more than 1 / SHORT of its class's share is not learnt from.
SAMPLE_WORDS, SHORT = 8_000_000, 20
BUCKETS, DIM, WIDTHS, FILTERS, PREFIX = 1 << 15, 12, (1, 2, 3), 8, 5
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.08, 7
#: Steps at least: a small sample is gone through more often.
STEPS = 600
#: How many times the share of clean documents that are marked counts against that of toxic ones that are missed, when a threshold is chosen.
CLEAN_WEIGHT = 10
#: Share of words that a training step leaves out, each time others, so that no document is known by its odd words; and the spread of new embeddings.
DROP, SPREAD = 0.5, 0.03
PAD = max(WIDTHS) - 1


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (from 1) of each word and of its beginning, and the first word of each text (n + 1)."""
    low = lower_ascii(data)
    if len(low) > 1:  # capitals among the accented Latin letters
        after = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][after] += np.uint8(0x20)
    starts, ends, first = runs((low >= 0x80) | ((low >= 97) & (low <= 122)), at)
    hashes = hasher(low)
    bucket = lambda h: ((h >> np.uint64(40)) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    return bucket(hashes(starts, ends)), bucket(hashes(starts, np.minimum(ends, starts + PREFIX))), first


def padded(words: np.ndarray, heads: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets with PAD zeros after each text, so that no filter spans two; first place of each text."""
    n = np.diff(first)
    begin = np.concatenate([[0], np.cumsum(n + PAD)])
    place = np.arange(len(words)) + np.repeat(PAD * np.arange(len(n)), n)
    w, h = np.zeros(begin[-1], np.int32), np.zeros(begin[-1], np.int32)
    w[place], h[place] = words, heads
    return w, h, begin


@dataclass
class Model:
    """Weights; ``prior`` alone is the score of every text where one of the classes was not seen."""

    prior: float
    words: np.ndarray | None = None
    heads: np.ndarray | None = None
    filters: list[np.ndarray] | None = None  # of each width, (width, DIM, FILTERS)
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    shift: float = 0.0
    languages: np.ndarray | None = None  # (BUCKETS, languages) log odds
    thresholds: np.ndarray | None = None  # of each language, then of texts without words

    def responses(self, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings and every filter's response at every place."""
        x = self.words[w] + self.heads[h]
        x[w == 0] = 0
        z = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32)
        for k, weights in enumerate(self.filters):
            part = x @ weights[0]
            for j in range(1, len(weights)):
                part[:-j] += x[j:] @ weights[j]
            z[:, k * FILTERS : (k + 1) * FILTERS] = part
        return x, z + self.bias

    def logits(self, words: np.ndarray, heads: np.ndarray, first: np.ndarray) -> np.ndarray:
        w, h, begin = padded(words, heads, first)
        pooled = np.zeros((len(first) - 1, len(self.bias)), np.float32)
        some = np.flatnonzero(np.diff(first) > 0)
        if len(some):
            _, z = self.responses(w, h)
            # Only places of the text itself: what begins behind it would reach into the next one.
            ends = np.stack([begin[some], begin[some] + np.diff(first)[some]], 1).ravel()
            pooled[some] = np.maximum(np.maximum.reduceat(z, ends, axis=0)[::2], 0)
        return pooled @ self.out + self.shift

    def language(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest language of each text by its words; the last number for none."""
        out = np.full(len(first) - 1, self.languages.shape[1])
        some = np.flatnonzero(np.diff(first) > 0)
        if len(some):
            out[some] = np.add.reduceat(self.languages[words], first[some], axis=0).argmax(1)
        return out

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.words is None:
            return np.full(len(at) - 1, self.prior)
        words, heads, first = features(data, at)
        logit = self.logits(words, heads, first) - self.thresholds[self.language(words, first)]
        return 1 / (1 + np.exp(-np.clip(logit.astype(float), -30, 30)))


def _together(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum([len(t[0]) for t in texts])]).astype(np.int64)
    return np.concatenate([t[0] for t in texts]), np.concatenate([t[1] for t in texts]), first


def gradients(m: Model, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray) -> tuple[float, list[tuple], float]:
    """The weighted loss of some texts with words; of each table (words, heads, filters, bias, out) the rows that it depends on and the slope there; the shift's slope.

    Only the places that win the pooling send anything back.
    """
    w, h, begin = padded(*_together(texts))
    x, z = m.responses(w, h)
    best = np.stack([z[a : b - PAD].argmax(0) + a for a, b in zip(begin[:-1], begin[1:], strict=True)])
    top = np.maximum(z[best, np.arange(z.shape[1])], 0)
    p = 1 / (1 + np.exp(-np.clip(top @ m.out + m.shift, -30, 30)))
    loss = float(-(weight * np.log(np.where(labels == 1, p, 1 - p))).sum() / len(texts))
    error = ((p - labels) * weight / len(texts)).astype(np.float32)
    back = (error[:, None] * m.out) * (top > 0)
    slopes = [np.zeros_like(f) for f in m.filters]
    at, push = [], []
    for k, width in enumerate(WIDTHS):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        for j in range(width):
            place = best[:, cols] + j
            slopes[k][j] = np.einsum("bfd,bf->df", x[place], back[:, cols])
            at.append(place.ravel())
            push.append((back[:, cols, None] * m.filters[k][j].T[None]).reshape(-1, DIM))
    at, push = np.concatenate(at), np.concatenate(push)
    real = w[at] > 0  # what stands after a text stays zero
    steps: list[tuple] = []
    for ids in (w[at[real]], h[at[real]]):
        rows, inverse = np.unique(ids, return_inverse=True)
        g = np.zeros((len(rows), DIM), np.float32)
        np.add.at(g, inverse, push[real])
        steps.append((rows, g))
    return loss, steps + [(slice(None), g) for g in (*slopes, back.sum(0), top.T @ error)], float(error.sum())


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], held: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fits the weights on rows that aren't ``held`` and the thresholds on those that are."""
    labels = labels.astype(np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Model(float(labels.max(initial=0)) * 0.999)
    draw = np.random.default_rng(seed)
    m = Model(
        float(labels.mean()),
        draw.normal(0, SPREAD, (BUCKETS, DIM)).astype(np.float32), draw.normal(0, SPREAD, (BUCKETS, DIM)).astype(np.float32),
        [draw.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32), draw.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
    )
    tables = [m.words, m.heads, *m.filters, m.bias, m.out]
    squares = [np.full_like(t, 1e-4) for t in tables]
    shift_square = 1e-4
    rows = np.flatnonzero(~held)
    weight = np.where(labels == 1, 0.5 / max(labels[rows].mean(), 1e-3), 0.5 / max(1 - labels[rows].mean(), 1e-3))
    epochs = max(epochs, -(-STEPS * BATCH // max(1, len(rows))))
    for epoch in range(epochs):
        draw.shuffle(rows)
        rate = RATE / (1 + EPOCHS * epoch / epochs)
        for lo in range(0, len(rows), BATCH):
            own = [r for r in rows[lo : lo + BATCH] if len(texts[r][0])]
            if not own:
                continue
            seen = [(w * keep, h * keep) for w, h in (texts[r] for r in own) for keep in [draw.random(len(w)) >= DROP]]
            _, steps, slope = gradients(m, seen, labels[own], weight[own])
            for table, square, (where, g) in zip(tables, squares, steps, strict=True):
                square[where] += g * g
                table[where] -= rate * g / np.sqrt(square[where])
            shift_square += slope**2
            m.shift -= rate * slope / shift_square**0.5
    names = sorted(set(languages))
    counts = np.full((BUCKETS, len(names)), 0.1)
    for (words, _), language in zip(texts, languages, strict=True):
        np.add.at(counts[:, names.index(language)], words, 1)
    m.languages = np.log(counts / counts.sum(0)).astype(np.float32)
    return calibrated(m, texts, labels, held)


def calibrated(m: Model, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, held: np.ndarray, least: int = 10) -> Model:
    """Thresholds of the best weighted accuracy (``CLEAN_WEIGHT``) on the held rows, by guessed language; all rows' where a class has fewer than ``least``."""
    rows = np.flatnonzero(held)
    m.thresholds = np.zeros(m.languages.shape[1] + 1, np.float32)
    if not len(rows):
        return m
    found = [(m.logits(*p), m.language(p[0], p[2])) for i in range(0, len(rows), 50) for p in [_together([texts[r] for r in rows[i : i + 50]])]]
    logit, language = (np.concatenate([f[k] for f in found]) for k in (0, 1))

    def threshold(own: np.ndarray) -> float | None:
        y, s = labels[rows[own]] == 1, logit[own]
        if min(y.sum(), (~y).sum()) < least:
            return None
        order = np.argsort(s)
        s, y = s[order], y[order]
        gain = CLEAN_WEIGHT * np.cumsum(~y) / (~y).sum() - np.cumsum(y) / y.sum()  # of a cut after each place
        best = np.flatnonzero(gain[:-1] >= gain[:-1].max() - 1e-9)
        return float(np.mean([(s[k] + s[k + 1]) / 2 for k in best]))

    overall = threshold(np.ones(len(rows), bool))
    for k in range(len(m.thresholds)):
        own = threshold(language == k)
        m.thresholds[k] = own if own is not None else overall if overall is not None else 0.0
    return m


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """:func:`_fit`, with the memory of the sample handed back."""
    model = _fit(docs, labels, sample)
    give_back()
    return model


def _fit(docs: DataFrame, labels: DataFrame, sample: int) -> Model:
    """A model of ``labels.toxic`` from at most ``sample`` documents of each class and ``SAMPLE_WORDS`` words; rows whose id's crc32 is 0 modulo 5 are left out. A document with several labels is toxic if one says so."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"))
    rows = ids.join(known, "doc_id").withColumn("class", F.concat_ws(":", F.col("toxic").cast("string"), "lang"))
    chosen = store.written(lowest(rows, "class", sample).select("doc_id", "toxic", "class").distinct(), "chosen")
    taken = matched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("lang")).where("text is not null"), chosen.select("doc_id", "toxic").distinct())
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("lang", pa.string()), ("words", pa.list_(pa.int32())), ("heads", pa.list_(pa.int32()))])

    def run(batches):
        for batch, data, at in chunks(batches, "text"):
            words, heads, first = features(data, at)
            cut = pa.array(first.astype(np.int32))
            yield record_batch(schema, column(batch, "doc_id"), column(batch, "toxic"), column(batch, "lang"), pa.ListArray.from_arrays(cut, pa.array(words)), pa.ListArray.from_arrays(cut, pa.array(heads)))

    seen = taken.mapInArrow(tidy(run), "doc_id long, toxic int, lang string, words array<int>, heads array<int>")
    share = SAMPLE_WORDS // max(1, chosen.select("class").distinct().count())
    order = Window.partitionBy("toxic", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.where(F.size("words") <= share // SHORT).withColumn("total", F.sum(F.size("words")).over(order)).where(F.col("total") <= share).drop("total")
    table = seen.toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    store.drop(chosen)
    texts = [(w.values.to_numpy(), h.values.to_numpy()) for w, h in zip(table["words"], table["heads"], strict=True)]
    held = (np.arange(len(texts)) * 2654435761 % 4) == 0
    return train(texts, table["toxic"].to_numpy(), table["lang"].to_pylist(), held)


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row's whole text; null and wordless texts get the score of no evidence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its tables have fixed sizes

    def run(batches):
        for batch, data, at in chunks(batches, "text"):
            yield record_batch(_OUT, column(batch, "doc_id"), pa.array(sent.value.scores(data, at)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, data, at in chunks(batches, "text"):
            yield batch.filter(pa.array(sent.value.scores(data, at) < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are toxic go."""
    return clean(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}

"""Operator 1: language identification by interpolated Kneser-Ney character models.

Letters are lower-cased, everything else is one separator. N-grams of up to four
symbols are 64-bit codes, and a model's tables are sorted arrays of their hashes,
searched by bisection. The languages share the arrays: one look-up gives the log
probability of a symbol under each, and n-grams that none has seen back off
together. A text goes to the language of the lowest cross-entropy per symbol.

Rejection is calibrated on part of the sample: a text whose cross-entropy under
its best language is above what nearly all calibration texts of that language
have is flagged. The score is the calibrated chance that the choice is right,
by the margin over the next best.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .batches import chunks, column, give_back, record_batch, tidy
from .samples import lowest, matched, remainder

#: Labelled documents of each language to learn from at most; a quarter of them calibrates.
SAMPLE = 2_000
ORDER, START = 4, 1
UNKNOWN = "und"
_BITS, _FULL = 16, (1 << 16) - 1
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_TABLE: list[np.ndarray] = []


def symbols_of() -> np.ndarray:
    """The 16-bit symbol of each code point: lower-cased letters from 2, all else 0."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint16)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                v = ord(low) if len(low) == 1 else c
                table[c] = max(2, (v ^ (v >> 16)) & _FULL)
        _TABLE.append(table)
    return _TABLE[0]


def encoded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts with ORDER - 1 start marks before each, each text's first mark (n + 1), and which have a letter."""
    table = symbols_of()
    codes = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    parts, letters = [], np.zeros(len(texts), bool)
    mark = np.full(ORDER - 1, START, np.uint16)
    first = np.zeros(len(texts) + 1, np.int64)
    for i, c in enumerate(codes):
        s = table[c]
        letter = s != 0
        letters[i] = letter.any()
        if len(s):
            keep = letter.copy()
            keep[1:] |= letter[:-1]
            s = s[keep]
        parts += [mark, s]
        first[i + 1] = first[i] + len(mark) + len(s)
    return np.concatenate(parts) if parts else mark[:0], first, letters


def codes(s: np.ndarray, order: int) -> np.ndarray:
    """Code of the n-gram that ends at each place; the first order - 1 places wrap and mean nothing."""
    s = s.astype(np.uint64)
    out = s.copy()
    for j in range(1, order):
        out |= np.roll(s, j) << np.uint64(_BITS * j)
    return out


def suffix(code: np.ndarray, order: int) -> np.ndarray:
    return code & np.uint64((1 << (_BITS * (order - 1))) - 1)


class HashArray:
    """Sorted 64-bit hashes with a row of values for each."""

    def __init__(self, code: np.ndarray, values: np.ndarray):
        with np.errstate(over="ignore"):
            h = code * _SPREAD
        by = np.argsort(h)
        self.hashes, self.values = h[by], values[by]

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions, and which of the codes are there."""
        if not len(self.hashes):
            return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        with np.errstate(over="ignore"):
            h = code * _SPREAD
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h


@dataclass
class Level:
    """N-grams of one order: their probability, and their weight as a context of the next; a column for each language."""

    probability: HashArray
    backoff: HashArray


def _estimate(counts: np.ndarray, code: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of orders 1 to ``order``: codes, discounted shares, context codes, what each context leaves to the lower order."""
    out = []
    for n in range(order, 0, -1):
        context, inverse = np.unique(code >> np.uint64(_BITS), return_inverse=True)
        total = np.bincount(inverse, counts)
        types = np.bincount(inverse)
        ones, twos = float((counts == 1).sum()), float((counts == 2).sum())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        share = np.maximum(counts - discount, 0) / total[inverse]
        out.append((code, share, context, discount * types / total))
        if n > 1:  # Kneser-Ney: a lower order counts the different symbols before an n-gram
            code, counts = np.unique(suffix(code, n), return_counts=True)
            counts = counts.astype(float)
    return out[::-1]


class Models:
    """Character models of several languages over common hash arrays."""

    def __init__(self, per_language: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(per_language)
        estimates = [_estimate(n.astype(float), c, ORDER) for c, n in (per_language[k] for k in self.languages)]
        self.floor = np.array([e[0][3][0] / (1 << _BITS) for e in estimates])
        self.levels: list[Level] = []
        for n in range(1, ORDER + 1):
            every = np.unique(np.concatenate([e[n - 1][0] for e in estimates]))
            contexts = np.unique(np.concatenate([e[n - 1][2] for e in estimates]))
            p, g = np.zeros((len(every), len(estimates))), np.ones((len(contexts), len(estimates)))
            for k, e in enumerate(estimates):
                code, share, context, left = e[n - 1]
                p[np.searchsorted(every, code), k] = share
                g[np.searchsorted(contexts, context), k] = left
            lower = np.broadcast_to(self.floor, p.shape) if n == 1 else np.exp(self.logs(suffix(every, n), n - 1))
            weight = g[np.searchsorted(contexts, every >> np.uint64(_BITS))]
            p = p + (lower if n == 1 else weight * lower)
            self.levels.append(Level(HashArray(every, np.log(p).astype(np.float32)), HashArray(contexts, np.log(g).astype(np.float32))))
        self.reject = np.full(len(self.languages), np.inf)
        self.slope = np.array([0.0, 20.0])

    def logs(self, code: np.ndarray, order: int) -> np.ndarray:
        """Log probability of each n-gram's last symbol after the others, a column for each language."""
        level = self.levels[order - 1]
        at, there = level.probability.find(code)
        out = np.empty((len(code), len(self.languages)), np.float32)
        out[there] = level.probability.values[at[there]]
        miss = ~there
        if miss.any():
            rest = code[miss]
            if order == 1:
                out[miss] = np.log(self.floor)
            else:
                low = self.logs(suffix(rest, order), order - 1)
                where, known = level.backoff.find(rest >> np.uint64(_BITS))
                low[known] += level.backoff.values[where[known]]
                out[miss] = low
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text under each language, and which texts have a letter."""
        s, first, letters = encoded(texts)
        out = np.zeros((len(texts), len(self.languages)))
        if len(s):
            scored = s != START
            logs = self.logs(codes(s, ORDER)[scored], ORDER)
            begin = first[:-1] - (ORDER - 1) * np.arange(len(texts))
            n = np.diff(first) - (ORDER - 1)
            some = np.flatnonzero(n > 0)
            if len(some):
                out[some] = -np.add.reduceat(logs, begin[some], axis=0, dtype=np.float64) / n[some, None]
        return out, letters

    def calibrate(self, entropy: np.ndarray, truth: np.ndarray, quantile: float = 0.995, slack: float = 1.05) -> None:
        """Rejection limits and the score's slope from texts of known language that the counts don't hold."""
        best = entropy.argmin(1)
        for k in range(len(self.languages)):
            own = entropy[truth == k, k]
            if len(own) >= 20:
                self.reject[k] = np.quantile(own, quantile) * slack
        if len(self.languages) > 1 and len(best):
            two = np.sort(entropy, 1)[:, :2]
            margin, right = two[:, 1] - two[:, 0], (best == truth).astype(float)
            a, b = 0.0, 20.0
            for _ in range(50):  # damped Newton steps of a logistic fit with a weak prior
                p = 1 / (1 + np.exp(-np.clip(a + b * margin, -30, 30)))
                w = p * (1 - p)
                g = np.array([(p - right).sum() + 0.1 * a, ((p - right) * margin).sum() + 0.001 * (b - 20)])
                h = np.array([[w.sum() + 0.1, (w * margin).sum()], [(w * margin).sum(), (w * margin**2).sum() + 0.001]])
                step = np.linalg.solve(h, g)
                a, b = a - 0.5 * step[0], max(0.0, b - 0.5 * step[1])
            self.slope = np.array([a, b])

    def choose(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text; UNKNOWN, 0 and true without a letter."""
        entropy, letters = self.entropies(texts)
        best = entropy.argmin(1)
        lowest_ = entropy.min(1)
        if len(self.languages) > 1:
            two = np.partition(entropy, 1, axis=1)[:, :2]
            score = 1 / (1 + np.exp(-np.clip(self.slope[0] + self.slope[1] * (two[:, 1] - two[:, 0]), -30, 30)))
        else:
            score = np.ones(len(texts))
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0), lowest_, ~letters | (lowest_ > self.reject[best])


def learnable(docs: DataFrame) -> DataFrame:
    """Rows to learn from: text and lang not null, crc32 of the id not 2 modulo 4."""
    return docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder("doc_id", 4) != 2))


@dataclass
class _Tally:
    """Counts of n-gram codes by language."""

    parts: dict[str, list] = field(default_factory=dict)

    def add(self, language: str, code: np.ndarray) -> None:
        self.parts.setdefault(language, []).append(np.unique(code, return_counts=True))

    def merged(self):
        for language, parts in self.parts.items():
            code, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            yield language, code, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Models | None:
    """:func:`_fit`, with the memory of the counts handed back."""
    models = _fit(docs, sample)
    give_back()
    return models


def _fit(docs: DataFrame, sample: int) -> Models | None:
    """Models of every language of ``docs`` (doc_id, text, lang) from at most ``sample`` documents of each; None without any."""
    rows = learnable(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    chosen = store.written(lowest(rows, "lang", sample).select("doc_id").distinct(), "chosen")
    taken = matched(learnable(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), chosen)
    calibrating = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(4)) == 0
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def count(batches):
        tally = _Tally()
        for batch, _, _ in chunks(batches, "text"):
            texts, languages = column(batch, "text").to_pylist(), np.array(column(batch, "lang").to_pylist())
            for language in np.unique(languages):
                s, _, _ = encoded([t for t, k in zip(texts, languages, strict=True) if k == language])
                tally.add(str(language), codes(s, ORDER)[s != START])
        for language, code, n in tally.merged():
            yield record_batch(schema, [language] * len(code), pa.array(code.view(np.int64)), pa.array(n))

    table = taken.where(~calibrating).select("text", "lang").mapInArrow(tidy(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    if not table.num_rows:
        store.drop(chosen)
        return None
    lang, code, n = table["lang"].to_numpy(), table["code"].to_numpy().view(np.uint64), table["n"].to_numpy()
    models = Models({str(k): _sorted(code[lang == k], n[lang == k]) for k in np.unique(lang)})
    known = models.languages

    def entropies(batches):
        for batch, _, _ in chunks(batches, "text"):
            e, letters = models.entropies(column(batch, "text").to_pylist())
            keep = letters & np.isin(column(batch, "lang").to_pylist(), known)
            yield record_batch(pa.schema([("lang", pa.string()), ("e", pa.list_(pa.float64()))]), pa.array(np.array(column(batch, "lang").to_pylist())[keep].astype(object), pa.string()), e[keep].tolist())

    held = taken.where(calibrating).select("text", "lang").mapInArrow(tidy(entropies), "lang string, e array<double>").toArrow()
    store.drop(chosen)
    if held.num_rows:
        models.calibrate(np.array(held["e"].to_pylist()), np.array([known.index(k) for k in held["lang"].to_pylist()]))
    return models


def _sorted(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(code)
    return code[by], n[by]


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())])


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """lang_pred, score, entropy (nats a symbol) and rejected of each row's whole text.

    Null texts and texts without a letter are UNKNOWN with score 0, as is every
    text where there is nothing to learn from. ``rejected`` marks texts that are
    unlike all languages; lang_pred still names the nearest.
    """
    sent = docs.sparkSession.sparkContext.broadcast(models)  # as large as the bounded sample's n-grams at most

    def run(batches):
        for batch, _, _ in chunks(batches, "text"):
            texts = column(batch, "text").to_pylist()
            n = len(texts)
            found = sent.value.choose(texts) if sent.value else ([UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, bool))
            yield record_batch(_OUT, column(batch, "doc_id"), found[0], *(pa.array(x) for x in found[1:]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, each whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, fit(docs))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op1_langid": op1_langid}
ORACLES: dict[str, str] = {}

"""Operator 2: quality by the perplexity under a model of trusted text.

The model is an interpolated modified Kneser-Ney model of ``ORDER`` characters.
Trusted text is every document that ``labels.quality`` marks 1, whole; a fifth of
these documents is left out of the counts and sets the limits. Counts, shares and
context weights stay sharded by n-gram: nothing of the model is collected or
broadcast, and it grows with the trusted text.

Scoring is a join of counts with blocks of text. A block is some ``BLOCK_BYTES`` of
whole documents of one input partition. It asks once for each different n-gram and
context that its texts use, the sharded table answers, and answers and texts meet by
block. A frequent n-gram is asked for once a block, not once a place, and texts move
once, compressed.

A document is rejected where its log perplexity lies above its language's limit,
which is the quantile ``HIGH`` of all held trusted documents of that language.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .batches import PACKED_SQL, blocks, column, give_back, packed, record_batch, tidy, unpacked
from .samples import matched

ORDER, BITS, START = 4, 15, 1
SYMBOLS = 1 << BITS
#: Bytes of text that ask for their n-grams together.
BLOCK_BYTES = 16 << 20
#: One of so many trusted documents sets the limits and is not counted.
HELD = 5
#: A text's mean is drawn to the entropy of held trusted text as by this many symbols, so short texts are no outliers by chance.
PRIOR = 64
#: A language's limit is this quantile of its held trusted documents. Fewer than ``ENOUGH`` of them don't show it: then it is the bound that a new one exceeds with this chance, by mean and deviation (Student's t), and with fewer than ``FEW`` the highest limit of any.
HIGH, ENOUGH, FEW = 0.99, 100, 5
_TABLE: list[np.ndarray] = []


def symbols_of() -> np.ndarray:
    """The symbol of each code point: its own below 2 ** 15 (shared beyond), one for digits, one for white space."""
    if not _TABLE:
        table = np.arange(0x110000) % (SYMBOLS - 2) + 2
        table[48:58] = table[48]
        table[[9, 10, 13, 0xA0]] = table[32]
        _TABLE.append(table.astype(np.int64))
    return _TABLE[0]


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code of the ORDER symbols that end at each character, texts one after another, and each text's first (n + 1)."""
    table = symbols_of()
    points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(p) for p in points])]).astype(np.int64)
    s = table[np.concatenate(points)] if first[-1] else np.zeros(0, np.int64)
    out = s.copy()
    for j in range(1, ORDER):
        before = np.full(len(s), START, np.int64)
        before[j:] = s[: len(s) - j]
        for k in range(j):  # the first symbols of each text follow start marks
            at = first[:-1] + k
            before[at[at < first[1:]]] = START
        out |= before << (BITS * j)
    return out, first


def last(code, n: int):
    """The last ``n`` symbols of a code."""
    return code & ((1 << (BITS * n)) - 1)


def keyed(code, n: int):
    """The key of an n-gram: its code, marked with its order."""
    return code | (n << 60)


def needed(code: np.ndarray) -> np.ndarray:
    """Keys of the n-grams and contexts of all orders that the probabilities of these codes are made of."""
    out = []
    for n in range(ORDER, -1, -1):
        out.append(keyed(code, n))
        code = np.unique(np.concatenate([last(code, max(0, n - 1)), code >> BITS]))
    return np.concatenate(out)


def log_probabilities(code: np.ndarray, keys: np.ndarray, share: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Log probability of each code's last symbol after the others. ``keys`` are sorted; what isn't there was never counted."""
    p = np.full(len(code), 1 / SYMBOLS)
    if not len(keys):
        return np.log(p)

    def find(wanted: np.ndarray, values: np.ndarray, missing: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing)

    for n in range(1, ORDER + 1):
        own = last(code, n)
        p = find(keyed(own, n), share, 0.0) + find(keyed(own >> BITS, n - 1), left, 1.0) * p
    return np.log(np.maximum(p, 1e-30))


def counts(trusted: DataFrame) -> DataFrame:
    """Code and count of every n-gram of every text."""
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for _, parts in blocks(batches, BLOCK_BYTES):
            found = [np.unique(codes(column(part, "text").to_pylist())[0], return_counts=True) for part in parts]
            code, inverse = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([k for _, k in found]), len(code)).astype(np.int64)
            for lo in range(0, len(code), 100_000):
                yield record_batch(schema, pa.array(code[lo : lo + 100_000]), pa.array(n[lo : lo + 100_000]))

    return trusted.select("text").mapInArrow(tidy(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def shares(table: DataFrame, order: int) -> DataFrame:
    """Of one order's counts: each n-gram's discounted share of its context, and what each context leaves to the next lower order, by key.

    The three discounts come from how many n-grams were counted once to four times.
    """
    few = {r["n"]: r["k"] for r in table.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    y = few[1] / (few[1] + 2 * few[2]) if few.get(1) and few.get(2) else 0.5
    discounts = [min(k, max(0.0, k - (k + 1) * y * few.get(k + 1, 0) / few[k])) if few.get(k) else k * 0.5 for k in (1, 2, 3)]
    discount = F.when(F.col("n") == 1, discounts[0]).when(F.col("n") == 2, discounts[1]).otherwise(discounts[2])
    rows = table.withColumn("context", F.shiftright("code", BITS)).withColumn("discount", discount)
    contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("discount").alias("out"))
    mark = lambda c, n: F.col(c).bitwiseOR(F.lit(n << 60).cast("long")).alias("key")
    none = F.lit(None).cast("double")
    share = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")
    left = (F.col("out") / F.col("total")).alias("left")
    return rows.join(contexts, "context").select(mark("code", order), share.alias("share"), none.alias("left")).unionByName(contexts.select(mark("context", order - 1), none.alias("share"), left))


def fit(trusted: DataFrame) -> DataFrame:
    """key, share (0 where it is a context only) and left (1 where nothing follows it) of every n-gram of all texts of ``trusted``; no rows without text."""
    tables, parts = [store.written(counts(trusted), "grams")], []
    for n in range(ORDER, 0, -1):
        parts.append(shares(tables[-1], n))
        if n > 1:  # a lower order counts the different symbols before an n-gram
            tables.append(store.written(tables[-1].groupBy(F.col("code").bitwiseAND(F.lit((1 << (BITS * (n - 1))) - 1).cast("long")).alias("code")).agg(F.count("*").alias("n")), "grams"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    model = rows.groupBy("key").agg(F.coalesce(F.max("share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("left"), F.lit(1.0)).alias("left"))
    model = store.written(model, "model")
    for table in tables:
        store.drop(table)
    return model


_ASKED = pa.schema([("block", pa.int64()), ("key", pa.int64())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("total", pa.float64()), ("n", pa.int64())])


def _asked(batches):
    """Keys that each block needs."""
    for number, parts in blocks(batches, BLOCK_BYTES):
        keys = needed(np.unique(np.concatenate([np.unique(codes(column(part, "text").to_pylist())[0]) for part in parts])))
        for lo in range(0, len(keys), 100_000):
            part = keys[lo : lo + 100_000]
            yield record_batch(_ASKED, pa.array(np.full(len(part), number)), pa.array(part))


def _block_scores(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Sum of negative log probabilities and number of characters of each document of a block."""
    keys = answers["key"].to_numpy()
    order = np.argsort(keys)
    keys, share, left = keys[order], answers["share"].to_numpy()[order], answers["left"].to_numpy()[order]
    out = []
    for batch in unpacked(docs["docs"]):
        code, first = codes(column(batch, "text").to_pylist())
        n, total = np.diff(first), np.zeros(batch.num_rows)
        some = np.flatnonzero(n > 0)
        if len(some):
            each, inverse = np.unique(code, return_inverse=True)
            logs = log_probabilities(each, keys, share, left)
            total[some] = -np.add.reduceat(logs[inverse], first[some])
        out.append(record_batch(_SCORED, column(batch, "doc_id"), column(batch, "lang"), pa.array(total), pa.array(n)))
    give_back()
    return pa.Table.from_batches(out, _SCORED)


def scores(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, total (negative log probability) and n (characters) of every row's whole text; null is empty.

    ``docs`` is read twice and must give the same partitions: a table, not a random draw.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    answers = rows.mapInArrow(tidy(_asked), "block long, key long").join(model, "key")
    texts = rows.mapInArrow(tidy(packed(BLOCK_BYTES)), PACKED_SQL)
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_block_scores, "doc_id long, lang string, total double, n long")


def limits(scored: DataFrame) -> DataFrame:
    """lang, limit (the quantile), n, mean and deviation of the log perplexities of trusted documents; the row with a null lang is of all languages together."""
    x = "log_perplexity"
    figures = [F.percentile_approx(x, HIGH, 10_000).alias("limit"), F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("deviation")]
    return scored.where("lang is not null").groupBy("lang").agg(*figures).unionByName(scored.agg(F.lit(None).cast("string").alias("lang"), *figures))


def bound(limit: float, n: int, mean: float, deviation: float | None) -> float:
    """A row of :func:`limits` as a limit: the quantile, or where ``n`` is too small for it what a new document exceeds as rarely."""
    if n >= ENOUGH or n < 2:
        return limit
    z, v = NormalDist().inv_cdf(HIGH), max(n - 1, FEW - 1)
    t = z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v**3)
    return mean + t * deviation * math.sqrt(1 + 1 / n)


def judged(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """doc_id, lang, log_perplexity, log_limit and kept of each row of ``docs`` (doc_id, lang, text).

    Null and empty texts have the entropy of trusted text and are kept. Rows without
    a language, or of one with fewer than ``FEW`` held trusted documents, have the
    highest limit of any language or of all together; where there is none at all (too
    few trusted documents), nothing is judged: all rows are kept, with null figures.
    """
    held = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id").cast("long")), F.lit(HELD)) == 0
    model = fit(matched(docs, trusted_ids.where(~held), "left_semi"))
    scored = store.written(scores(docs, model), "scored")
    store.drop(model)
    tests = matched(scored, trusted_ids.where(held), "left_semi").where("n > 0")
    sums = tests.agg(F.sum("total"), F.sum("n")).first()
    if not sums[1]:
        none = F.lit(None).cast("double")
        return scored.select("doc_id", "lang", none.alias("log_perplexity"), none.alias("log_limit"), F.lit(True).alias("kept"))
    mean = ((F.col("total") + PRIOR * sums[0] / sums[1]) / (F.col("n") + PRIOR)).alias("log_perplexity")
    found = {r["lang"]: r for r in limits(tests.select("lang", mean)).collect()}  # one row a language
    known = {k: bound(r["limit"], r["n"], r["mean"], r["deviation"]) for k, r in found.items() if k is None or r["n"] >= FEW}
    limit = F.lit(max(known.values()))
    del known[None]
    if known:
        limit = F.coalesce(F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.col("lang")], limit)
    return scored.select("doc_id", "lang", mean, limit.alias("log_limit")).withColumn("kept", (F.col("log_perplexity") <= F.col("log_limit")))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents above their language's limit go, with all rows of their doc_id; rows without one stay."""
    gone = judged(docs, trusted_ids(spark, sf_dir)).where("not kept and doc_id is not null").select("doc_id").distinct()
    return matched(docs, gone, "left_anti").select(docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: perplexity a symbol, the limit of the language, and what is accepted."""
    found = judged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), trusted_ids(spark, sf_dir))
    return found.select("doc_id", "lang", F.exp("log_perplexity").alias("perplexity"), F.exp("log_limit").alias("limit"), "kept")


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}

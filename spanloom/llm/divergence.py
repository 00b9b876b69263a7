"""Operator 12: how far the sources of a language differ, by a heavy-light split of its terms.

Each language keeps the terms that enough of its documents hold. A group is one
source in one language; its share of a term is the integer
p = 1 + floor(SCALE * (count + ADD) / (N + ADD * V)), and two groups differ by the sum
of abs(p - q) over all kept terms. All of it is integer arithmetic, so the order of
summation changes nothing.

1. Terms are counted exactly inside each task before anything is shuffled; a kept
   term becomes one row with its counts by group.
2. With p0 the share of a term that a group lacks and d0 = abs(p0_g - p0_h), a pair
   starts with V * d0; what follows is what each term differs from d0.
3. Heavy terms (in more than 1 / ``LIGHT`` of the language's groups) fill dense
   matrices, ``CHUNK_TERMS`` terms by two tiles of ``TILE`` groups each, and numpy sums
   them up for all pairs of the two tiles.
4. A light term is in few groups. Each posting adds abs(p_g - p0_h) - d0 to the pairs of
   its group; sorted postings and prefix sums give that for all h at once. For a term
   that both hold, each pair of postings adds the correction
   abs(p_g - p_h) - abs(p_g - p0_h) - abs(p0_g - p_h) + d0.
5. The partial sums are added up by pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .batches import chunks, column, lower_ascii, record_batch, runs, tidy

SCALE, ADD, LEAST_DOCS, TOP = 1_000_000_000, 5, 30, 50
#: A term in at most one of so many groups of its language is light.
LIGHT = 8
TILE, CHUNK_TERMS = 256, 2_048
#: Bytes of text counted at once.
COUNT_BYTES = 8 << 20
#: Groups that are sent to every task at most (some 40 bytes each).
BROADCAST_GROUPS = 1_000_000

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _letters(low: np.ndarray) -> np.ndarray:
    """Bytes of terms: a to z and everything beyond ASCII."""
    return (low >= 128) | ((low >= 97) & (low <= 122))


def _counted(batches):
    """Occurrences and documents of each (lang, source, term) of a piece of the table."""
    for batch, data, at in chunks(batches, "text", COUNT_BYTES):
        low = lower_ascii(data)
        inside = _letters(low)
        starts, ends, first = runs(inside, at)
        if not len(starts):
            continue
        lengths = ends - starts
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        letters = pa.py_buffer(np.ascontiguousarray(low[inside]))
        terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), letters).dictionary_encode()
        code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        langs, sources = column(batch, "lang").dictionary_encode(), column(batch, "source").dictionary_encode()
        n_sources, n_terms = len(sources.dictionary), len(terms.dictionary)
        group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_sources + sources.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), np.diff(first))
        in_row, each = np.unique(row * n_terms + code, return_counts=True)  # one for each document and term
        key, inverse = np.unique(group[in_row // n_terms] * n_terms + in_row % n_terms, return_inverse=True)
        n, docs = np.bincount(inverse, each, len(key)).astype(np.int64), np.bincount(inverse, minlength=len(key))
        for lo in range(0, len(key), 100_000):
            part = slice(lo, lo + 100_000)
            g, t = np.divmod(key[part], n_terms)
            yield record_batch(_COUNTS, pc.take(langs.dictionary, pa.array(g // n_sources)), pc.take(sources.dictionary, pa.array(g % n_sources)), pc.take(terms.dictionary, pa.array(t)), pa.array(n[part]), pa.array(docs[part]))


def term_counts(docs: DataFrame) -> DataFrame:
    """n and docs (rows that hold it) of every lang, source and term; null lang, source and text count as ''."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(tidy(_counted), "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count, total, size):
    """The exact integer share of a count in a group of ``total`` occurrences of ``size`` kept terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = (wide(count) + F.lit(ADD)) * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", top, wide(total) + wide(size) * F.lit(ADD).cast("decimal(2,0)")).cast("long")


_PAIRS = pa.schema([("lang", pa.string()), ("g", pa.int64()), ("h", pa.int64()), ("value", pa.int64())])
_PAIRS_SQL = "lang string, g long, h long, value long"


def _pair_rows(lang: str, ti: int, tj: int, total: np.ndarray, tile: int) -> pa.Table:
    """A matrix of partial sums, one row for each pair (g, h); those of one tile come once."""
    i, j = np.divmod(np.arange(total.size), total.shape[1])
    g, h = i + ti * tile, j + tj * tile
    keep = g < h
    return pa.table([pa.array([lang] * int(keep.sum()), pa.string()), pa.array(g[keep]), pa.array(h[keep]), pa.array(total.ravel()[keep])], schema=_PAIRS)


def _zeros(tiles: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The zero shares of both tiles' groups, and how far each two of them are apart."""
    i, j = (np.asarray(tiles[c][0].as_py(), np.int64) for c in ("zeros_i", "zeros_j"))
    return i, j, np.abs(i[:, None] - j[None, :])


def _dense(key, postings: pa.Table, tiles: pa.Table, tile: int) -> pa.Table:
    """Heavy terms of one chunk, for all pairs of two tiles."""
    lang, _, ti, tj = (k.as_py() for k in key)
    if not tiles.num_rows or not postings.num_rows:  # no group of these tiles has any of the terms
        return _PAIRS.empty_table()
    *zero, apart = _zeros(tiles)
    _, term = np.unique(postings["term"].to_numpy(), return_inverse=True)
    g, p = postings["g"].to_numpy(), postings["p"].to_numpy()
    n_terms, matrix = int(term.max()) + 1, []
    for t, z in zip((ti, tj), zero, strict=True):
        m = np.repeat(z[:, None], n_terms, axis=1)
        own = g // tile == t
        m[g[own] % tile, term[own]] = p[own]
        matrix.append(m)
    total = np.stack([np.abs(matrix[1] - row).sum(axis=1) for row in matrix[0]]) - n_terms * apart
    return _pair_rows(lang, ti, tj, total, tile)


def _own(key, postings: pa.Table, tiles: pa.Table, tile: int) -> pa.Table:
    """What all terms start with, and each light posting beside the groups that lack it, for all pairs of two tiles."""
    lang, ti, tj = (k.as_py() for k in key)
    if not tiles.num_rows:
        return _PAIRS.empty_table()
    zero_i, zero_j, apart = _zeros(tiles)
    total = apart * int(tiles["size"][0].as_py())
    found = {r["g"]: (np.asarray(r["values"], np.int64), np.asarray(r["times"], np.int64)) for r in postings.to_pylist()}  # few different counts each
    for side, (t, others) in enumerate(((ti, zero_j), (tj, zero_i))):
        for g, (values, times) in found.items():
            if g // tile != t:
                continue
            n, s = np.concatenate([[0], np.cumsum(times)]), np.concatenate([[0], np.cumsum(values * times)])
            at = np.searchsorted(values, others)
            own = others * n[at] - s[at] + (s[-1] - s[at]) - others * (n[-1] - n[at])
            here = (g % tile, slice(None)) if side == 0 else (slice(None), g % tile)
            total[here] += own - n[-1] * apart[here]
    return _pair_rows(lang, ti, tj, total, tile)


def _both(batches):
    """Corrections for the pairs of groups that hold the same light term, summed up within each batch."""
    for batch in batches:
        lists, lang = column(batch, "postings"), column(batch, "lang").dictionary_encode()
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        g, p, zero = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("g", "p", "zero"))
        first, of = np.cumsum(size) - size, lang.indices.to_numpy(zero_copy_only=False)
        sums: list[tuple[np.ndarray, ...]] = []
        for k in np.unique(size[size > 1]):
            rows = np.flatnonzero(size == k)
            step = max(1, 4_000_000 // int(k * k))
            a, b = np.triu_indices(k, 1)
            for lo in range(0, len(rows), step):
                at = first[rows[lo : lo + step]][:, None]
                x, y = at + a[None, :], at + b[None, :]
                value = np.abs(p[x] - p[y]) - np.abs(p[x] - zero[y]) - np.abs(zero[x] - p[y]) + np.abs(zero[x] - zero[y])
                which = np.broadcast_to(of[rows[lo : lo + step]][:, None], x.shape)
                sums.append((which.ravel(), np.minimum(g[x], g[y]).ravel(), np.maximum(g[x], g[y]).ravel(), value.ravel()))
        if not sums:
            continue
        table = pa.table([np.concatenate(c) for c in zip(*sums, strict=True)], names=["l", "g", "h", "value"]).group_by(["l", "g", "h"]).aggregate([("value", "sum")]).combine_chunks()
        out = [pc.take(lang.dictionary, table["l"].combine_chunks()), *(table[c].combine_chunks() for c in ("g", "h", "value_sum"))]
        yield record_batch(_PAIRS, *out)


def _sent(rows: DataFrame, groups: DataFrame, on: list[str], n_groups: int) -> DataFrame:
    """``rows`` joined with the groups, by broadcast while those are few enough."""
    return rows.join(F.broadcast(groups) if n_groups <= BROADCAST_GROUPS else groups, on)


def _tile_pairs(groups: DataFrame, chunk_counts: DataFrame, tile: int) -> DataFrame:
    """lang, ti, tj (ti <= tj), the zero shares of both tiles' groups in order, the number of terms and of chunks of heavy ones."""
    tiles = groups.where("size > 0").groupBy("lang", F.expr(f"g div {tile}").alias("t")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("g", "zero"))).alias("x"))  # at most ``tile``
    i = tiles.select("lang", "size", F.col("t").alias("ti"), F.col("x.zero").alias("zeros_i"))
    j = tiles.select("lang", F.col("t").alias("tj"), F.col("x.zero").alias("zeros_j"))
    return i.join(j, "lang").where("ti <= tj").join(chunk_counts, "lang")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, light: int = LIGHT, tile: int = TILE, chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank, for every (lang, source) of ``docs`` (lang, source, text).

    Part ``pair``: item is each other source of the language, value the sum of
    abs(p - q) over all kept terms (0 without any). Part ``term``: item is a kept term
    of the group with p above the language's q, value p - q, the first ``top``. Ranks
    go by value (largest first), then item in UTF-8 order.

    Null texts, languages and sources count as empty strings, which are values like
    any other; groups without terms have shares too. Every row counts, repeated ones
    as well; other columns are left out; an empty table gives no rows. A very long
    text is counted in one piece.
    """
    counts = store.written(term_counts(docs), "term-counts")
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts"))  # one for each group of a language
    kept = store.written(by_term.where(F.col("docs") >= least_docs).select("lang", "term", "total", "counts"), "kept-terms")
    store.drop(counts)

    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("total").alias("lang_total"))
    totals = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("group_total"))
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = every.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["group_total", "size", "lang_total"])
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    zero = F.when(F.col("size") > 0, _share(F.lit(0), F.col("group_total"), F.col("size")))
    groups = store.written(groups.select("lang", "source", number.alias("g"), "group_total", "size", "lang_total", F.count("*").over(Window.partitionBy("lang")).alias("n_groups"), zero.alias("zero")), "groups")
    n_groups = groups.count()

    posting = kept.select("lang", "term", "total", F.size("counts").cast("long").alias("spread"), F.explode("counts").alias("c")).select("lang", "term", "total", "spread", F.col("c.source").alias("source"), F.col("c.n").alias("n"))
    posting = _sent(posting, groups, ["lang", "source"], n_groups)
    shares = posting.select("lang", "source", "g", "term", "zero", (F.col("spread") * light <= F.col("n_groups")).alias("light"), _share(F.col("n"), F.col("group_total"), F.col("size")).alias("p"), _share(F.col("total"), F.col("lang_total"), F.col("size")).alias("q"))
    shares = store.written(shares, "shares")
    store.drop(kept)

    # Postings, placed with every tile pair that their group is part of.
    is_light, is_heavy = F.col("light"), ~F.col("light")
    terms = shares.groupBy("lang", "term").agg(F.first("light").alias("light"))
    chunk_counts = terms.groupBy("lang").agg(F.ceil(F.sum(is_heavy.cast("long")) / chunk_terms).cast("long").alias("n_chunks"))
    tiles = store.written(_tile_pairs(groups, chunk_counts, tile), "tiles")
    own_tile, n_tiles = F.expr(f"g div {tile}"), F.ceil(F.col("n_groups") / tile).cast("long")
    placed = _sent(shares.select("lang", "g", "term", "p", "light"), groups.select("lang", "g", "n_groups"), ["lang", "g"], n_groups).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), n_tiles - 1)))
    placed = placed.select("lang", "g", "term", "p", "light", F.least(own_tile, "o").alias("ti"), F.greatest(own_tile, "o").alias("tj"))

    heavy = placed.where(is_heavy).join(F.broadcast(chunk_counts), "lang").select("lang", F.pmod(F.xxhash64("term"), "n_chunks").alias("chunk"), "ti", "tj", "g", "term", "p")
    frames = tiles.where("n_chunks > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)).alias("chunk"), "ti", "tj", "zeros_i", "zeros_j")
    key = ["lang", "chunk", "ti", "tj"]
    dense = heavy.groupBy(*key).cogroup(frames.groupBy(*key)).applyInArrow(lambda k, a, b: _dense(k, a, b, tile), _PAIRS_SQL)

    key = ["lang", "ti", "tj"]
    values = placed.where(is_light).groupBy(*key, "g", "p").agg(F.count("*").alias("times"))
    values = values.groupBy(*key, "g").agg(F.array_sort(F.collect_list(F.struct("p", "times"))).alias("x")).select(*key, "g", F.col("x.p").alias("values"), F.col("x.times").alias("times"))
    own = values.groupBy(*key).cogroup(tiles.groupBy(*key)).applyInArrow(lambda k, a, b: _own(k, a, b, tile), _PAIRS_SQL)
    lists = shares.where(is_light).groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "zero")).alias("postings")).where(F.size("postings") > 1).select("lang", "postings")  # at most 1 / light of the groups
    both = lists.mapInArrow(tidy(_both), _PAIRS_SQL)

    sums = dense.unionByName(own).unionByName(both).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    sums = store.written(sums, "pair-sums")
    store.drop(tiles)
    names = groups.select("lang", "g", "source")
    # Languages without a kept term have no tiles; all their pairs are 0.
    bare = groups.where("size = 0").select("lang", "g", "source")
    bare = bare.join(bare.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), "lang").where("g <> h").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    named = _sent(_sent(sums, names, ["lang", "g"], n_groups), names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"], n_groups)
    pairs = named.select("lang", "source", "item", "value").unionByName(named.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).unionByName(bare)
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda rows, part: rows.withColumn("rank", rank).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: distances between the sources of each language, and each source's own terms."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS (SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT e.lang, e.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) e LEFT JOIN c ON c.lang = e.lang AND c.source = e.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.n + 5 * v.v) AS p, 1 + (1000000000 * (k.total + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
own AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM own) WHERE rank <= 50
"""

QUERIES = {"op12_divergence": op12_divergence}
ORACLES = {"op12_divergence": _SQL}

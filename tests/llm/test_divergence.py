"""Distances between sources against plain Python, with tiles and chunks small enough to have several."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.llm import divergence

SCHEMA = "lang string, source string, text string"


def plain(rows, least_docs, top):
    rows = [(a or "", b or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for a, b, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs = Counter(w for a, _, ws in rows if a == lang for w in set(ws))
        kept = sorted(w for w, n in docs.items() if n >= least_docs)
        v = len(kept)
        count = {}
        for a, b, ws in rows:
            if a == lang:
                count.setdefault(b, Counter()).update(w for w in ws if w in set(kept))
        whole = sum(count.values(), Counter())

        def share(c, whole_v=v):
            return lambda w: 1 + 1_000_000_000 * (c[w] + 5) // (sum(c.values()) + 5 * whole_v)

        for b, c in count.items():
            p, q = share(c), share(whole)
            pairs = [(-sum(abs(p(w) - share(d)(w)) for w in kept), o.encode(), o) for o, d in count.items() if o != b]
            terms = [(q(w) - p(w), w.encode(), w) for w in kept if c[w] and p(w) > q(w)]
            out += [(lang, b, "pair", o, -x, i) for i, (x, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, b, "term", w, -x, i) for i, (x, _, w) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def table(n_sources, n, seed):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdéß日" for b in ("", "x", "yz", "Q")]
    rows = []
    for _ in range(n):
        s = draw.randrange(n_sources)
        pool = words[: 4 + s % 3] * 3 + words[s % 20 : s % 20 + 5]
        rows.append((draw.choice(["en", "en", "de", None, ""]), draw.choice([f"s{s}", f"s{s}", f"S {s}"]), " ".join(draw.choice(pool) + draw.choice(["", ",", "1", "\n"]) for _ in range(draw.randrange(12)))))
    return rows + [("en", None, None), ("xx", "only", "12 34"), ("yy", "a", None), ("yy", "b", ""), ("en", "s1", "abc " * 20_000)]


@pytest.mark.parametrize("least_docs,top,light,tile,chunk", [(3, 4, 8, 256, 2_048), (2, 50, 3, 3, 5), (1, 2, 1, 2, 3), (4, 50, 1_000, 4, 2), (10_000, 5, 8, 4, 4)])
def test_same_as_plain_python(spark, least_docs, top, light, tile, chunk):
    rows = table(13, 300, least_docs)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("term", F.lit("x")).withColumn("n", F.lit(1)).withColumn("g", F.lit(1))
    got = sorted(tuple(r) for r in divergence.divergence(df, least_docs, top, light, tile, chunk).collect())
    assert got == plain(rows, least_docs, top)


def test_repeated_rows_count_and_an_empty_table_has_no_rows(spark):
    rows = [("en", "a", "one two"), ("en", "b", "one")] * 3
    got = sorted(tuple(r) for r in divergence.divergence(spark.createDataFrame(rows, SCHEMA), 3).collect())
    assert got == plain(rows, 3, 50)
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_counts_stay_exact(spark):
    one = spark.range(1).select(divergence._share(F.lit(10**12 + 7).cast("long"), F.lit(3 * 10**12 + 1).cast("long"), F.lit(10**7).cast("long")).alias("p")).first()["p"]
    assert one == 1 + 1_000_000_000 * (10**12 + 12) // (3 * 10**12 + 1 + 5 * 10**7)

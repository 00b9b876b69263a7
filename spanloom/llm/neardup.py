"""Operator 9: near-duplicates by bottom-k sketches of one hash function.

1. Every whole text becomes the set of its word shingles' 64-bit hashes; the k
   smallest are its sketch. Texts of one set are one class, known by its
   smallest doc_id: copies are never compared with each other.
2. Inverted lists of the retained values generate overlaps. Two sets at or above
   the similarity share far more than ``RATIO`` of a sketch (less has a chance of
   about 1e-7 at k = 32), so it is enough to look up each sketch's rarest values,
   all but the last RATIO * k - 1: values that many unrelated texts share (a
   passage, a licence line) stand last and open no list.
3. Of what stands in a list, a full set of which more than a fifth is in no other
   listed set can't reach the similarity and leaves. Short lists give all their pairs. A long list gives pairs with a pivot drawn
   by hash, another one in each list, so a group of n near copies costs n pairs a
   list and not n * n.
4. The union sketch estimates each pair's similarity and drops what can't reach
   it; exact Jaccard on the full sets confirms the rest.
5. Confirmed links join components by alternating star contraction.
6. Members of long lists that are still in different components are compared all
   with all across components, exactly and in blocks, and a block sends no more
   links than it takes to join them: so the pivots cost no link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .batches import chunks, column, lower_ascii, mix, record_batch, run_hashes, runs, tidy
from .samples import looked_up, matched

K, RATIO, ESTIMATE, SHORT_LIST, BLOCK = 32, 0.35, 0.4, 8, 256


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (int64) of each text."""
    low = lower_ascii(data)
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    starts, ends, first = runs(inside, at)
    words = run_hashes(low, starts, ends)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for j in range(width):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - width + 1 + j]
        rolled = mix(rolled + np.uint64(width)).view(np.int64)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                h = np.zeros(1, np.uint64)
                for j in range(a, b):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + words[j]
                yield mix(h + np.uint64(b - a)).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("sketch", pa.list_(pa.int64()))])
SETS = pa.schema([("id", pa.int64()), ("hashes", pa.list_(pa.int64()))])


def sketches(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """Size, key and sketch of every text's shingle set."""

    def run(batches):
        for batch, data, at in chunks(batches, "text"):
            sets = list(shingle_sets(data, at, width))
            keys = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            yield record_batch(SKETCH, column(batch, "doc_id"), pa.array([len(s) for s in sets]), pa.array(keys[:, 0]), pa.array(keys[:, 1]), _lists([s[:k] for s in sets]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, key1 long, key2 long, sketch array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch, data, at in chunks(batches, "text"):
            yield record_batch(SETS, column(batch, "doc_id"), _lists(list(shingle_sets(data, at, width))))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "id long, hashes array<long>")


def components(links: DataFrame) -> DataFrame:
    """node and the smallest node that it reaches, for links (a, b); by alternating large and small stars. A node of many links is looked up apart, so that no star is one task."""
    edges = store.written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen, n = None, edges.count()
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("weight"))
        large = looked_up(both, "u", least, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store.written(large.where("u <> v").distinct(), "edges")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight"))
        # u keeps its link to m, and each other smaller neighbour gets one.
        small = looked_up(large, "u", lowest, n).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = store.written(small.where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        store.drop(edges)
        store.drop(large)
        edges, n = now, state[0]
        if state == seen:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            out.spanloom_path = edges.spanloom_path
            return out
        seen = state


def _estimated(pairs: DataFrame, sketch: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) whose union sketch estimates at least ESTIMATE."""
    one, two = sketch.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), sketch.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    joined = pairs.join(one, "a").join(two, "b").withColumn("u", union)
    shared = F.size(F.array_intersect(F.array_intersect("u", "sa"), F.col("sb")))
    return joined.where(shared >= F.size("u") * ESTIMATE).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of at least ``percent`` exact Jaccard similarity on the full sets."""
    one, two = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    shared = F.size(F.array_intersect("ha", "hb"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", shared.alias("i"), (F.size("ha") + F.size("hb")).alias("t"))
    return joined.where(F.col("i").cast("long") * 100 >= (F.col("t") - F.col("i")) * percent).select("a", "b")


def overlaps(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, width: int = 8_192) -> np.ndarray:
    """Sizes of the intersections of some sets with others, by products of 0/1 matrices over the values that occur more than once."""
    values, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    new = np.cumsum(n > 1) - 1
    keep = n[inverse] > 1
    owner, place = owner[keep], new[inverse[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(rows), len(columns)), np.float32)
    for low in range(0, int(new[-1]) + 1 if len(values) else 0, width):
        part = slice(np.searchsorted(place, low), np.searchsorted(place, low + width))
        has = np.zeros((len(sets), width), np.float32)
        has[owner[part], place[part] - low] = 1
        out += has[rows] @ has[columns].T
    return out


def _block_links(rows, percent: int):
    """Of one block of a group: exact links between members of different components, no more than it takes to join them."""
    import pandas as pd

    query, target = np.flatnonzero(rows["is_query"]), np.flatnonzero(~rows["is_query"])
    if not len(query) or not len(target):
        return pd.DataFrame({"a": [], "b": []})
    sets = [np.asarray(x, np.int64) for x in rows["hashes"]]
    size = np.array([len(x) for x in sets], np.float32)
    shared = overlaps(sets, query, target)
    rep, label = rows["rep"].to_numpy(), rows["label"].to_numpy()
    linked = (100 * shared >= percent * (size[query][:, None] + size[target][None, :] - shared)) & (label[query][:, None] != label[target][None, :])
    root = {x: x for x in label}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in np.argwhere(linked):
        x, y = find(label[query[i]]), find(label[target[j]])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((rep[query[i]], rep[target[j]]))
    return pd.DataFrame(out, columns=["a", "b"])


def _across(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links within groups (g, rep) whose members are in different components: strays (outside the group's largest component) against all."""
    m = members.join(labels, members["rep"] == labels["node"], "left").select("g", "rep", F.coalesce("label", "rep").alias("label"))
    m = store.written(m, "members")
    per = m.groupBy("g", "label").agg(F.count("*").alias("n"))
    top = per.groupBy("g").agg(F.count("*").alias("n_labels"), F.sum("n").alias("size"), F.max(F.struct("n", "label"))["label"].alias("main"), (F.sum("n") - F.max("n")).alias("n_strays")).where("n_labels > 1")
    m = looked_up(m, "g", top.withColumn("weight", F.col("size")), m.count()).where("n_labels > 1").join(sets.withColumnRenamed("id", "rep"), "rep")
    parts = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    number = lambda n: F.pmod(F.xxhash64("rep"), parts(n).cast("long")).cast("int")
    queries = m.where("label <> main").select("g", "rep", "label", "hashes", F.lit(True).alias("is_query"), number("n_strays").alias("q"), F.explode(F.sequence(F.lit(0), parts("size") - 1)).alias("t"))
    targets = m.select("g", "rep", "label", "hashes", F.lit(False).alias("is_query"), F.explode(F.sequence(F.lit(0), parts("n_strays") - 1)).alias("q"), number("size").alias("t"))
    return queries.unionByName(targets).groupBy("g", "q", "t").applyInPandas(lambda rows: _block_links(rows, percent), "a long, b long")


def _possible(sets: DataFrame, percent: int) -> DataFrame:
    """Ids whose share of values that another set holds too reaches ``percent``: no other can have a link."""
    alone = sets.select("id", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    alone = alone.groupBy("id").agg(F.count("*").alias("alone"))
    sizes = sets.select("id", F.size("hashes").cast("long").alias("size"))
    return sizes.join(alone, "id", "left").where((F.col("size") - F.coalesce("alone", F.lit(0))) * 100 >= F.col("size") * percent).select("id")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K, short_list: int = SHORT_LIST, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text).

    Null and wordless texts have the empty set and link with nothing; a text of
    fewer than ``width`` words has one shingle, all its words. Rows of one doc_id
    are one document.
    """
    sk = store.written(sketches(docs, width, k), "sketches")
    classes = store.written(sk.where("n_shingles > 0").groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = sk.where("n_shingles > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "sketch")

    values = reps.select("rep", F.size("sketch").alias("ks"), F.explode("sketch").alias("v"))
    often = store.written(values.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").withColumn("weight", F.col("n")), "often")
    total = sk.agg(F.sum(F.size("sketch"))).first()[0] or 0
    shared = looked_up(values, "v", often, total, 0).where("n > 1").groupBy("rep", "ks").agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("vs"))  # at most k a document
    need = F.ceil(F.col("ks") * RATIO).cast("int")
    lookup = shared.where(F.size("vs") >= need).select("rep", F.explode(F.slice("vs", F.lit(1), F.size("vs") - need + 1)).alias("x")).select("rep", F.col("x.v").alias("v"))
    first = store.written(lookup, "lookup")
    store.drop(often)

    # Full sets of what is listed; a set with too many values of its own has no partner and leaves.
    wide = F.col("doc_id").cast("long")
    listed = first.select(F.col("rep").alias("doc_id")).distinct()
    all_sets = store.written(full_sets(matched(docs.select(wide.alias("doc_id"), "text"), listed, "left_semi"), width), "sets")
    sets = store.written(all_sets.join(_possible(all_sets, percent), "id", "left_semi"), "sets")
    left = sets.select(F.col("id").alias("rep")).distinct()
    store.drop(all_sets)

    lookup = store.written(first.join(left, "rep", "left_semi"), "lookup")
    store.drop(first)
    pivot = F.min(F.struct(F.xxhash64("v", "rep").alias("h"), F.col("rep").alias("pivot")))["pivot"]
    lists = store.written(lookup.groupBy("v").agg(F.count("*").alias("n"), pivot.alias("pivot"), F.min("rep").alias("g")).where("n > 1").withColumn("weight", F.col("n")), "lists")
    members = store.written(looked_up(lookup, "v", lists, lookup.count(), 0).where("n > 1"), "members")
    store.drop(lists)
    few = members.where(F.col("n") <= short_list).groupBy("v").agg(F.collect_set("rep").alias("r"))  # at most short_list
    few = few.select(F.explode(F.expr("flatten(transform(r, x -> transform(filter(r, y -> y > x), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    many = members.where((F.col("n") > short_list) & (F.col("rep") != F.col("pivot"))).select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    sketch = store.written(reps.join(left, "rep", "left_semi"), "listed")
    links = store.written(_confirmed(_estimated(few.union(many).distinct(), sketch, k), sets, percent), "links")
    labels = components(links)
    # What the pivots have left apart. Lists with one smallest member go together: those of one group of near copies do.
    more = store.written(_across(members.where(F.col("n") > short_list).select("g", "rep").distinct(), labels, sets, percent, block), "links")
    if not more.isEmpty():
        joined = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
        store.drop(labels)
        labels = joined
    for table in (sets, links, more, lookup, sketch, members):
        store.drop(table)
    found = labels

    # Rows of a class with copies look up its smallest doc_id; large classes (at most 500) by broadcast, so no key is hot.
    copied = classes.where("copies > 1").withColumn("large", F.col("copies") * 500 > sk.count())
    key = ["key1", "key2", "n_shingles"]
    rows = sk.select("doc_id", *key)
    large = rows.join(F.broadcast(copied.where("large").select(*key, F.col("rep").alias("large_rep"))), key, "left")
    large = store.written(large, "rows")
    small = large.where("large_rep is null").join(copied.where("not large").select(*key, "rep"), key, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    rows = small.union(large.where("large_rep is not null").select("doc_id", "n_shingles", F.col("large_rep").alias("rep")))
    # A large class's rows share one rep: its label is found once for the class.
    big = copied.where("large").select("rep").distinct().join(found, F.col("rep") == F.col("node")).select(F.col("rep").alias("big"), F.col("label").alias("big_label"))
    out = rows.join(F.broadcast(big), F.col("rep") == F.col("big"), "left")
    out = store.written(out, "labelled")
    rest = out.where("big_label is null").join(found, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    done = rest.union(out.where("big_label is not null").select("doc_id", "n_shingles", F.col("big_label").alias("component_id")))
    done = store.written(done.withColumn("kept", F.col("doc_id") == F.col("component_id")), "components")
    for table in (sk, classes, labels, large, out):
        store.drop(table)
    return done


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays (five words, 0.8). Rows of one doc_id stay or go together; rows without one are no one's copy and stay."""
    del spark, sf_dir
    found = near_duplicates(docs, 5)
    gone = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select("doc_id")
    return matched(docs, gone, "left_anti").select(docs.columns)


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, four words, 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 4)


#: The same by a plain join of all shingles, one document for each set.
_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id::BIGINT AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')))) END AS x FROM d),
c AS (SELECT doc_id, len(x)::BIGINT AS n, CASE WHEN len(x) > 0 THEN min(doc_id) OVER (PARTITION BY x) ELSE doc_id END AS rep, x FROM s),
e AS (SELECT rep, n, unnest(x) AS g FROM c WHERE rep = doc_id AND n > 0),
link AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT DISTINCT a AS x, a AS y FROM link UNION SELECT r.x, l.b FROM reach r JOIN link l ON l.a = r.y),
low AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT c.doc_id, c.n AS n_shingles, coalesce(m, rep) AS component_id, coalesce(m, rep) = c.doc_id AS kept FROM c LEFT JOIN low ON low.x = c.rep
"""

QUERIES = {"op9_neardup": op9_neardup}
ORACLES = {"op9_neardup": _SQL}

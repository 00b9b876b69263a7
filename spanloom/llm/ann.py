"""Operator 5: approximate nearest neighbours by a forest of random-projection trees.

Each tree halves the rows again and again at the median of a random projection,
until leaves hold some ``LEAF_ROWS``. The first levels are fitted on a bounded sample
in memory; below them each part takes a sample of its own and is fitted where it
lies. Every row is routed to a leaf of every tree. A query walks all trees with one priority queue, nearest unexplored branch
first (by the summed squared margins of the planes it is on the wrong side of),
until the leaves that it has reached hold a certain share of all rows. Members
and queries meet by leaf, in chunks of bounded size, and candidates are ranked by
their exact inner product, equal ones by the smaller id. To make nearness by inner
product a matter of angles the vectors get one more component that fills all up to
one length; queries have length one without it.

How far to search depends on the data: vectors without structure need most of the
table, clustered ones little of it. So the share is measured: ``TRIALS`` queries are
answered exactly by one pass over all rows, and the share is the least at which the
queue would have found ``RECALL`` of their neighbours.

Equal vectors are one class with its smallest ids: no more of them can be among
anyone's nearest, and one popular vector fills no leaf. Equal queries are searched
once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import store
from .batches import column, record_batch

K, TREES, LEAF_ROWS, SEED = 20, 8, 1_000, 5
#: Rows that the planes' medians are taken from at most, and the rows of it that a node needs to be split.
SAMPLE, NODE_SAMPLE = 50_000, 8
#: Levels of a tree at most: a cut (4 bytes) and a count (8 bytes) for each of 2 ** MAX_DEPTH nodes of a tree go to every task.
MAX_DEPTH = 17
#: Queries that are answered exactly to measure how far to search, and the share of their neighbours to find.
TRIALS, RECALL = 100, 0.96
#: Rows and queries of a leaf that meet in one task, and pairs whose exact products are held at once.
MEMBER_CHUNK, QUERY_CHUNK, PAIRS = 4_096, 2_048, 100_000
#: Leaves up to which what a query found is merged at once.
FEW_LEAVES = 64


def _medians(value, level: int, depth: int, cuts: np.ndarray, node: np.ndarray) -> None:
    """Fills the ``cuts`` of the nodes from ``level`` to ``depth`` by medians; ``value(level, node)`` projects the rows that stand at ``node`` (moved on in place)."""
    for k in range(level, depth):
        v = value(k, node)
        order = np.lexsort((v, node))
        begin = np.flatnonzero(np.append(True, np.diff(node[order]) > 0))
        size = np.diff(np.append(begin, len(order)))
        cuts[node[order[begin]]] = (v[order[begin + size // 2]] + v[order[begin + (size - 1) // 2]]) / 2
        node[:] = 2 * node + (v > cuts[node])


class Forest:
    """Complete binary trees; node 1 is a root, node i has children 2i (below its cut) and 2i + 1.

    Above level ``base`` every node has a plane of its own; from there on the nodes
    of one level of a tree share one.
    """

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.base = self.depth = depth
        self.trees, self.dim, self.seed = trees, sample.shape[1], seed
        self.planes = self._unit(draw.normal(size=(trees, 1 << depth, self.dim)))
        self.shared = np.zeros((trees, 0, self.dim), np.float32)
        self.cuts = np.zeros((trees, 1 << depth), np.float32)
        for t in range(trees):
            if len(sample):
                _medians(lambda k, node, t=t: np.einsum("nd,nd->n", sample, self.planes[t, node]), 0, depth, self.cuts[t], np.ones(len(sample), np.int64))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=-1, keepdims=True)).astype(np.float32)

    def grow(self, depth: int) -> None:
        """More levels, with planes but with all cuts at 0."""
        self.shared = self._unit(np.random.default_rng([self.seed, 1]).normal(size=(self.trees, depth - self.base, self.dim)))
        cuts = np.zeros((self.trees, 1 << depth), np.float32)
        cuts[:, : 1 << self.base] = self.cuts
        self.depth, self.cuts = depth, cuts

    def leaves(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The leaf (from 0) of each row in each tree; with ``depth``, the node of that level."""
        depth = self.depth if depth is None else depth
        out = np.ones((self.trees, len(x)), np.int64)
        for t in range(self.trees):
            for k in range(depth):
                node = out[t]
                v = np.einsum("nd,nd->n", x, self.planes[t, node]) if k < self.base else x @ self.shared[t, k - self.base]
                out[t] = 2 * node + (v > self.cuts[t, node])
        return out - (1 << depth)

    def walk(self, q: np.ndarray, sizes: np.ndarray, rows: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of one queue over all trees, until the leaves hold ``rows`` rows."""
        below = self.shared @ q  # (trees, levels)
        queue = [(0.0, t, 1) for t in range(self.trees)]
        out, seen, leaf, top = [], 0, 1 << self.depth, 1 << self.base
        margin = np.einsum("tnd,d->tn", self.planes, q) if self.trees * top <= 20_000 else None
        while queue and seen < rows:
            cost, t, node = heapq.heappop(queue)
            while node < leaf:
                v = below[t, node.bit_length() - 1 - self.base] if node >= top else margin[t, node] if margin is not None else self.planes[t, node] @ q
                m = float(v - self.cuts[t, node])
                near = 2 * node + (m > 0)
                heapq.heappush(queue, (cost + m * m, t, near ^ 1))
                node = near
            out.append((t, node - leaf))
            seen += int(sizes[t, node - leaf])
        return out

    def needed(self, q: np.ndarray, sizes: np.ndarray, wanted: list[list[int]]) -> list[int]:
        """How many rows the queue must reach until it comes to each of the ``wanted`` rows, given by their leaf in each tree."""
        before, seen = {}, 0
        for t, leaf in self.walk(q, sizes, math.inf):
            before[t, leaf] = seen
            seen += int(sizes[t, leaf])
        return [1 + min(before[t, leaf] for t, leaf in enumerate(at)) for at in wanted]


def _valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v and its key: vectors that are not null or zero, hold only finite numbers and have the commonest length (the smallest of ties)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "n").first()
    return rows.where(F.size("v") == (length["n"] if length else 0)).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), F.col("v")))


def _matrix(cells, kind) -> np.ndarray:
    cells = list(cells)
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1).astype(np.float64)


_CLASS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("v", pa.binary()), ("ids", pa.list_(pa.int64())), ("asks", pa.bool_()), ("at", pa.list_(pa.int32()))])
_CLASS_SQL = "k1 long, k2 long, v binary, ids array<long>, asks boolean, at array<int>"


def _routed(classes: DataFrame, forest, longest: float, kind) -> DataFrame:
    """Classes with their leaf in every tree; vectors as bytes of their own type."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(column(batch, "v").to_pylist(), np.float64)
            at = forest.value.leaves(extended(x, longest)).T.astype(np.int32)
            yield record_batch(_CLASS, column(batch, "k1"), column(batch, "k2"), [r.tobytes() for r in x.astype(kind)], column(batch, "ids"), column(batch, "asks"), at.tolist())

    return classes.select("k1", "k2", "v", "ids", "asks").mapInArrow(run, _CLASS_SQL)


def _grown(classes: DataFrame, forest: Forest, depth: int, longest: float, total: int) -> Forest:
    """The forest with levels down to ``depth``: each part of the first levels is fitted in a task of its own, on some NODE_SAMPLE rows for each new leaf, of which only the projections are sent."""
    forest.grow(depth)
    levels, base = depth - forest.base, forest.base
    sent = classes.sparkSession.sparkContext.broadcast(forest)
    below = (NODE_SAMPLE << depth) / max(1, total) * 2.0**53
    sample = classes.where(F.shiftrightunsigned(F.xxhash64(F.lit(9), "k1", "k2"), 11) < below)
    schema = pa.schema([("tree", pa.int32()), ("part", pa.int64()), ("values", pa.list_(pa.float32()))])

    def project(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                x = extended(np.array(column(batch, "v").to_pylist(), np.float64), longest)
                part = sent.value.leaves(x, base)
                for t in range(len(part)):
                    yield record_batch(schema, np.full(len(x), t), part[t], (x @ sent.value.shared[t].T).tolist())

    def fit(rows: pa.Table) -> pa.Table:
        values = np.array(rows["values"].to_pylist(), np.float32)
        cuts = np.full(1 << levels, np.nan, np.float32)
        _medians(lambda k, _: values[:, k], 0, levels, cuts, np.ones(len(values), np.int64))
        own = np.flatnonzero(~np.isnan(cuts))
        level = np.floor(np.log2(own)).astype(np.int64)
        root = (1 << base) + rows["part"][0].as_py()
        node = (root << level) + own - (1 << level)
        return pa.table({"tree": pa.array(np.full(len(own), rows["tree"][0].as_py(), np.int32)), "node": pa.array(node), "cut": pa.array(cuts[own])})

    found = sample.select("v").mapInArrow(project, "tree int, part long, values array<float>").groupBy("tree", "part").applyInArrow(fit, "tree int, node long, cut float").toArrow()
    forest.cuts[found["tree"].to_numpy(), found["node"].to_numpy()] = found["cut"].to_numpy()
    return forest


def extended(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors over the longest one's length, with the component that makes each as long."""
    x = x / longest
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))]).astype(np.float32)


def directions(x: np.ndarray) -> np.ndarray:
    """Queries at length one, so their margins rank branches by angle, however long the longest vector is; their extra component is 0."""
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.hstack([x, np.zeros((len(x), 1))]).astype(np.float32)


_BEST = pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())]))
_RANKED = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("part", pa.int32()), ("best", _BEST)])


def _products(a: np.ndarray, b: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each row of ``a`` every row of ``b`` that may be among its ``k`` largest inner products, in blocks: places in a and b, and the exact products.

    A matrix product bounds them: whoever is below the k-th by more than rounding
    can make, is out. Exact sums run in one order for a pair, wherever it meets.
    """
    rough = a @ b.T
    n = min(len(b), k)
    kth = np.partition(rough, len(b) - n, axis=1)[:, len(b) - n]
    slack = 8 * a.shape[1] * np.finfo(float).eps * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max()
    near = rough >= (kth - slack)[:, None]
    size = np.cumsum(near.sum(1))
    low = 0
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + PAIRS, "right")))
        i, j = np.nonzero(near[low:high])
        yield i + low, j, (a[i + low] * b[j]).sum(1)
        low = high


def _ranked(rows: pa.Table, k: int, kind, part: int) -> pa.Table:
    """Of one chunk of a leaf: each query's best ids by exact inner product (as its negative, so that order is ascending)."""
    asking = pc.fill_null(rows["asking"], False)
    q, m = rows.filter(asking), rows.filter(pc.invert(asking))
    if not q.num_rows or not m.num_rows:
        return _RANKED.empty_table()
    ids = m["ids"].combine_chunks()
    many, values = pc.list_value_length(ids).to_numpy(zero_copy_only=False), pc.list_flatten(ids).to_numpy(zero_copy_only=False)
    start = np.cumsum(many) - many
    counts, found, negative = np.zeros(q.num_rows, np.int64), [], []
    for i, j, exact in _products(_matrix(q["v"].to_pylist(), kind), _matrix(m["v"].to_pylist(), kind), k + 1):
        n = many[j]
        own = values[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[j], n)]
        i, minus = np.repeat(i, n), np.repeat(-exact, n)
        order = np.lexsort((own, minus, i))
        i = i[order]
        first = np.searchsorted(i, i, "left")
        order = order[np.arange(len(i)) - first <= k]
        counts += np.minimum(np.bincount(i, minlength=len(counts)), k + 1)
        found.append(own[order])
        negative.append(minus[order])
    cut = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    cells = pa.StructArray.from_arrays([pa.array(np.concatenate(negative)), pa.array(np.concatenate(found))], ["s", "id"])
    return pa.Table.from_arrays([q["k1"].combine_chunks(), q["k2"].combine_chunks(), pa.array(np.full(q.num_rows, part, np.int32)), pa.ListArray.from_arrays(cut, cells)], schema=_RANKED)


def _share(routed: DataFrame, forest, sizes: np.ndarray, total: int, k: int, trials: int, recall: float, kind) -> float:
    """The share of all rows that queries must reach to find ``recall`` of their ``k`` nearest: measured on the ``trials`` queries of the lowest hash, against all rows."""
    rows = routed.where("asks").orderBy(F.xxhash64("k1", "k2")).limit(trials).select("k1", "k2", "v").collect()
    if not rows:
        return 1.0
    asked, keys = _matrix([r["v"] for r in rows], kind), np.array([(r["k1"], r["k2"]) for r in rows])
    schema = pa.schema([("q", pa.int32()), ("s", pa.float64()), ("at", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([column(batch, "k1").to_numpy(), column(batch, "k2").to_numpy()], 1)
            score = asked @ _matrix(column(batch, "v").to_pylist(), kind).T
            score[(keys[:, None, :] == own[None, :, :]).all(2)] = -np.inf
            n = min(k, score.shape[1])
            best = np.argpartition(-score, n - 1, axis=1)[:, :n]
            at = column(batch, "at").take(pa.array(best.ravel()))
            yield record_batch(schema, np.repeat(np.arange(len(rows)), n), -np.take_along_axis(score, best, 1).ravel(), at)

    nearest_ = routed.select("k1", "k2", "v", "at").mapInArrow(run, "q int, s double, at array<int>").where("s < double('Infinity')")
    w = Window.partitionBy("q").orderBy("s", "at")
    nearest_ = nearest_.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    wanted: dict[int, list[list[int]]] = {}
    for r in nearest_.select("q", "at").collect():  # at most trials * k rows
        wanted.setdefault(r["q"], []).append(r["at"])
    x = directions(asked)
    need = sorted(n for i, at in wanted.items() for n in forest.needed(x[i], sizes, at))
    return need[min(len(need) - 1, math.ceil(recall * len(need)))] / max(1, total) if need else 1.0


def nearest(vectors: DataFrame, is_query, k: int = K, trees: int = TREES, leaf_rows: int = LEAF_ROWS, recall: float = RECALL, trials: int = TRIALS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row for which the Column ``is_query`` (over vec_id) holds; of equal scores the smaller ids.

    A ``recall`` of 1 searches every leaf. Null, zero and non-finite vectors and
    those of another length than most take no part; with fewer than ``k`` others all are returned; an empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else np.float64
    rows = _valid(vectors)
    order = Window.partitionBy("k1", "k2").orderBy("vec_id")
    # k + 1 ids of equal vectors: enough for any query, itself left out. Each task first drops all but its own k + 1.
    few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    asked = rows.where(is_query)
    asking = asked.select("k1", "k2").distinct().withColumn("asks", F.lit(True))
    classes = few.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.array_sort(F.collect_set("vec_id")).alias("ids")).join(asking, ["k1", "k2"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    classes = store.written(classes, "classes")
    stats = classes.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("square")).first()
    total, longest = stats["n"], math.sqrt(stats["square"] or 1.0)
    sample = classes.orderBy(F.xxhash64("k1", "k2")).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sample = sample.flatten().to_numpy().reshape(len(sample), -1) if total else np.zeros((1, 1))
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, total) / leaf_rows))))
    base = min(depth, int(math.log2(max(1, len(sample) / NODE_SAMPLE))))
    forest = Forest(extended(sample, longest), trees, base)
    if base < depth:
        forest = _grown(classes, forest, depth, longest, total)
    sent = spark.sparkContext.broadcast(forest)
    routed = store.written(_routed(classes, sent, longest, kind), "routed")
    store.drop(classes)

    # One row a leaf: at most trees << MAX_DEPTH.
    members = routed.select("k1", "k2", "v", "ids", F.posexplode("at").alias("tree", "leaf"))
    counts = members.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    sizes = np.zeros((trees, 1 << depth), np.int64)
    held = counts.toArrow()
    fold = math.isqrt(held.num_rows) if held.num_rows > FEW_LEAVES else 1
    sizes[held["tree"].to_numpy(), held["leaf"].to_numpy()] = held["n"].to_numpy()
    reach = spark.sparkContext.broadcast((sizes, math.inf if recall >= 1 else total * _share(routed, forest, sizes, total, k, trials, recall, kind)))
    visit = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("tree", pa.int32()), ("leaf", pa.int32())])

    def walk(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            vectors_ = column(batch, "v").to_pylist()
            if not vectors_:
                continue
            x = directions(_matrix(vectors_, kind))
            for i, key in enumerate(zip(column(batch, "k1").to_pylist(), column(batch, "k2").to_pylist(), strict=True)):
                places = sent.value.walk(x[i], *reach.value)
                n = len(places)
                yield record_batch(visit, [key[0]] * n, [key[1]] * n, [p[0] for p in places], [p[1] for p in places])

    visits = routed.where("asks").select("k1", "k2", "v").repartition("k1", "k2").mapInArrow(walk, "k1 long, k2 long, tree int, leaf int")
    visits = store.written(visits, "visits")
    plan = counts.join(visits.groupBy("tree", "leaf").agg(F.count("*").alias("q")), ["tree", "leaf"])
    plan = F.broadcast(plan.select("tree", "leaf", F.ceil(F.col("n") / MEMBER_CHUNK).cast("int").alias("mc"), F.ceil(F.col("q") / QUERY_CHUNK).cast("int").alias("qc")))
    number = lambda n: F.pmod(F.xxhash64("k2"), F.col(n).cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(plan, ["tree", "leaf"]).select("tree", "leaf", "k1", "k2", "v", "ids", F.lit(False).alias("asking"), number("mc").alias("m"), each("qc").alias("q"))
    # Vectors of queries join their visits only now, by query and chunk.
    right = visits.join(plan, ["tree", "leaf"]).join(routed.where("asks").select("k1", "k2", "v"), ["k1", "k2"]).select("tree", "leaf", "k1", "k2", "v", F.lit(None).cast("array<long>").alias("ids"), F.lit(True).alias("asking"), each("mc").alias("m"), number("qc").alias("q"))
    by_leaf = left.unionByName(right).groupBy("tree", "leaf", "m", "q").applyInArrow(lambda key, t: _ranked(t, k, kind, (key[0].as_py() * 7_919 + key[1].as_py()) % fold), "k1 long, k2 long, part int, best array<struct<s:double,id:long>>")
    # One row of a member stands in each tree once, so k + 1 different ones are among so many.
    # A query's leaves are merged by parts first: no list holds more than the root of their number, times k + 1.
    top = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, (k + 1) * trees)
    best = by_leaf.groupBy("k1", "k2", "part").agg(F.slice(F.array_distinct(top), 1, k + 1).alias("best")) if fold > 1 else by_leaf
    best = store.written(best.groupBy("k1", "k2").agg(F.slice(F.array_distinct(top), 1, k + 1).alias("best")), "best")
    store.drop(routed)
    store.drop(visits)
    own = asked.select(F.col("vec_id").alias("query_id"), "k1", "k2").join(best, ["k1", "k2"])
    others = F.slice(F.filter("best", lambda p: p["id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("pos", "p")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("p.id").alias("vec_id"), (-F.col("p.s")).alias("score"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all of ``embeddings``."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


QUERIES = {"op5_ann": op5_ann}
ORACLES: dict[str, str] = {}

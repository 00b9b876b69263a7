"""Scans split in ranges give what plain windows give: on their own, and under every query that uses them."""

import glob
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.operators import scans as sc
from spanloom.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
#: Queries over the events of clips.
SPLIT = [
    "segment_timeline", "session_events", "throttle_events", "capped_clusters", "last_index_cluster", "boolean_runs", "infer_goals", "period_numbers", "counter_steps", "adjacent_chances",
    "empty_sentinel", "reel_timeline", "select_reel", "reel_groups",
]


def every():
    return {
        "n": sc.row_number(), "total": sc.running_sum("v"), "so_far": sc.sum_before("v"), "reach": sc.max_before("v"), "top": sc.whole_max("v"), "low": sc.whole_min("v"), "whole": sc.whole_sum("v"),
        "last": sc.last_before("v"), "next": sc.next_after("v"), "lag": sc.lag("v"), "lead": sc.lead("v"), "pair": sc.last_before(F.when(F.col("v") > 5, F.struct("v", "t"))),
    }


@pytest.mark.parametrize("seed", range(3))
def test_split_scans_equal_plain_windows(spark, seed):
    draw = random.Random(seed)
    data = [(c, t, draw.choice([None, *range(10)])) for c, n in ((1, 40), (2, 3), (3, 1), (None, 17), (5, 9)) for t in draw.sample(range(500), n)]
    df = spark.createDataFrame(data, "c long, t long, v long")
    cut = sc.ranged(df, ["c"], "t", 3)
    assert sc.PART in cut.columns and cut.where("c = 1").select(sc.PART).distinct().count() > 8
    assert cut.where("c = 2").select(sc.PART).distinct().count() == 1
    plain, split = (sorted(map(repr, sc.scan(x, ["c"], ["t"], every()).select("c", "t", "v", *every()).collect())) for x in (df, cut))
    assert plain == split


def test_texts_are_cut_by_what_follows_their_common_beginning(spark):
    draw = random.Random(1)
    names = sorted({f"raw/match 7/scene-{draw.randrange(10**6)}{draw.choice(['', 'é', 'x', '日本'])}.mp4" for _ in range(300)}, key=str.encode)
    df = spark.createDataFrame([("a", n) for n in names] + [("b", "z"), ("b", "")], "g string, n string").repartition(3)
    cut = sc.ranged(df, ["g"], "n", 30)
    sizes = [r["count"] for r in cut.where("g = 'a'").groupBy(sc.PART).count().collect()]
    assert len(sizes) >= 9 and max(sizes) <= 45 and cut.columns == ["g", "n", sc.PART]
    got = sc.scan(cut, ["g"], ["n"], {"pos": sc.row_number()}).where("g = 'a'").orderBy("pos").collect()
    assert [r.n for r in got] == names and [r.pos for r in got] == list(range(1, len(names) + 1))


def test_short_groups_are_not_cut(spark):
    df = spark.createDataFrame([(i % 40, i) for i in range(200)], "c long, t long")
    assert sc.ranged(df, ["c"], "t", 10).columns == ["c", "t"]
    assert sc.ranged(df, ["c"], "t").columns == ["c", "t"]
    assert sc.ranged(df.where("t < 0"), ["c"], "t", 1).columns == ["c", "t"]


def test_equal_times_stay_together_and_a_range_holds_a_bounded_share(spark):
    df = spark.createDataFrame([(1, i // 2) for i in range(1_000)] + [(2, 7)] * 3, "c long, t long")
    parts = sc.ranged(df, ["c"], "t", 100).groupBy("c", "t").agg(F.countDistinct(sc.PART).alias("k")).where("k > 1")
    assert parts.count() == 0
    sizes = [r["count"] for r in sc.ranged(df, ["c"], "t", 100).where("c = 1").groupBy(sc.PART).count().collect()]
    assert len(sizes) >= 9 and max(sizes) <= 140


def test_a_hot_clip_is_no_large_task(spark):
    """Half of all rows are one clip's: after the split no task has twice the rows of the median."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(1 + F.col("id") % 64).alias("c"), F.col("id").alias("t"), (F.col("id") % 7).alias("v"))
    cut = sc.ranged(rows, ["c"], "t", 500)
    sizes = cut.groupBy("c", sc.PART).count()
    most, middle = sizes.agg(F.max("count"), F.median("count")).first()
    assert most <= 2 * middle
    plan = sc.scan(cut, ["c"], ["t"], {"n": sc.row_number()})._jdf.queryExecution().toString()
    assert "windowspecdefinition(c#" in plan and f"{sc.PART}#" in plan


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in SPLIT if n in ORACLES])
def test_queries_give_the_same_rows_when_clips_are_split(spark, duck, monkeypatch, name):
    monkeypatch.setattr(sc, "ROWS", 15)
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    got, want = (f[columns].sort_values(columns, ignore_index=True) for f in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)

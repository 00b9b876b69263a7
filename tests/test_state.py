"""State that survives runs and batches: jobs against a loop over all their events, timers against what a quiet clip leaves."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanloom.streaming import state as js
from spanloom.streaming import streams as st
from spanloom.streaming import timers as tm


def plain(events):
    jobs = {}
    for v, at, kind, title, source, reel, text, error in sorted(events, key=lambda e: e[1]):
        if kind not in js.STATUS:
            continue
        job = {} if kind == "started" else jobs.get(v, {})
        job |= {k: x for k, x in zip(("title", "local_source", "reel_path", "description_path"), (title, source, reel, text)) if x is not None}
        job |= {"status": js.STATUS[kind], "at": at}
        if kind != "finished":
            job["error"] = error if kind in ("not_sent", "broken") else None
        jobs[v] = job
    names = ("status", "title", "local_source", "reel_path", "description_path", "error", "at")
    return sorted((v, *(j.get(n) for n in names)) for v, j in jobs.items())


def draws(n, seed):
    draw = random.Random(seed)
    maybe = lambda x: draw.choice([None, x, x])
    return [(f"v{draw.randrange(7)}", at, draw.choice([*js.STATUS, "sent", "finished", "odd"]), maybe(f"t{at}"), maybe(f"s{at}"), maybe(f"r{at}"), maybe(f"d{at}"), maybe(f"e{at}")) for at in range(n)]


def rows(df):
    return sorted(tuple(r) for r in df.select("video_id", "status", "title", "local_source", "reel_path", "description_path", "error", "at").collect())


@pytest.mark.parametrize("buckets", [1, 5])
def test_state_of_jobs_over_batches_repeated_and_broken_off(spark, tmp_path, monkeypatch, buckets):
    events = draws(60, buckets)
    table = js.StateTable(spark, f"file://{tmp_path}/state", buckets)
    assert table.read().count() == 0
    cuts = [0, 1, 17, 40, 40, 60]
    swap = js.StateTable.swap
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = spark.createDataFrame(events[a:b], js.EVENT)
        if n == 2:  # broken off after all rows are written, before the rename
            monkeypatch.setattr(js.StateTable, "swap", lambda *_: (_ for _ in ()).throw(OSError("broken off")))
            with pytest.raises(OSError):
                table.merge(batch, n)
            assert rows(table.read()) == plain(events[:a])
            monkeypatch.setattr(js.StateTable, "swap", swap)
        for _ in range(2 if n != 3 else 1):  # the second time finds the version there
            table.merge(batch, n)
        assert rows(table.read()) == plain(events[:b])
    table.merge(spark.createDataFrame(events[:30], js.EVENT), 9)  # what was seen before changes nothing
    assert rows(table.read()) == plain(events)


def test_a_stream_of_job_events_goes_on_where_it_stopped(spark, tmp_path):
    events = draws(40, 3)
    table = js.StateTable(spark, f"file://{tmp_path}/state", 3)
    for part in (events[:15], events[15:]):
        for lo in range(0, len(part), 6):
            spark.createDataFrame(part[lo : lo + 6], js.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            time.sleep(0.02)
        table.follow(st.read_stream(spark, f"{tmp_path}/in", js.EVENT, 1))
        assert rows(table.read()) == plain([e for e in events if e in part or e in events[:15]])
    assert len(table.versions()) >= 4


@pytest.fixture
def timed(spark):
    with tm.settings(spark):
        yield spark


S, BASE = 1_000_000, 10**12  # a watermark begins at 0


def arrive(spark, path, schema, batches):
    for rows_ in batches:
        df = spark.createDataFrame([(k, t + BASE, *rest) for k, t, *rest in rows_], schema)
        df.withColumn("ts", F.timestamp_micros("t_us")).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)




def test_a_quiet_clip_keeps_no_state_and_late_hits_are_told(timed, tmp_path):
    batches = [[(1, 0, 0), (1, 4 * S, 1)], [(1, 11 * S, 2), (2, 12 * S, 3)], [(1, 10 * S, 4), (2, 15 * S, 5)], [(3, 100 * S, 6)], [(1, 101 * S, 7), (3, 103 * S, 8)], [(4, 300 * S, 9)]]
    arrive(timed, f"{tmp_path}/in", "clip_id long, t_us long, event_id long", batches)
    stream = st.read_stream(timed, f"{tmp_path}/in", "clip_id long, t_us long, event_id long, ts timestamp", 1)
    out = st.run_once(tm.throttle(stream, "clip_id", "t_us", "event_id", "ts", 10 * S, "5 seconds"), str(tmp_path))
    assert sorted((r.event_id, r.late) for r in out.collect()) == [(0, False), (2, False), (3, False), (4, True), (6, False), (7, False), (9, False)]


def test_the_last_value_of_a_quiet_clip_is_accepted(timed, tmp_path):
    batches = [[(1, 0, 5), (1, S, 5)], [(1, 2 * S, 6), (1, 3 * S, 6)], [(1, 4 * S, 8), (1, S, 9)], [(2, 60 * S, 1)], [(1, 70 * S, 3), (1, 71 * S, 3)], [(2, 200 * S, 1)]]
    arrive(timed, f"{tmp_path}/in", "clip_id long, t_us long, v long", batches)
    stream = st.read_stream(timed, f"{tmp_path}/in", "clip_id long, t_us long, v long, ts timestamp", 1)
    out = st.run_once(tm.counter(stream, "clip_id", "t_us", "v", "ts", 2, 20 * S, "10 seconds"), str(tmp_path))
    assert sorted((r.t_us - BASE, r.v, r.step, r.late) for r in out.collect()) == [(S, 9, None, True), (2 * S, 6, 1, False), (4 * S, 8, 2, False)]

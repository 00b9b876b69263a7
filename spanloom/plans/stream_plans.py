"""Queries that run a stream over what is there, and of sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..shared import shared_dir
from ..sources import media
from ..streaming import state as js
from ..streaming import streams as st
from ..streaming import timers as tm
from . import event_plans
from .base import HIT, SEG, S, micros, segments, table
from .sequence_plans import ORACLES as SEQUENCE

#: 2024-01-16 00:00:00 in microseconds.
SETTLE_NOW = 1_705_363_200_000_000


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.read_stream(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
    return rows.select(F.col("user_id").alias("clip_id"), micros("ts").alias("t_us"), "event_id", "ts", F.floor("value").cast("long").alias("v"))


def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.run_once(st.throttle(_stream(spark, sf_dir), "clip_id", "t_us", "event_id", event_plans.DAY), shared_dir(spark))


def stream_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 20).cast("long"))
    return st.run_once(st.counter(rows, "clip_id", "t_us", "v", 2), shared_dir(spark))


def stream_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files last written at their time: taken, or left waiting for the next run, at one moment of the month."""
    rows = _stream(spark, sf_dir).select("event_id", "t_us")
    settled, waiting = st.settle(rows, "t_us", S, f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}", lambda: SETTLE_NOW)
    return settled.select("event_id", F.lit(1).alias("taken")).unionByName(waiting.select("event_id", F.lit(0).alias("taken")))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions: those that the watermark has passed."""
    r = st.run_once(st.sessions(_stream(spark, sf_dir), ["clip_id"], "ts", "24 hours", "1 hour"), shared_dir(spark))
    return r.select("clip_id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "n")


def stream_counter_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter with timers: a clip that is quiet for a day is over, its last value is accepted, and it starts anew."""
    rows = _stream(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 20).cast("long"))
    with tm.settings(spark):
        out = st.run_once(tm.counter(rows, "clip_id", "t_us", "v", "ts", 2, event_plans.DAY, "1 hour"), shared_dir(spark))
    return out.withColumn("late", F.col("late").cast("int"))


JOB_KINDS = {"signup": "started", "view": "finished", "click": "not_sent", "error": "broken", "purchase": "sent"}


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state table that a stream of job events leaves: every user is a job, every event changes its state."""
    rows = st.read_stream(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
    kind, e = F.create_map(*[F.lit(x) for pair in JOB_KINDS.items() for x in pair])[F.col("event_type")], F.col("event_id").cast("string")
    told = lambda k, text: F.when(F.col("event_type") == k, F.concat(F.lit(text), e))
    events = rows.select(
        F.concat(F.lit("local-"), F.col("user_id").cast("string")).alias("video_id"), F.col("event_id").alias("at"), kind.alias("kind"), told("signup", "title ").alias("title"), told("signup", "raw/").alias("local_source"),
        told("view", "exports/").alias("reel_path"), F.when(F.col("event_id") % 2 == 0, told("view", "text/")).alias("description_path"), F.coalesce(told("click", "token "), told("error", "code ")).alias("error"),
    )
    jobs = js.StateTable(spark, f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}", 8)
    jobs.follow(events)
    return jobs.read().withColumnRenamed("at", "last_event")


def uniform_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    a = media.uniform_samples(F.lit(0), F.col("dur_us"), 5)
    return s.select("clip_id", "seq", F.posexplode(a).alias("i", "at_us")).select("clip_id", "seq", F.col("i").cast("long").alias("i"), "at_us")


def pad_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths of each conversation's first six turns; of fewer the last one is repeated."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("l"), n.alias("n")).where("n <= 6")
    c = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "l"))), lambda x: x["l"]).alias("f"))
    return c.select("conv_id", F.array_join(media.pad_frames(F.col("f"), 6), ",").alias("frames"))


def edit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumn("made", F.when(F.col("seq") % 3 > 0, F.concat(F.lit("made/"), F.col("seq").cast("string")))).withColumn("source", F.concat(F.lit("source/"), F.col("clip_id").cast("string")))
    return media.edit_list(s.where("conf >= 0.5"), ["clip_id"], "seq", "made", "start_us", "end_us", "source")


def timeline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report of each clip's confident segments."""
    s = segments(spark, sf_dir).where("conf >= 0.8")
    code = lambda c: tx.timecode(F.floor(F.col(c) / S))
    return media.timeline_text(s, ["clip_id"], "seq", code("start_us"), code("end_us"), F.col("label"))


HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


def _counter_sql() -> str:
    """The batch counter's SQL over places in time, without confirmation by a missing row."""
    return f"SELECT c.clip_id, s.t_us, c.v, c.step FROM ({SEQUENCE['counter_steps'].replace(', true) AS ok', ', false) AS ok')}) c JOIN (WITH {SEG} SELECT clip_id, seq, t_us FROM seg) s USING (clip_id, seq)"


ORACLES = {
    "stream_throttle": event_plans.ORACLES["throttle_events"],
    # As in the batch scan, but the last row of all is not confirmed.
    "stream_counter": _counter_sql(),
    "stream_counter_timed": f"""WITH RECURSIVE {HIT}, {event_plans._LABELLED}, q AS (SELECT *, floor(value / 20)::BIGINT AS v, row_number() OVER (PARTITION BY clip_id, session ORDER BY t_us) AS n, session < max(session) OVER (PARTITION BY clip_id) OR (max(t_us) OVER (PARTITION BY clip_id) + {DAY_US}) // 1000 + 1 <= max(t_us) OVER () // 1000 - 3600000 AS closed FROM sess),
      s AS (SELECT clip_id, session, t_us, v, n, coalesce(lead(v) OVER (PARTITION BY clip_id, session ORDER BY t_us) BETWEEN v AND v + 1, closed) AS ok FROM q),
      walk AS (SELECT clip_id, session, n, t_us, NULL::BIGINT AS cur, v AS pend, NULL::BIGINT AS hit, NULL::BIGINT AS diff FROM s WHERE n = 1
        UNION ALL SELECT clip_id, session, n, t_us, CASE WHEN cur IS NULL THEN CASE WHEN v = pend THEN v END WHEN acc THEN v ELSE cur END, v, CASE WHEN acc THEN v END, CASE WHEN acc THEN v - cur END
        FROM (SELECT b.*, a.cur, a.pend, coalesce(b.v - a.cur BETWEEN 1 AND 2 AND b.ok, false) AS acc FROM walk a JOIN s b ON b.clip_id = a.clip_id AND b.session = a.session AND b.n = a.n + 1))
      SELECT clip_id, t_us, hit AS v, diff AS step, 0 AS late FROM walk WHERE hit IS NOT NULL""",
    "job_states": """WITH e AS (SELECT 'local-' || user_id AS video_id, event_id AS n, event_type AS k FROM events), s AS (SELECT *, max(n) FILTER (k = 'signup') OVER (PARTITION BY video_id) AS st FROM e), c AS (SELECT * FROM s WHERE st IS NULL OR n >= st)
      SELECT video_id, CASE arg_max(k, n) WHEN 'signup' THEN 'processing' WHEN 'view' THEN 'uploading' WHEN 'click' THEN 'upload_failed' WHEN 'error' THEN 'error' ELSE 'done' END AS status, 'title ' || max(st) AS title, 'raw/' || max(st) AS local_source,
        'exports/' || max(n) FILTER (k = 'view') AS reel_path, 'text/' || max(n) FILTER (k = 'view' AND n % 2 = 0) AS description_path,
        CASE arg_max(k, n) FILTER (k <> 'view') WHEN 'click' THEN 'token ' || max(n) FILTER (k <> 'view') WHEN 'error' THEN 'code ' || max(n) FILTER (k <> 'view') END AS error, max(n) AS last_event FROM c GROUP BY video_id""",
    "stream_settled": f"WITH {HIT} SELECT event_id, ({SETTLE_NOW} - t_us >= {S})::INT AS taken FROM hit",
    "stream_sessions": f"""WITH {HIT}, s AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY clip_id ORDER BY t_us) >= {DAY_US} THEN 1 ELSE 0 END AS new FROM hit))
      SELECT clip_id, min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS n FROM s GROUP BY clip_id, session HAVING max(t_us) + {DAY_US} <= (SELECT max(t_us) FROM hit) - {HOUR_US}""",
    "uniform_samples": f"WITH {SEG} SELECT clip_id, seq, i, floor(i * dur_us / 4)::BIGINT AS at_us FROM (SELECT *, unnest(range(0, 5)) AS i FROM seg)",
    "pad_frames": "WITH f AS (SELECT conv_id, list(length(text) ORDER BY turn) AS f FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(list_transform(range(1, 7), lambda i: f[least(i, len(f))]), ',') AS frames FROM f",
    "edit_decisions": f"WITH {SEG} SELECT clip_id, seq AS pos, CASE WHEN seq % 3 > 0 THEN 'made/' || seq ELSE 'source/' || clip_id END AS path, start_us, end_us FROM seg WHERE conf >= 0.5",
    "timeline_report": f"""WITH {SEG}, t AS (SELECT clip_id, seq, label, start_us // {S} AS a, end_us // {S} AS b, row_number() OVER (PARTITION BY clip_id ORDER BY seq) AS n FROM seg WHERE conf >= 0.8),
      c AS (SELECT *, lpad((a // 60)::VARCHAR, greatest(2, length((a // 60)::VARCHAR)::INT), '0') || ':' || lpad((a % 60)::VARCHAR, 2, '0') AS x, lpad((b // 60)::VARCHAR, greatest(2, length((b // 60)::VARCHAR)::INT), '0') || ':' || lpad((b % 60)::VARCHAR, 2, '0') AS y FROM t)
      SELECT clip_id, string_agg(lpad(n::VARCHAR, greatest(2, length(n::VARCHAR)::INT), ' ') || '  ' || x || ' - ' || y || '  ' || label, chr(10) ORDER BY seq) AS text FROM c GROUP BY clip_id""",
}
QUERIES = {name: globals()[name] for name in ORACLES}

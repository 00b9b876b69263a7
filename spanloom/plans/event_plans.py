"""Queries of the event-collapse operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators.scans import split
from .base import HIT, SEG, WIDTH, S, hits, segments, width

DAY = 24 * S


def sample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval samples and four even samples of every segment."""
    s = segments(spark, sf_dir).where("dur_us > 0")
    step = s.select("clip_id", "seq", F.lit("step").alias("kind"), F.posexplode(F.sequence(F.lit(0), F.col("dur_us") - 1, F.lit(10 * S))).alias("i", "at_us"))
    even = s.select("clip_id", "seq", F.lit("even").alias("kind"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.floor(i * F.col("dur_us") / 3))).alias("i", "at_us"))
    return step.unionByName(even).select("clip_id", "seq", "kind", F.col("i").cast("long").alias("i"), F.col("at_us").cast("long").alias("at_us"))


def threshold_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label-dependent confidence gate."""
    bar = F.when(F.col("label") == "scoring_chance", 0.7).otherwise(0.55)
    return hits(spark, sf_dir).where(F.col("label").isin("goal", "scoring_chance", "goal_replay", "other") & (F.col("conf") >= bar)).select("clip_id", "event_id", "label", "conf")


def segment_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("clip_id", "seq", "label", "dur_us", "start_us", "end_us")


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ev.sessions(hits(spark, sf_dir), ["clip_id"], "t_us", DAY)
    return s.groupBy("clip_id", "session").agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count("*").alias("n"))


def throttle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.throttle(hits(spark, sf_dir).select("clip_id", "t_us", "event_id"), ["clip_id"], "t_us", DAY, ["event_id"])


def throttle_keyed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.throttle_runs(hits(spark, sf_dir).select("clip_id", "t_us", "event_id", "label"), ["clip_id"], "t_us", ["label"], 15 * S, ["event_id"])


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hit as a window of two to ten seconds."""
    rows = hits(spark, sf_dir)
    return rows.select("clip_id", F.col("t_us").alias("s"), (F.col("t_us") + width()).alias("e"), "conf", (F.col("label") == "goal").alias("primary"), *split(rows))


def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.union_intervals(_windows(spark, sf_dir), ["clip_id"], "s", "e", S).withColumn("primary", F.col("primary").cast("int"))


def capped_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.capped_clusters(_windows(spark, sf_dir), ["clip_id"], "s", "e", "conf", 4 * S, 20 * S)


def fold_or_abut(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = hits(spark, sf_dir).select("clip_id", (F.col("t_us") - 5 * S).alias("s"), (F.col("t_us") + 3 * S).alias("e"))
    return ev.fold_or_abut(shots, ["clip_id"], "s", "e", 20 * S, S)


def last_index_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ev.last_cluster(segments(spark, sf_dir), ["clip_id"], "seq", F.col("label") == "goal", 5).where("in_last_cluster is not null")
    return r.select("clip_id", "seq", F.col("in_last_cluster").cast("int").alias("kept"))


def boolean_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ev.boolean_runs(segments(spark, sf_dir), ["clip_id"], "seq", "t_us", F.col("value") > 30, "value", least=2 * S)
    return r.select("clip_id", "start_us", "end_us", F.round("energy", 6).alias("energy"))


def group_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.middle(ev.sessions(hits(spark, sf_dir), ["clip_id"], "t_us", DAY), ["clip_id", "session"], "t_us").select("clip_id", "session", "event_id", "t_us")


def greedy_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.greedy_peaks(hits(spark, sf_dir).select("clip_id", "t_us", "value"), ["clip_id"], "t_us", "value", 40 * S, 3)


def virtual_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.virtual_steps(segments(spark, sf_dir), ["clip_id"], "seq", F.col("label") == "goal_replay").select("clip_id", "seq", "step")


def last_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.last_of_kind(segments(spark, sf_dir), ["clip_id"], "seq", "label", ["goal", "other"]).select("clip_id", "seq", "label")


_LABELLED = f"sess AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY t_us ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY clip_id ORDER BY t_us) > {DAY} THEN 1 ELSE 0 END AS new FROM hit))"
_NUM = "num AS (SELECT clip_id, t_us, event_id, label, conf, row_number() OVER (PARTITION BY clip_id ORDER BY t_us, event_id) AS n FROM hit)"

ORACLES = {
    "sample_grid": f"""WITH {SEG} SELECT clip_id, seq, 'step' AS kind, i, i * {10 * S} AS at_us FROM (SELECT *, unnest(range(0, (dur_us - 1) // {10 * S} + 1)) AS i FROM seg WHERE dur_us > 0)
      UNION ALL SELECT clip_id, seq, 'even', i, floor(i * dur_us / 3)::BIGINT FROM (SELECT *, unnest(range(0, 4)) AS i FROM seg WHERE dur_us > 0)""",
    "threshold_hits": f"WITH {HIT} SELECT clip_id, event_id, label, conf FROM hit WHERE label IN ('goal', 'scoring_chance', 'goal_replay', 'other') AND conf >= CASE WHEN label = 'scoring_chance' THEN 0.7 ELSE 0.55 END",
    "segment_timeline": f"WITH {SEG} SELECT clip_id, seq, label, dur_us, start_us, end_us FROM seg",
    "session_events": f"WITH {HIT}, {_LABELLED} SELECT clip_id, session, min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS n FROM sess GROUP BY ALL",
    "throttle_events": f"""WITH RECURSIVE {HIT}, {_NUM}, walk AS (SELECT clip_id, n, t_us, event_id, t_us AS kept, true AS keep FROM num WHERE n = 1
      UNION ALL SELECT b.clip_id, b.n, b.t_us, b.event_id, CASE WHEN b.t_us - a.kept > {DAY} THEN b.t_us ELSE a.kept END, b.t_us - a.kept > {DAY} FROM walk a JOIN num b ON a.clip_id = b.clip_id AND b.n = a.n + 1)
      SELECT clip_id, t_us, event_id FROM walk WHERE keep""",
    "throttle_keyed_runs": f"""WITH RECURSIVE {HIT}, {_NUM}, walk AS (SELECT clip_id, n, t_us, event_id, label, t_us AS kept, label AS kept_label, true AS keep FROM num WHERE n = 1
      UNION ALL SELECT b.clip_id, b.n, b.t_us, b.event_id, b.label, CASE WHEN b.label <> a.kept_label OR b.t_us - a.kept > {15 * S} THEN b.t_us ELSE a.kept END,
        CASE WHEN b.label <> a.kept_label OR b.t_us - a.kept > {15 * S} THEN b.label ELSE a.kept_label END, b.label <> a.kept_label OR b.t_us - a.kept > {15 * S}
      FROM walk a JOIN num b ON a.clip_id = b.clip_id AND b.n = a.n + 1) SELECT clip_id, t_us, event_id, label FROM walk WHERE keep""",
    "interval_union": f"""WITH {HIT}, w AS (SELECT clip_id, t_us AS s, t_us + {WIDTH} AS e, conf, label = 'goal' AS p FROM hit),
      m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY clip_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {S} THEN 1 ELSE 0 END AS new FROM w),
      i AS (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY s, e ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM m)
      SELECT clip_id, island, min(s) AS start_us, max(e) AS end_us, max(conf) AS conf, bool_or(p)::INT AS "primary" FROM i GROUP BY clip_id, island""",
    "capped_clusters": f"""WITH RECURSIVE {HIT}, w AS (SELECT clip_id, t_us AS s, t_us + {WIDTH} AS e, conf, row_number() OVER (PARTITION BY clip_id ORDER BY t_us, {WIDTH}) AS n FROM hit),
      walk AS (SELECT clip_id, n, 1 AS g, s, e, conf AS c, s AS p, e AS q FROM w WHERE n = 1
      UNION ALL SELECT clip_id, n + 1, g + (NOT j)::INT, CASE WHEN j THEN s ELSE bs END, CASE WHEN j THEN greatest(e, be) ELSE be END, CASE WHEN j AND NOT bc > c THEN c ELSE bc END, CASE WHEN j AND NOT bc > c THEN p ELSE bs END, CASE WHEN j AND NOT bc > c THEN q ELSE be END
      FROM (SELECT a.*, b.s AS bs, b.e AS be, b.conf AS bc, b.s - a.e <= {4 * S} AND greatest(a.e, b.e) - a.s <= {20 * S} AS j FROM walk a JOIN w b ON a.clip_id = b.clip_id AND b.n = a.n + 1))
      SELECT clip_id, s AS start_us, e AS end_us, c AS conf, p AS peak_start_us, q AS peak_end_us FROM walk QUALIFY row_number() OVER (PARTITION BY clip_id, g ORDER BY n DESC) = 1""",
    "fold_or_abut": f"""WITH RECURSIVE {HIT}, {_NUM}, walk AS (SELECT clip_id, n, 1 AS g, t_us - {5 * S} AS s, t_us + {3 * S} AS e FROM num WHERE n = 1
      UNION ALL SELECT clip_id, n + 1, CASE WHEN mode IN ('new', 'abut') THEN g + 1 ELSE g END, CASE mode WHEN 'new' THEN bs WHEN 'abut' THEN e ELSE s END, CASE mode WHEN 'skip' THEN e ELSE be END
      FROM (SELECT a.*, b.t_us - {5 * S} AS bs, b.t_us + {3 * S} AS be, CASE WHEN b.t_us - {5 * S} > a.e THEN 'new' WHEN b.t_us + {3 * S} - a.s <= {20 * S} THEN 'grow' WHEN b.t_us + {3 * S} - a.e < {S} THEN 'skip' ELSE 'abut' END AS mode
        FROM walk a JOIN num b ON a.clip_id = b.clip_id AND b.n = a.n + 1))
      SELECT clip_id, s AS start_us, e AS end_us FROM walk QUALIFY row_number() OVER (PARTITION BY clip_id, g ORDER BY n DESC) = 1""",
    "last_index_cluster": f"""WITH {SEG}, g AS (SELECT clip_id, seq, CASE WHEN lag(seq) OVER (PARTITION BY clip_id ORDER BY seq) IS NULL OR seq - lag(seq) OVER (PARTITION BY clip_id ORDER BY seq) > 5 THEN seq END AS st FROM seg WHERE label = 'goal')
      SELECT clip_id, seq, (seq >= max(st) OVER (PARTITION BY clip_id))::INT AS kept FROM g""",
    "boolean_runs": f"""WITH {SEG}, r AS (SELECT *, sum(CASE WHEN value > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run, value > 30 AS f FROM seg),
      i AS (SELECT *, row_number() OVER (PARTITION BY clip_id, run ORDER BY seq DESC) AS k FROM r WHERE f), a AS (SELECT clip_id, run, min(t_us) AS start_us, avg(value) FILTER (k <= 10) AS energy FROM i GROUP BY ALL)
      SELECT a.clip_id, a.start_us, e.t_us AS end_us, round(a.energy, 6) AS energy FROM a JOIN r e ON e.clip_id = a.clip_id AND e.run = a.run + 1 AND NOT e.f WHERE e.t_us - a.start_us >= {2 * S}""",
    "group_middle": f"WITH {HIT}, {_LABELLED} SELECT clip_id, session, event_id, t_us FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, session ORDER BY t_us) - 1 AS i, count(*) OVER (PARTITION BY clip_id, session) AS n FROM sess) WHERE i = n // 2",
    "greedy_peaks": f"""WITH {HIT}, a AS (SELECT clip_id, t_us, value FROM hit QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY value DESC, t_us) = 1),
      b AS (SELECT h.clip_id, h.t_us, h.value FROM hit h JOIN a USING (clip_id) WHERE abs(h.t_us - a.t_us) >= {40 * S} QUALIFY row_number() OVER (PARTITION BY h.clip_id ORDER BY h.value DESC, h.t_us) = 1),
      c AS (SELECT h.clip_id, h.t_us, h.value FROM hit h JOIN a USING (clip_id) JOIN b USING (clip_id) WHERE abs(h.t_us - a.t_us) >= {40 * S} AND abs(h.t_us - b.t_us) >= {40 * S} QUALIFY row_number() OVER (PARTITION BY h.clip_id ORDER BY h.value DESC, h.t_us) = 1)
      SELECT *, 1::BIGINT AS rank FROM a UNION ALL SELECT *, 2 FROM b UNION ALL SELECT *, 3 FROM c""",
    "virtual_steps": f"""WITH {SEG} SELECT clip_id, seq, sum(c) OVER (PARTITION BY clip_id ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS step FROM (SELECT clip_id, seq, CASE WHEN label = 'goal_replay' AND coalesce(lag(label) OVER (PARTITION BY clip_id ORDER BY seq), '') = 'goal_replay' THEN 0 ELSE 1 END AS c FROM seg)""",
    "last_terminal": f"WITH {SEG} SELECT clip_id, seq, label FROM seg QUALIFY label NOT IN ('goal', 'other') OR row_number() OVER (PARTITION BY clip_id, label ORDER BY seq DESC) = 1",
}
QUERIES = {name: globals()[name] for name in ORACLES}

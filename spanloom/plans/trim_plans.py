"""Queries of gates, trims, intros, transitions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import joins as jn
from ..operators import rules as ru
from ..operators import selection as sl
from ..operators import sequence as sq
from ..operators import trims as tr
from .base import HIT, SEG, S, hits, segments, table
from .sequence_plans import PASS, passes, period_numbers

CLIP = ["clip_id"]


def event_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    return h.where(tr.event_gate(F.col("label"), F.col("conf"), {"goal": 0.6, "faceoff_cutscene": 0.3}, 0.5)).select("event_id", "label", "conf")


def joint_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir).withColumn("b", F.col("event_id") % 10 / 10).withColumn("c", F.col("event_id") % 7 / 7)
    ok, which = tr.joint_gate(F.col("conf"), F.col("b"), F.col("c"), 0.75, 0.8)
    return h.where(ok).select("event_id", which.alias("which"))


def pause_demote(spark: SparkSession, sf_dir: str) -> DataFrame:
    menu, end, intro = F.col("event_id") % 5 == 0, F.col("event_id") % 15 == 0, F.col("seq") == 0
    r = segments(spark, sf_dir).select("clip_id", "seq", ru.by_menu(F.col("label"), menu, end, intro).alias("r"))
    return r.select("clip_id", "seq", "r.label", F.col("r.has_menu").cast("int").alias("has_menu"))


def tail_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last hit of a goal in each clip's last 300 seconds."""
    return ru.tail_hits(hits(spark, sf_dir), CLIP, "t_us", F.col("label") == "goal", 300 * S)


def best_or_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir).withColumn("day", F.floor(F.col("t_us") / (96 * S)))
    return tr.best_or_other(h, ["clip_id", "day"], "label", "conf", "event_id")


def anchor_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).where("label = 'scoring_chance'").select("clip_id", "seq", "dur_us")
    shots = s.select("clip_id", "seq", F.explode(F.array(F.floor(F.col("dur_us") / 5), F.floor(F.col("dur_us") / 2), F.col("dur_us"))).alias("at_us"))
    return tr.anchored(s, ["clip_id", "seq"], shots, "at_us", "dur_us", 5 * S, 3 * S, 20 * S, S)


def declared_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period that confident face-offs declare on each segment."""
    s = segments(spark, sf_dir)
    e = hits(spark, sf_dir).where(tr.event_gate(F.col("label"), F.col("conf"), {"faceoff_cutscene": 0.3, "goal": 0.6}, 0.9)).select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 4).alias("period"))
    at = s.where("dur_us > 0").select("clip_id", "event_id", (F.col("start_us") + F.least(F.col("dur_us") * 2, F.lit(90 * S))).alias("at_us")).join(e, "event_id")
    return jn.declared_periods(at, s, CLIP, "seq", "at_us", "start_us", "end_us", "period", 60 * S)


def replaced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of goals and errors each clip keeps a later second look, in order of time with all other events."""
    h = hits(spark, sf_dir).select("clip_id", "t_us", "event_id", "label")
    new = h.where("label in ('goal', 'other') and event_id % 5 = 0").withColumn("t_us", F.col("t_us") + 10 * S)
    return ev.replaced(h, new, CLIP, "t_us", "label", ["event_id"])


def chance_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).where("label in ('scoring_chance', 'other')")
    ws = F.when(F.col("event_id") % 2 == 0, F.floor(F.col("dur_us") / 4))
    peak = F.when(F.col("event_id") % 3 == 0, F.floor(F.col("dur_us") / 3))
    t = tr.chance_trim(F.col("dur_us"), ws, F.floor(F.col("dur_us") / 2), peak, 5 * S, 3 * S, 12 * S, 2 * S, 5 * S)
    return s.withColumn("t", t).where("t is not null").select("clip_id", "seq", F.col("t.s").cast("long").alias("trim_start_us"), F.col("t.e").cast("long").alias("trim_end_us"))


def replay_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).where("label = 'goal_replay'").select("clip_id", "seq", ru.replay_end(F.col("dur_us"), 10 * S).alias("trim_end_us"))


def chance_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).where("label = 'scoring_chance'").withColumn("ts", F.floor(F.col("dur_us") / 3)).withColumn("te", F.floor(F.col("dur_us") / 2))
    cut = lambda a, b, c: F.struct(F.floor(F.col("dur_us") * a / 10).alias("s"), F.floor(F.col("dur_us") * b / 10).alias("e"), F.lit(c).alias("c"))
    s = s.withColumn("x", F.array(cut(4, 6, 0.9), cut(8, 9, 0.2)))
    return tr.leads(s, ("ts", "te", "conf"), "x", S).select("clip_id", "seq", F.col("number").cast("long").alias("number"), "start_us", "end_us", "conf")


def fallback_intro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.fallback_intro(segments(spark, sf_dir), CLIP, (F.col("label") == "other") & (F.col("dur_us") > 0), F.col("label") == "goal", 60 * S, 30 * S, 4 * S).select("clip_id", "start_us", "end_us")


def period_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.transitions(period_numbers(spark, sf_dir), CLIP, "seq", "period", F.col("to_period") <= 3)


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sl.top_per_group(o, ["o_custkey"], [F.col("o_orderkey").desc()], 3)


def confirmed_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the periods that are declared and those with a start, by clip."""
    p = passes(spark, sf_dir)
    a = p.where("declared is not null").select("clip_id", F.col("declared").alias("period"))
    b = p.where("starts").select("clip_id", (F.col("event_id") % 3).cast("int").alias("period"))
    return a.unionByName(b).distinct()


ORACLES = {
    "event_gates": f"WITH {HIT} SELECT event_id, label, conf FROM hit WHERE conf >= CASE label WHEN 'goal' THEN 0.6 WHEN 'faceoff_cutscene' THEN 0.3 ELSE 0.5 END",
    "joint_gate": f"WITH {HIT} SELECT event_id, (conf < event_id % 10 / 10)::INT AS which FROM hit WHERE greatest(conf, event_id % 10 / 10) >= 0.75 AND event_id % 7 / 7 >= 0.8",
    "pause_demote": f"WITH {SEG} SELECT clip_id, seq, CASE WHEN event_id % 5 = 0 AND seq > 0 THEN CASE WHEN event_id % 15 = 0 THEN 'game_end' ELSE 'other' END ELSE label END AS label, (event_id % 5 = 0 AND event_id % 15 <> 0 AND seq > 0)::INT AS has_menu FROM seg",
    "tail_hits": f"WITH {HIT}, t AS (SELECT *, max(t_us) OVER (PARTITION BY clip_id) AS e FROM hit) SELECT clip_id, min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS n FROM t WHERE t_us >= e - {300 * S} AND label = 'goal' GROUP BY clip_id",
    "best_or_other": f"WITH {HIT}, d AS (SELECT *, t_us // {96 * S} AS day FROM hit) SELECT clip_id, day, label, conf FROM d QUALIFY row_number() OVER (PARTITION BY clip_id, day ORDER BY label <> 'other' DESC, conf DESC, event_id) = 1",
    "anchor_windows": f"""WITH RECURSIVE {SEG}, c AS (SELECT clip_id, seq, dur_us, unnest([dur_us // 5, dur_us // 2, dur_us]) AS t FROM seg WHERE label = 'scoring_chance'),
      num AS (SELECT clip_id, seq, greatest(0, t - {5 * S}) AS a, least(dur_us, t + {3 * S}) AS b, row_number() OVER (PARTITION BY clip_id, seq ORDER BY t) AS n FROM c WHERE t > 0),
      walk AS (SELECT clip_id, seq, n, 1 AS g, a AS s, b AS e FROM num WHERE n = 1 UNION ALL SELECT clip_id, seq, n + 1, CASE WHEN mode IN ('new', 'abut') THEN g + 1 ELSE g END, CASE mode WHEN 'new' THEN bs WHEN 'abut' THEN e ELSE s END, CASE mode WHEN 'skip' THEN e ELSE be END
        FROM (SELECT w.*, b.a AS bs, b.b AS be, CASE WHEN b.a > w.e THEN 'new' WHEN b.b - w.s <= {20 * S} THEN 'grow' WHEN b.b - w.e < {S} THEN 'skip' ELSE 'abut' END AS mode FROM walk w JOIN num b ON b.clip_id = w.clip_id AND b.seq = w.seq AND b.n = w.n + 1))
      SELECT clip_id, seq, s AS start_us, e AS end_us, number FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, seq ORDER BY s) - 1 AS number FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY clip_id, seq, g ORDER BY n DESC) = 1)) WHERE number < 3""",
    "chance_trims": f"""WITH {SEG}, t AS (SELECT clip_id, seq, dur_us, CASE WHEN event_id % 2 = 0 THEN greatest(0, dur_us // 4 - {5 * S}) WHEN event_id % 3 = 0 THEN greatest(0, dur_us // 3 - {5 * S}) END AS s, CASE WHEN event_id % 2 = 0 THEN least(dur_us, dur_us // 2 + {3 * S}) WHEN event_id % 3 = 0 THEN least(dur_us, dur_us // 3 + {3 * S}) END AS e FROM seg WHERE label IN ('scoring_chance', 'other'))
      SELECT clip_id, seq, s AS trim_start_us, e AS trim_end_us FROM t WHERE dur_us > {12 * S} AND e - s >= {2 * S}""",
    "replay_trims": f"WITH {SEG} SELECT clip_id, seq, least(dur_us, {10 * S}) AS trim_end_us FROM seg WHERE label = 'goal_replay'",
    "chance_leads": f"""WITH {SEG}, c AS (SELECT clip_id, seq, conf, dur_us // 3 AS s1, dur_us // 2 AS e1, floor(dur_us * 4 / 10)::BIGINT AS s2, floor(dur_us * 6 / 10)::BIGINT AS e2, floor(dur_us * 8 / 10)::BIGINT AS s3, floor(dur_us * 9 / 10)::BIGINT AS e3 FROM seg WHERE label = 'scoring_chance'),
      w AS (SELECT clip_id, seq, conf AS own, s1 AS s, e1 AS e, conf AS c, true AS p FROM c UNION ALL SELECT clip_id, seq, conf, s2, e2, 0.9, false FROM c UNION ALL SELECT clip_id, seq, conf, s3, e3, 0.2, false FROM c),
      i AS (SELECT *, sum(new) OVER (PARTITION BY clip_id, seq ORDER BY s, e, c, p ROWS UNBOUNDED PRECEDING)::BIGINT AS number FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY clip_id, seq ORDER BY s, e, c, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {S} THEN 1 ELSE 0 END AS new FROM w))
      SELECT clip_id, seq, number, min(s) AS start_us, max(e) AS end_us, CASE WHEN bool_or(p) THEN any_value(own) ELSE max(c) END AS conf FROM i GROUP BY clip_id, seq, number""",
    "declared_periods": f"""WITH {SEG}, e AS (SELECT clip_id, start_us + least(dur_us * 2, {90 * S}) AS t, CASE WHEN event_id % 3 > 0 THEN event_id % 4 END AS p FROM seg WHERE dur_us > 0 AND conf >= CASE label WHEN 'faceoff_cutscene' THEN 0.3 WHEN 'goal' THEN 0.6 ELSE 0.9 END)
      SELECT s.clip_id, s.seq, max(p) AS period FROM seg s LEFT JOIN e ON e.clip_id = s.clip_id AND e.t >= s.start_us AND e.t < s.end_us GROUP BY s.clip_id, s.seq""",
    "replaced_events": f"""WITH {HIT}, n AS (SELECT clip_id, t_us + {10 * S} AS t_us, event_id, label FROM hit WHERE label IN ('goal', 'other') AND event_id % 5 = 0),
      a AS (SELECT clip_id, t_us, event_id, label FROM hit h WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.clip_id = h.clip_id AND n.label = h.label) UNION ALL SELECT * FROM n) SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY t_us, event_id) - 1 AS pos FROM a""",
    "fallback_intro": f"""WITH {SEG}, f AS (SELECT clip_id, min(start_us) AS a FROM seg WHERE label = 'other' AND dur_us > 0 GROUP BY clip_id), r AS (SELECT f.clip_id, f.a AS start_us, least((SELECT max(end_us) FROM seg t WHERE t.clip_id = f.clip_id), f.a + {30 * S}, coalesce((SELECT min(start_us) FROM seg g WHERE g.clip_id = f.clip_id AND g.label = 'goal' AND g.start_us > f.a), 9e18::BIGINT)) AS end_us FROM f WHERE f.a <= {60 * S})
      SELECT * FROM r WHERE end_us - start_us >= {4 * S}""",
    "latest_runs": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 3",
    "confirmed_periods": f"WITH {PASS} SELECT clip_id, declared::INT AS period FROM pas WHERE declared IS NOT NULL UNION SELECT clip_id, (event_id % 3)::INT FROM pas WHERE starts",
    "period_transitions": None,
}
from .sequence_plans import ORACLES as _SEQUENCE  # noqa: E402

ORACLES["period_transitions"] = f"SELECT clip_id, seq AS after, nxt AS to_period FROM (SELECT *, lead(period) OVER (PARTITION BY clip_id ORDER BY seq) AS nxt FROM ({_SEQUENCE['period_numbers']})) WHERE nxt > period AND nxt <= 3"
QUERIES = {name: globals()[name] for name in ORACLES}

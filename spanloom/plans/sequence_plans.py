"""Queries of the sequence operators. A goal of confidence 0.9 counts as confirmed by a banner; hours of the day stand for period marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as ru
from ..operators import sequence as sq
from .base import SEG, S, hits, segments

CLIP = ["clip_id"]


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments after the banner override: label, ml_label, banner, and flags of period marks."""
    s = segments(spark, sf_dir).withColumn("ml_label", F.col("label")).withColumn("k", F.col("event_id") % 97)
    s = s.withColumn("banner", (F.col("label") == "goal") & (F.col("conf") >= 0.5))
    s = s.withColumn("label", F.when((F.col("label") == "goal") & ~F.col("banner"), "other").otherwise(F.col("label")))
    s = s.withColumn("period_end", F.col("k") == 1).withColumn("starts", F.col("k").isin(2, 3)).withColumn("period_start", F.col("k") == 2).withColumn("game_start", F.col("k") == 3)
    return s.withColumn("regulation_end", F.col("k") == 4).withColumn("declared", F.when(F.col("k") == 2, F.when(F.col("event_id") % 2 == 0, F.lit(2))))


def prior_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sq.prior_context(passes(spark, sf_dir), CLIP, "seq", F.col("starts"), F.col("period_end"), F.col("label").isin(*sq.FACEOFFS), F.col("banner"))
    return r.select("clip_id", "seq", "context")


def goal_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.goal_chains(passes(spark, sf_dir), CLIP, "seq", F.col("label") == "goal", 25, 10 * S, 3 * S).drop("goal_no")


def chain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained rows with the score and confidence that the chain gives them."""
    p = passes(spark, sf_dir)
    chains = sq.goal_chains(p, CLIP, "seq", F.col("label") == "goal", 25, 10 * S, 3 * S).select("clip_id", "seq", "goal_seq", "chain_order")
    found = sq.chain_scores(chains, p.withColumn("score", F.when(F.col("event_id") % 2 == 0, F.col("conf") + 0.1)), CLIP, "seq", "score", "conf")
    return found.select("clip_id", "seq", "chain_order", F.round("score", 9).alias("score"), "conf")


def empty_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals that no chained row names."""
    p = passes(spark, sf_dir)
    chained = goal_chain(spark, sf_dir).select("clip_id", F.col("goal_seq").alias("seq")).distinct()
    return p.where("label = 'goal'").select("clip_id", "seq").join(chained, ["clip_id", "seq"], "left_anti")


def infer_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.inferred_goals(passes(spark, sf_dir), CLIP, "seq", 5, 0.45)


def rescue_demoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demoted goals of good confidence in normal play, as chances."""
    p = sq.prior_context(passes(spark, sf_dir), CLIP, "seq", F.col("starts"), F.col("period_end"), F.col("label").isin(*sq.FACEOFFS), F.col("banner"))
    return ru.rescued(p, 0.3).select("clip_id", "seq", "conf")


def adjacent_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = passes(spark, sf_dir).withColumn("trim_start_us", F.when(F.col("event_id") % 3 == 0, 2 * S).otherwise(0)).withColumn("trim_end_us", F.col("dur_us"))
    return sq.adjacent_chances(s, CLIP, "seq", F.col("label") == "scoring_chance", F.col("banner") | F.col("starts"), S // 2, 12 * S, "trim_start_us", "trim_end_us")


def period_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.period_numbers(passes(spark, sf_dir), CLIP, "seq")


def counter_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One counter, a reading for each segment."""
    return sq.counter_events(segments(spark, sf_dir).withColumn("v", F.floor(F.col("value") / 20)), CLIP, "seq", "v", 2)


def counter_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = segments(spark, sf_dir).select("clip_id", "seq", ru.boosted(F.col("label"), F.col("conf"), F.col("value") > 90, F.col("value") > 50).alias("r"))
    return r.select("clip_id", "seq", "r.conf", "r.extra")


def flag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sq.groups_of(segments(spark, sf_dir), CLIP, "seq", F.col("value") > 20)
    return r.groupBy("clip_id", "run").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))


def empty_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.empty_sentinel(segments(spark, sf_dir), CLIP, "seq", F.col("value") < 25, 3).select("clip_id", "seq")


def midnight_unroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir).withColumn("clock", F.floor(F.col("t_us") / 1_000_000) % 86_400)
    return sq.unrolled(h, CLIP, "t_us", "clock").select("clip_id", "event_id", "elapsed")


PASS = f"""{SEG}, pas AS (SELECT clip_id, seq, event_id, t_us, dur_us, start_us, conf, value, label AS ml_label, label = 'goal' AND conf >= 0.5 AS banner,
  CASE WHEN label = 'goal' AND NOT conf >= 0.5 THEN 'other' ELSE label END AS label, event_id % 97 = 1 AS period_end, event_id % 97 IN (2, 3) AS starts, event_id % 97 = 2 AS period_start, event_id % 97 = 3 AS game_start,
  event_id % 97 = 4 AS regulation_end, CASE WHEN event_id % 97 = 2 AND event_id % 2 = 0 THEN 2 END AS declared FROM seg)"""
_KIND = "CASE WHEN starts THEN 'normal' WHEN period_end THEN 'intermission' WHEN label IN ('faceoff', 'faceoff_cutscene') THEN 'normal' WHEN banner THEN 'replay_tail' END"
_CTX = f"ctx AS (SELECT *, coalesce(last_value({_KIND} IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'normal') AS context FROM pas)"
_CHAIN = f"""gn AS (SELECT clip_id, seq, label, dur_us, sum((label = 'goal')::INT) OVER (PARTITION BY clip_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM pas),
  walk AS (SELECT clip_id, g, seq, seq AS base, 0 AS n, 0::BIGINT AS gap, false AS started, false AS stopped, 0 AS ord, NULL::VARCHAR AS kind FROM gn WHERE label = 'goal'
    UNION ALL SELECT clip_id, g, seq2, base, n + 1, CASE mode WHEN 'follow' THEN 0 WHEN 'bridge' THEN gap + d WHEN 'far' THEN gap + d ELSE gap END, started OR mode = 'follow', stopped OR mode = 'stop' OR (mode = 'far' AND gap + d > {10 * S}),
      ord + (mode IN ('follow', 'bridge'))::INT, CASE WHEN mode IN ('follow', 'bridge') THEN mode END
    FROM (SELECT w.*, b.seq AS seq2, b.dur_us AS d, CASE WHEN w.stopped OR w.n + 1 > 25 OR b.label = 'faceoff_cutscene' THEN 'stop' WHEN b.label = 'goal_replay' THEN 'follow' WHEN b.dur_us <= {3 * S} THEN 'skip' WHEN NOT w.started AND w.gap + b.dur_us <= {10 * S} THEN 'bridge' ELSE 'far' END AS mode
      FROM walk w JOIN gn b ON b.clip_id = w.clip_id AND b.g = w.g AND b.seq = w.seq + 1)),
  chain AS (SELECT clip_id, seq, base AS goal_seq, ord::BIGINT AS chain_order, kind FROM walk WHERE kind IS NOT NULL)"""

ORACLES = {
    "prior_context": f"WITH {PASS}, {_CTX} SELECT clip_id, seq, context FROM ctx",
    "goal_chain": f"WITH RECURSIVE {PASS}, {_CHAIN} SELECT * FROM chain",
    "chain_scores": f"""WITH RECURSIVE {PASS}, {_CHAIN} SELECT c.clip_id, c.seq, c.chain_order, round(CASE WHEN g.event_id % 2 = 0 THEN g.conf + 0.1 ELSE g.conf END - 0.01 * c.chain_order, 9) AS score, greatest(p.conf, 0.9) AS conf
      FROM chain c JOIN pas g ON g.clip_id = c.clip_id AND g.seq = c.goal_seq JOIN pas p ON p.clip_id = c.clip_id AND p.seq = c.seq""",
    "empty_goals": f"WITH RECURSIVE {PASS}, {_CHAIN} SELECT clip_id, seq FROM pas p WHERE label = 'goal' AND NOT EXISTS (SELECT 1 FROM chain c WHERE c.clip_id = p.clip_id AND c.goal_seq = p.seq)",
    "infer_goals": f"""WITH RECURSIVE {PASS}, st AS (SELECT *, sum(c) OVER (PARTITION BY clip_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS step FROM (SELECT *, CASE WHEN label = 'goal_replay' AND coalesce(lag(label) OVER (PARTITION BY clip_id ORDER BY seq), '') = 'goal_replay' THEN 0 ELSE 1 END AS c FROM pas)),
      nx AS (SELECT *, first_value(CASE WHEN label = 'goal' THEN -1 WHEN label = 'faceoff_cutscene' AND conf >= 0.6 THEN step END IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nstep FROM st),
      f AS (SELECT *, NOT banner AND NOT starts AND NOT period_end AND label IN ('scoring_chance', 'other') AND (ml_label = 'goal' OR (ml_label = 'scoring_chance' AND conf >= 0.45)) AND coalesce(nstep > 0 AND nstep - step <= 5, false) AS ok FROM nx),
      walk AS (SELECT clip_id, seq, ok AS promoted, coalesce(CASE WHEN starts THEN 'normal' WHEN period_end THEN 'intermission' WHEN label = 'faceoff_cutscene' THEN 'normal' WHEN banner OR ok THEN 'replay_tail' END, 'normal') AS context FROM f WHERE seq = 0
        UNION ALL SELECT b.clip_id, b.seq, b.ok AND a.context = 'normal', coalesce(CASE WHEN b.starts THEN 'normal' WHEN b.period_end THEN 'intermission' WHEN b.label = 'faceoff_cutscene' THEN 'normal' WHEN b.banner OR (b.ok AND a.context = 'normal') THEN 'replay_tail' END, a.context) FROM walk a JOIN f b ON b.clip_id = a.clip_id AND b.seq = a.seq + 1)
      SELECT clip_id, seq FROM walk WHERE promoted""",
    "rescue_demoted": f"WITH {PASS}, {_CTX} SELECT clip_id, seq, conf FROM ctx WHERE label = 'other' AND ml_label = 'goal' AND conf >= 0.3 AND context = 'normal'",
    "adjacent_chances": f"""WITH {PASS}, c AS (SELECT clip_id, seq, CASE WHEN event_id % 3 = 0 THEN {2 * S} ELSE 0 END AS ts, label = 'scoring_chance' AS chance, sum((banner OR starts)::INT) OVER w AS wall, sum(CASE WHEN label = 'scoring_chance' THEN 0 ELSE dur_us END) OVER w AS filler FROM pas WINDOW w AS (PARTITION BY clip_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
      n AS (SELECT *, lead(seq) OVER w AS nseq, lead(ts) OVER w AS nts, lead(wall) OVER w AS nwall, lead(filler) OVER w AS nfiller FROM c WHERE chance WINDOW w AS (PARTITION BY clip_id ORDER BY seq))
      SELECT clip_id, seq, nseq AS next_seq FROM n WHERE nts <= {S // 2} AND nfiller - filler <= {12 * S} AND nwall = wall""",
    "period_numbers": f"""WITH RECURSIVE {PASS}, walk AS (SELECT clip_id, seq, 0 AS p0, 1 AS p, 1 AS after FROM pas WHERE false
      UNION ALL SELECT clip_id, seq, p0, p, after FROM (SELECT clip_id, seq, 1 AS p0, CASE WHEN (period_start OR game_start) AND declared IS NOT NULL THEN greatest(1, least(declared, 3)) WHEN period_start AND declared IS NULL THEN 2 ELSE 1 END AS p, NULL::INT AS after FROM pas WHERE false)),
      w2 AS (SELECT clip_id, seq, p, CASE WHEN pe THEN least(p + 1, 3) WHEN re THEN 4 ELSE p END AS after FROM (SELECT clip_id, seq, period_end AS pe, regulation_end AS re, CASE WHEN (period_start OR game_start) AND declared IS NOT NULL THEN greatest(1, least(declared, 3)) WHEN period_start THEN 2 ELSE 1 END AS p FROM pas WHERE seq = 0)
        UNION ALL SELECT clip_id, seq, p, CASE WHEN pe THEN least(p + 1, 3) WHEN re THEN 4 ELSE p END FROM (SELECT b.clip_id, b.seq, b.period_end AS pe, b.regulation_end AS re, CASE WHEN (b.period_start OR b.game_start) AND b.declared IS NOT NULL THEN greatest(a.after, least(b.declared, 3)) WHEN b.period_start AND a.after < 3 AND b.declared IS NULL THEN a.after + 1 ELSE a.after END AS p FROM w2 a JOIN pas b ON b.clip_id = a.clip_id AND b.seq = a.seq + 1))
      SELECT clip_id, seq, p::BIGINT AS period FROM w2""",
    "counter_steps": f"""WITH RECURSIVE {SEG}, v AS (SELECT clip_id, seq, floor(value / 20)::BIGINT AS v, coalesce(lead(floor(value / 20)::BIGINT) OVER (PARTITION BY clip_id ORDER BY seq) BETWEEN floor(value / 20)::BIGINT AND floor(value / 20)::BIGINT + 1, true) AS ok FROM seg),
      walk AS (SELECT clip_id, seq, NULL::BIGINT AS cur, v AS pend, NULL::BIGINT AS hit, NULL::BIGINT AS diff FROM v WHERE seq = 0
        UNION ALL SELECT clip_id, seq, CASE WHEN cur IS NULL THEN CASE WHEN v = pend THEN v END WHEN acc THEN v ELSE cur END, CASE WHEN cur IS NULL AND v <> pend THEN v ELSE pend END, CASE WHEN acc THEN v END, CASE WHEN acc THEN v - cur END
        FROM (SELECT b.clip_id, b.seq, a.cur, a.pend, b.v, a.cur IS NOT NULL AND b.v - a.cur BETWEEN 1 AND 2 AND b.ok AS acc FROM walk a JOIN v b ON b.clip_id = a.clip_id AND b.seq = a.seq + 1))
      SELECT clip_id, seq, hit AS v, diff AS step FROM walk WHERE hit IS NOT NULL""",
    "counter_boost": f"WITH {SEG} SELECT clip_id, seq, CASE WHEN value > 90 THEN greatest(conf, 0.85) WHEN value > 50 AND label = 'scoring_chance' THEN greatest(conf, 0.7) ELSE conf END AS conf, (CASE WHEN value > 90 THEN 0.8 WHEN value > 50 THEN 0.3 ELSE 0.0 END)::DOUBLE AS extra FROM seg",
    "flag_runs": f"WITH {SEG}, f AS (SELECT *, sum(CASE WHEN value > 20 AND NOT coalesce(p > 20, false) THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT *, lag(value) OVER (PARTITION BY clip_id ORDER BY seq) AS p FROM seg)) SELECT clip_id, run, min(seq) AS first_seq, count(*) AS n FROM f WHERE value > 20 GROUP BY clip_id, run",
    "empty_sentinel": f"""WITH {SEG}, t AS (SELECT *, value < 25 AND coalesce(lag(value) OVER w < 25, false) AND coalesce(lag(value, 2) OVER w < 25, false) AS third FROM seg WINDOW w AS (PARTITION BY clip_id ORDER BY seq)),
      s AS (SELECT *, min(seq) FILTER (third) OVER (PARTITION BY clip_id) AS stop FROM t), k AS (SELECT * FROM s WHERE stop IS NULL OR seq < stop)
      SELECT clip_id, seq FROM (SELECT *, max(seq) FILTER (NOT value < 25) OVER (PARTITION BY clip_id) AS l FROM k) WHERE seq <= l""",
    "midnight_unroll": f"WITH {SEG} SELECT clip_id, event_id, (clock + 86400 * sum(roll) OVER (PARTITION BY clip_id ORDER BY t_us ROWS UNBOUNDED PRECEDING))::BIGINT AS elapsed FROM (SELECT *, CASE WHEN lag(clock) OVER (PARTITION BY clip_id ORDER BY t_us) - clock > 3600 THEN 1 ELSE 0 END AS roll FROM (SELECT clip_id, event_id, t_us, floor(t_us / 1000000)::BIGINT % 86400 AS clock FROM hit))",
}
ORACLES["period_numbers"] = "WITH RECURSIVE " + PASS + ", w2 AS" + ORACLES["period_numbers"].split("w2 AS", 1)[1]
QUERIES = {name: globals()[name] for name in ORACLES}

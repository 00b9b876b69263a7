"""How the driver's ``events`` table stands in for recordings, and the same as SQL.

A user is a clip, an event a sampled segment of it, in order of time; one hour of
event time counts as one second of footage. Times are microseconds (long).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scans as sc

#: One second of footage, in microseconds of event time.
S = 3_600_000_000
#: Longest segment.
LONGEST = 45 * S
#: What stands for which label.
LABELS = {"purchase": "goal", "click": "scoring_chance", "view": "goal_replay", "signup": "faceoff_cutscene", "error": "other"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"bigint(datediff(to_date({ts}), date'1970-01-01')) * 86400000000 + hour({ts}) * 3600000000L + minute({ts}) * 60000000L + bigint(extract(second from {ts}) * 1000000)")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, event_id, t_us, label, conf, value, props; and the ranges of clips too long for one task, if there are any."""
    kind = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[F.col("event_type")]
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("clip_id"), "event_id", micros("ts").alias("t_us"), kind.alias("label"), (F.least("value", F.lit(100.0)) / 100).alias("conf"), "value", "props"
    )
    return sc.ranged(rows, ["clip_id"], "t_us")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as segments on their clip's timeline: seq (from 0), dur_us, start_us, end_us."""
    order = ["t_us", "event_id"]
    rows = sc.scan(hits(spark, sf_dir), ["clip_id"], order, {"_n": sc.row_number(), "_next": sc.lead("t_us")})
    rows = rows.withColumn("seq", F.col("_n") - 1).withColumn("dur_us", F.least(F.coalesce(F.col("_next") - F.col("t_us"), F.lit(0)), F.lit(LONGEST))).drop("_n", "_next")
    rows = sc.scan(rows, ["clip_id"], order, {"start_us": sc.sum_before("dur_us")})
    return rows.withColumn("end_us", F.col("start_us") + F.col("dur_us"))


def width() -> Column:
    """Two to ten seconds, for windows of unequal length."""
    return (2 + 2 * (F.col("event_id") % 5)) * S


WIDTH = f"((2 + 2 * (event_id % 5)) * {S})"
HIT = """hit AS (SELECT user_id AS clip_id, event_id, epoch_us(ts) AS t_us, CASE event_type WHEN 'purchase' THEN 'goal' WHEN 'click' THEN 'scoring_chance'
  WHEN 'view' THEN 'goal_replay' WHEN 'signup' THEN 'faceoff_cutscene' WHEN 'error' THEN 'other' END AS label, least(value, 100.0) / 100 AS conf, value, props FROM events)"""
SEG = f"""{HIT}, sq AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY t_us, event_id) - 1 AS seq,
  least(coalesce(lead(t_us) OVER (PARTITION BY clip_id ORDER BY t_us, event_id) - t_us, 0), {LONGEST}) AS dur_us FROM hit),
seg AS (SELECT *, start_us + dur_us AS end_us FROM (SELECT *, coalesce(sum(dur_us) OVER (PARTITION BY clip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_us FROM sq))"""

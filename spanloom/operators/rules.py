"""What a sign in one signal does to the label of a segment, a column at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence that a label gets when another signal speaks for it.
CERTAIN, SCORED, SHOT = 1.0, 0.85, 0.70


def weak_replay(label: Column, conf: Column, least: float) -> Column:
    """Whether a goal's replay is too unsure to stand for one."""
    return (label == "goal_replay") & (conf < least)


def demoted_replay(label: Column, conf: Column, least: float) -> Column:
    return F.when(weak_replay(label, conf, least), "other_replay").otherwise(label)


def by_banner(label: Column, conf: Column, banner: Column, rescue: float) -> Column:
    """A banner makes a goal, and without one there is none: a struct (label, conf, rescue), the last marking goals lost at ``rescue`` or more."""
    lost = ~banner & (label == "goal")
    return F.struct(F.when(banner, "goal").when(label == "goal", "other").otherwise(label).alias("label"), F.when(banner, CERTAIN).otherwise(conf).alias("conf"), (lost & (conf >= rescue)).alias("rescue"))


def by_menu(label: Column, menu: Column, end: Column, intro: Column) -> Column:
    """A menu demotes a segment unless an end screen is seen; intros stay: a struct (label, has_menu)."""
    return F.struct(F.when(menu & ~intro, F.when(end, "game_end").otherwise("other")).otherwise(label).alias("label"), (menu & ~end & ~intro).alias("has_menu"))


def boosted(label: Column, conf: Column, score: Column, shot: Column) -> Column:
    """A score change lifts any segment, else a shot lifts a chance: a struct (conf, extra)."""
    lifted = F.when(score, F.greatest(conf, F.lit(SCORED))).when(shot & (label == "scoring_chance"), F.greatest(conf, F.lit(SHOT))).otherwise(conf)
    return F.struct(lifted.alias("conf"), F.when(score, 0.8).when(shot, 0.3).otherwise(0.0).alias("extra"))


def rescued(rows: DataFrame, least: float) -> DataFrame:
    """Demoted goals (label other, ml_label goal) of at least ``least`` in normal play (column context)."""
    return rows.where((F.col("label") == "other") & (F.col("ml_label") == "goal") & (F.col("conf") >= least) & (F.col("context") == "normal"))


def replay_end(duration: Column, longest: int) -> Column:
    """Where a replay that stands alone is cut."""
    return F.least(duration, F.lit(longest))


def tail_hits(hits: DataFrame, by: list[str], at: str, hit: Column, tail: int) -> DataFrame:
    """First and last hit, and their number, in the last ``tail`` of each group: first_us, last_us and n."""
    end = hits.groupBy(*by).agg(F.max(at).alias("_end"))
    rows = hits.where(hit).join(end, by).where(F.col(at) >= F.col("_end") - tail)
    return rows.groupBy(*by).agg(F.min(at).alias("first_us"), F.max(at).alias("last_us"), F.count("*").alias("n"))

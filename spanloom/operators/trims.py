"""Trims of single segments, and what is put before, between and around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import events as ev
from . import intervals as iv


def event_gate(kind: Column, conf: Column, bars: dict[str, float], other: float) -> Column:
    """Each kind's own least confidence."""
    bar = F.lit(other)
    for name, least in bars.items():
        bar = F.when(kind == name, least).otherwise(bar)
    return conf >= bar


def joint_gate(first: Column, second: Column, both: Column, least: float, least_both: float) -> tuple[Column, Column]:
    """Whether the larger of two signals and a third pass, and which of the two it is (the first of ties)."""
    return (F.greatest(first, second) >= least) & (both >= least_both), F.when(first >= second, F.lit(0)).otherwise(F.lit(1))


def best_or_other(df: DataFrame, by: list[str], label: str, conf: str, order: str, other: str = "other") -> DataFrame:
    """The most confident row that isn't ``other``, else the most confident of all; the first of ties."""
    key = F.struct((F.col(label) != other).alias("real"), F.col(conf).alias("c"), (-F.col(order)).alias("o"), F.col(label).alias("l"))
    return df.groupBy(*by).agg(F.max(key).alias("_m")).select(*by, F.col("_m.l").alias(label), F.col("_m.c").alias(conf))


def anchored(df: DataFrame, by: list[str], shots: DataFrame, at: str, duration: str, before: int, after: int, longest: int, least: int, most: int = 3) -> DataFrame:
    """Windows around the shots of each segment, without overlap: number 0 is its trim, the next ones are extras."""
    hit = shots.join(df.select(*by, duration), by).where((F.col(at) > 0) & (F.col(at) <= F.col(duration)))
    span = hit.withColumn("w", iv.padded(F.col(at), F.col(at), before, after, F.col(duration))).select(*by, F.col("w.s").alias("_s"), F.col("w.e").alias("_e"))
    folded = ev.fold_or_abut(span, by, "_s", "_e", longest, least)
    n = F.row_number().over(Window.partitionBy(*by).orderBy("start_us")) - 1
    return folded.withColumn("number", n.cast("long")).where(F.col("number") < most)


def chance_trim(duration: Column, window_start: Column, window_end: Column, peak: Column, before: int, after: int, short: int, least: int, around: int) -> Column:
    """The window with padding, else ``around`` the peak; null where the segment is short, has neither, or less than ``least`` would be left: a struct (s, e)."""
    w = iv.padded(window_start, window_end, before, after, duration)
    p = iv.padded(peak, peak, around, after, duration)
    t = F.when(window_start.isNotNull(), w).when(peak.isNotNull(), p)
    return F.when((duration > short) & (t["e"] - t["s"] >= least), t)


def leads(df: DataFrame, primary: tuple[str, str, str], extras: str, slack: int) -> DataFrame:
    """One row for each merged window of a segment's own and its extra trims: number, start_us, end_us, conf (its own where it holds the primary)."""
    own = F.struct(F.col(primary[0]).alias("s"), F.col(primary[1]).alias("e"), F.col(primary[2]).alias("c"), F.lit(True).alias("p"))
    every = F.concat(F.array(own), F.transform(extras, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["c"].alias("c"), F.lit(False).alias("p"))))
    rows = df.select("*", F.posexplode(iv.united(every, slack)).alias("number", "w"))
    return rows.withColumn("start_us", F.col("w.s")).withColumn("end_us", F.col("w.e")).withColumn("conf", F.when(F.col("w.p"), F.col(primary[2])).otherwise(F.col("w.c"))).drop("w")


def fallback_intro(df: DataFrame, by: list[str], eligible: Column, goal: Column, latest: int, longest: int, least: int) -> DataFrame:
    """The first eligible segment's window of at most ``longest``, up to the next goal; none if it begins after ``latest`` or is below ``least``."""
    first = df.where(eligible).groupBy(*by).agg(F.min("start_us").alias("start_us"))
    total = df.groupBy(*by).agg(F.max("end_us").alias("_total"))
    goals = df.where(goal).select(*by, F.col("start_us").alias("_g")).join(first, by).where(F.col("_g") > F.col("start_us")).groupBy(*by).agg(F.min("_g").alias("_g"))
    rows = first.join(total, by).join(goals, by, "left").where(F.col("start_us") <= latest)
    rows = rows.withColumn("end_us", F.least("_total", F.col("start_us") + longest, F.coalesce("_g", "_total")))
    return rows.where(F.col("end_us") - F.col("start_us") >= least).drop("_total", "_g")


def transitions(df: DataFrame, by: list[str], order: str, period: str, confirmed: Column) -> DataFrame:
    """Places between neighbours where the period rises to a confirmed one: after (the row before) and to_period."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("to_period", F.lead(period).over(w)).where((F.col("to_period") > F.col(period)) & confirmed)
    return rows.select(*by, F.col(order).alias("after"), "to_period")

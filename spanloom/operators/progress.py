"""What past runs say about the time that a run still takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import quantiles

#: A run tells of the cost for each segment with more than so many, of frames with more than so many.
LEAST_SEGMENTS, LEAST_FRAMES = 10, 100
#: A time of a step beyond this many seconds is a stall.
STALL = 7_200


def medians(df: DataFrame, by: list[str], value: str, bins: int = 4_096) -> DataFrame:
    """by and median of numbers of any size."""
    return quantiles(df, by, value, 0.5, bins).select(*by, F.col("level").alias("median"))


def step_times(headers: DataFrame, runs: DataFrame, run: list[str], order: str, at: str, step: str, final: str) -> DataFrame:
    """run, step, seconds, n_segments and n_frames of every step that ended: at the next header, or, the last step of a run that was completed, at the run's end.

    ``runs`` has for each run n_segments, n_frames (null: not known), completed and
    last_at. Times are seconds; stalls and steps that end before they begin are left out.
    """
    w = Window.partitionBy(*run).orderBy(order)  # a run's few headers
    ends = headers.withColumn("_next", F.lead(at).over(w)).join(runs, run)
    end = F.coalesce("_next", F.when(F.col("completed") & (F.col(step) == final), F.col("last_at")))
    return ends.withColumn("seconds", end - F.col(at)).where((F.col("seconds") >= 0) & (F.col("seconds") < STALL)).select(*run, step, "seconds", "n_segments", "n_frames")


def learned(times: DataFrame, step: str, by_segment: list[str], by_frame: list[str]) -> DataFrame:
    """step, flat, per_segment and frames_a_second: medians of past runs, each of the runs that can tell (null: none)."""
    flat = medians(times, [step], "seconds").withColumnRenamed("median", "flat")
    each = times.where(F.col(step).isin(by_segment) & (F.col("n_segments") > LEAST_SEGMENTS)).withColumn("_v", F.col("seconds") / F.col("n_segments"))
    rate = times.where(F.col(step).isin(by_frame) & (F.col("n_frames") > LEAST_FRAMES) & (F.col("seconds") > 0)).withColumn("_v", F.col("n_frames") / F.col("seconds"))
    out = flat.join(medians(each, [step], "_v").withColumnRenamed("median", "per_segment"), step, "left")
    return out.join(medians(rate, [step], "_v").withColumnRenamed("median", "frames_a_second"), step, "left")


def step_cost(n_segments: Column, n_frames: Column) -> Column:
    """A step's expected seconds in a run: by its frames, else by its segments, else as always, else nothing."""
    frames = F.when((n_frames > 0) & (F.col("frames_a_second") > 0), n_frames / F.col("frames_a_second"))
    return F.coalesce(frames, F.when(n_segments > 0, F.col("per_segment") * n_segments), F.col("flat"), F.lit(0.0))


def time_left(headers: DataFrame, runs: DataFrame, steps: list[str], times: DataFrame, run: list[str], order: str, at: str, step: str, by_frame: list[str]) -> DataFrame:
    """At each header of the running ``runs``: total, elapsed and remaining seconds, and the frames a second of the step before it, if that is bound by frames.

    ``steps`` are all steps in order, ``times`` what was :func:`learned`. What remains
    is the cost of the step that begins and of all after it.
    """
    each = runs.select("*", F.posexplode(F.array(*map(F.lit, steps))).alias("ord", step))
    cost = each.join(F.broadcast(times.where(F.col(step).isin(steps))), step, "left").withColumn("_cost", step_cost(F.col("n_segments"), F.col("n_frames")))  # at most a row for each step
    later = Window.partitionBy(*run).orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cost = cost.withColumn("remaining", F.sum("_cost").over(later)).withColumn("total", F.sum("_cost").over(Window.partitionBy(*run)))
    w = Window.partitionBy(*run).orderBy(order)
    seen = headers.withColumn("_before", F.lag(step).over(w)).withColumn("_since", F.lag(at).over(w)).withColumn("_began", F.first(at).over(w))
    rows = seen.join(cost.select(*run, step, "remaining", "total", "n_frames"), [*run, step])
    rate = F.when(F.col("_before").isin(by_frame) & (F.col("n_frames") > 0) & (F.col(at) > F.col("_since")), F.col("n_frames") / (F.col(at) - F.col("_since")))
    return rows.select(*run, order, step, "total", (F.col(at) - F.col("_began")).alias("elapsed"), "remaining", rate.alias("frames_a_second"))

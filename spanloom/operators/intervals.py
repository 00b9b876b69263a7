"""Interval algebra: caps, pads, splits, sliding windows, and the windows that a clip's peaks leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import capped_clusters


def capped(start: Column, end: Column, centre: Column, longest: int) -> Column:
    """[start, end] cut to ``longest`` around ``centre``, moved to stay inside: a struct (s, e)."""
    low = F.greatest(start, F.least(centre - longest // 2, end - longest))
    return F.when(end - start <= longest, F.struct(start.alias("s"), end.alias("e"))).otherwise(F.struct(low.alias("s"), (low + longest).alias("e")))


def padded(start: Column, end: Column, before: int, after: int, duration: Column) -> Column:
    """[start - before, end + after] within [0, duration]: a struct (s, e)."""
    return F.struct(F.greatest(F.lit(0), start - before).alias("s"), F.least(duration, end + after).alias("e"))


def split_long(df: DataFrame, start: str, duration: str, longest: int) -> DataFrame:
    """Parts of equal floor length, as few as fit ``longest``; the last takes the rest: part, part_start_us, part_us."""
    n = F.greatest(F.lit(1), F.ceil(F.col(duration) / F.lit(longest)).cast("long"))
    rows = df.withColumn("_n", n).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    each = F.expr(f"{duration} div _n")
    length = F.when(F.col("part") == F.col("_n") - 1, F.col(duration) - each * (F.col("_n") - 1)).otherwise(each)
    return rows.withColumn("part_start_us", F.col(start) + each * F.col("part")).withColumn("part_us", length).drop("_n")


def sliding(df: DataFrame, duration: str, width: int, stride: int) -> DataFrame:
    """Windows from 0 on; the first that reaches the end is cut there and is the last: w_start_us, w_end_us."""
    last = F.when(F.col(duration) <= width, F.lit(0).cast("long")).otherwise(F.ceil((F.col(duration) - width) / F.lit(stride)).cast("long"))
    rows = df.where(F.col(duration) > 0).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.withColumn("w_start_us", F.col("_i") * stride).withColumn("w_end_us", F.least(F.col("w_start_us") + width, F.col(duration))).drop("_i")


def by_route(df: DataFrame, duration: str, longest: int, width: int, stride: int) -> DataFrame:
    """Adds route and windows: what is longer than ``longest`` is windowed, all else is one window, its whole: route, w_start_us, w_end_us."""
    long = sliding(df.where(F.col(duration) > longest), duration, width, stride).withColumn("route", F.lit("windowed"))
    short = df.where(F.col(duration) <= longest).withColumn("w_start_us", F.lit(0).cast("long")).withColumn("w_end_us", F.col(duration).cast("long")).withColumn("route", F.lit("single"))
    return long.unionByName(short)


def scene_clusters(windows: DataFrame, by: list[str], start: str, end: str, label: str, conf: str, order: str, gap: int, span: int, gate: float = 0.45, below: float = 0.20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Clusters of each scene's windows: start_us, end_us, conf, peak_start_us, peak_end_us and label.

    The best label that isn't ``other`` leads (the first of ties by ``order``), and
    ``other`` where there is none; chances are pooled with it; what is within ``gap`` of a cluster's end joins it
    unless it grows over ``span``. Columns to ``keep`` are the same in all rows of a scene.
    """
    best = F.max(F.struct((F.col(label) != "other").alias("real"), F.col(conf).alias("c"), (-F.col(order)).alias("o"), F.col(label).alias("l"))).alias("_m")
    lead = windows.groupBy(*by).agg(best, *[F.max(c).alias(c) for c in keep]).select(*by, F.col("_m.c").alias("_best"), F.col("_m.l").alias("_lead"), *keep)
    pool = windows.join(lead.drop(*keep), by).where(((F.col(label) == F.col("_lead")) | (F.col(label) == "scoring_chance")) & (F.col(conf) >= F.least(F.lit(gate), F.col("_best") - below)))
    found = capped_clusters(pool, by, start, end, conf, gap, span)
    return found.join(lead.select(*by, F.col("_lead").alias("label"), *keep), by)


def trim_of(start: Column, end: Column, peak_start: Column, peak_end: Column, duration: Column, before: int, after: int, longest: int) -> Column:
    """The padded cluster, cut to ``longest`` around the middle of its peak."""
    p = padded(start, end, before, after, duration)
    return capped(p["s"], p["e"], F.floor((peak_start + peak_end) / 2), longest)


WINDOWS = "array<struct<s:bigint,e:bigint,c:double,p:boolean>>"


def united(windows: Column, slack: int) -> Column:
    """Unions of an array of windows (s, e, c, p) that are at most ``slack`` apart, in order: the largest c of each, and whether any is the primary. For the few windows of one scene."""

    def join(done: Column, w: Column) -> Column:
        last = F.element_at(done, -1)
        both = F.struct(last["s"].alias("s"), F.greatest(last["e"], w["e"]).alias("e"), F.greatest(last["c"], w["c"]).alias("c"), (last["p"] | w["p"]).alias("p"))
        return F.when((F.size(done) > 0) & (w["s"] <= last["e"] + slack), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(w)))

    return F.reduce(F.array_sort(windows), F.expr(f"cast(array() as {WINDOWS})"), join)


def scene_trims(
    windows: DataFrame, by: list[str], start: str, end: str, label: str, conf: str, duration: str,
    gap: int, span: int, before: int, after: int, longest: int, slack: int, strong: float = 0.60, most: int = 2,
) -> DataFrame:
    """What is shown of each scene: label, conf, window_start_us, window_end_us, trim_start_us, trim_end_us and extras (s, e, c).

    A chance's primary cluster is the first (the shot that began it), another label's
    the most confident (the first of ties). Up to ``most`` other clusters with a window
    of at least ``strong`` are extras, in order of time. Windows are padded and cut. A
    chance's primary is united with what is within ``slack`` of it, and the union that
    holds it is the trim; of other labels only the extras are united, and the trim is
    null: it is decided later. Times are from the scene's start; ``duration`` is the
    same in all rows of a scene.
    """
    found = scene_clusters(windows, by, start, end, label, conf, start, gap, span, keep=(duration,)).withColumnRenamed(duration, "_dur")
    trim = trim_of(F.col("start_us"), F.col("end_us"), F.col("peak_start_us"), F.col("peak_end_us"), F.col("_dur"), before, after, longest)
    chance = F.col("label") == "scoring_chance"
    window = lambda primary: F.struct(trim["s"].alias("s"), trim["e"].alias("e"), F.col("conf").alias("c"), F.lit(primary).alias("p"))
    leads = F.struct(F.when(~chance, F.col("conf")).otherwise(0.0), -F.col("start_us"))
    first = found.groupBy(*by).agg(F.max("conf").alias("conf"), F.max_by(F.struct("label", F.col("start_us").alias("s"), F.col("end_us").alias("e"), window(True).alias("w")), leads).alias("_first"))
    others = found.join(first.select(*by, F.col("_first.s").alias("_s")), by).where((F.col("start_us") != F.col("_s")) & (F.col("conf") >= strong))
    number = F.row_number().over(Window.partitionBy(*by).orderBy("start_us"))
    others = others.withColumn("_n", number).where(F.col("_n") <= most).groupBy(*by).agg(F.collect_list(window(False)).alias("_others"))  # at most ``most``
    rows = first.join(others, by, "left").withColumn("_others", F.coalesce("_others", F.expr(f"cast(array() as {WINDOWS})")))
    is_chance = F.col("_first.label") == "scoring_chance"
    rows = rows.withColumn("_all", united(F.when(is_chance, F.concat(F.array("_first.w"), "_others")).otherwise(F.col("_others")), slack))
    own = F.get(F.filter("_all", lambda w: w["p"]), F.lit(0))
    extras = F.transform(F.filter("_all", lambda w: ~w["p"]), lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), w["c"].alias("c")))
    return rows.select(*by, F.col("_first.label").alias("label"), "conf", F.col("_first.s").alias("window_start_us"), F.col("_first.e").alias("window_end_us"), own["s"].alias("trim_start_us"), own["e"].alias("trim_end_us"), extras.alias("extras"))

"""Choosing what goes into the output, in what order, and where it starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import MOST_RANGES, PART, row_number, scan, sum_before

#: The labels that are worth showing, and their least confidence.
HIGHLIGHTS, LEAST_HIGHLIGHT = ("goal", "save", "hit", "fight", "celebration", "goal_replay", "scoring_chance"), 0.55


def is_highlight(label: Column, conf: Column, least: float = LEAST_HIGHLIGHT) -> Column:
    return F.coalesce(label.isin(*HIGHLIGHTS) & (conf >= least), F.lit(False))


def select_capped(df: DataFrame, by: list[str], seq: str, always: Column, ranked: Column, conf: str, cap: int, most_ranked: int) -> DataFrame:
    """Rows kept under a cap on each group: all of ``always``; then others first come first served; then, if room is left, up to ``most_ranked`` of ``ranked`` by confidence (earlier first of ties)."""
    rows = df.withColumn("_class", F.when(always, 0).when(ranked, 2).otherwise(1))
    if PART in df.columns:
        return _select_long(rows, by, seq, conf, cap, most_ranked).select(df.columns)
    whole = Window.partitionBy(*by)
    rows = rows.withColumn("_always", F.sum(F.when(F.col("_class") == 0, 1).otherwise(0)).over(whole)).withColumn("_others", F.sum(F.when(F.col("_class") == 1, 1).otherwise(0)).over(whole))
    first = F.row_number().over(Window.partitionBy(*by, "_class").orderBy(seq))
    best = F.row_number().over(Window.partitionBy(*by, "_class").orderBy(F.col(conf).desc(), seq))
    room = F.greatest(F.lit(cap) - F.col("_always"), F.lit(0))
    left = F.least(F.greatest(room - F.col("_others"), F.lit(0)), F.lit(most_ranked))
    rows = rows.withColumn("_first", first).withColumn("_best", best)
    keep = (F.col("_class") == 0) | ((F.col("_class") == 1) & (F.col("_first") <= room)) | ((F.col("_class") == 2) & (F.col("_best") <= left))
    return rows.where(keep).drop("_class", "_always", "_others", "_first", "_best")


def _select_long(rows: DataFrame, by: list[str], seq: str, conf: str, cap: int, most_ranked: int) -> DataFrame:
    """The same where groups are long: counts are aggregated, and each task sends on no more rows of a group than the cap lets in."""
    counts = rows.groupBy(*by).agg(F.count_if(F.col("_class") == 0).alias("_always"), F.count_if(F.col("_class") == 1).alias("_others"))
    counts = counts.withColumn("_room", F.greatest(F.lit(cap) - F.col("_always"), F.lit(0)))
    counts = counts.select(*by, "_room", F.least(F.greatest(F.col("_room") - F.col("_others"), F.lit(0)), F.lit(most_ranked)).alias("_left"))

    def first(kind: int, n: int, room: str, *order: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        near = rows.where(F.col("_class") == kind).withColumn("_n", place).where(F.col("_n") <= n)
        return near.join(counts, by).where(F.col("_n") <= F.col(room)).drop("_n", "_room", "_left")

    return rows.where("_class = 0").unionByName(first(1, cap, "_room", F.col(seq))).unionByName(first(2, most_ranked, "_left", F.col(conf).desc(), F.col(seq)))


def output_timeline(df: DataFrame, by: list[str], section: Column, seq: str, duration: str, limit: int | None = None) -> DataFrame:
    """Adds pos, out_start_us and out_end_us: the first section first, then by seq; beyond ``limit`` rows are cut or left out."""
    rows = df.withColumn("_s", section)
    if PART in df.columns:  # ranges of each section, in the order of sections
        rows = rows.withColumn(PART, F.col("_s") * MOST_RANGES + F.col(PART))
    rows = scan(rows, by, ["_s", seq], {"pos": row_number(), "out_start_us": sum_before(duration)})
    end = F.col("out_start_us") + F.col(duration)
    rows = rows.withColumn("out_end_us", end if limit is None else F.least(end, F.lit(limit))).drop("_s")
    return rows if limit is None else rows.where(F.col("out_start_us") < limit)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")

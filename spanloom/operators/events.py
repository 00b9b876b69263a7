"""From hits to events: the ways to collapse what is near in time. They differ, and none stands for another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import Step, ordered_fold
from .scans import PART, lag, last_before, max_before, row_number, running_sum, scan, split, whole_max


def _w(by: list[str], *order: str | Column):
    return Window.partitionBy(*by).orderBy(*order)


def sessions(df: DataFrame, by: list[str], at: str, gap: int, name: str = "session") -> DataFrame:
    """A new session starts where the previous hit is more than ``gap`` before (equal joins)."""
    rows = scan(df, by, [at], {"_before": lag(at)}).withColumn("_new", F.when(F.col(at) - F.col("_before") > gap, 1).otherwise(0))
    return scan(rows, by, [at], {name: running_sum("_new")}).drop("_before", "_new")


class _Throttle(Step):
    def __init__(self, at: int, gap: int):
        self.at, self.gap, self.last = at, gap, None

    def row(self, row):
        if self.last is None or row[self.at] - self.last > self.gap:
            self.last = row[self.at]
            return (row,)
        return ()


def _typed(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def throttle(df: DataFrame, by: list[str], at: str, gap: int, order: list[str] | None = None) -> DataFrame:
    """Keeps a hit unless the last *kept* one is at most ``gap`` before."""
    rest = [c for c in df.columns if c not in by]
    split = sessions(df, by, at, gap, "_stretch")  # beyond such a gap every hit is kept: state starts anew
    out = ordered_fold(split, [*by, "_stretch"], [at, *(order or [])], lambda: _Throttle(rest.index(at), gap), _typed(df, rest))
    return out.drop("_stretch").select(df.columns)


class _KeyedThrottle(Step):
    def __init__(self, at: int, keys: list[int], gap: int):
        self.at, self.keys, self.gap, self.last = at, keys, gap, None

    def row(self, row):
        key = [row[k] for k in self.keys]
        if self.last is None or key != self.last[0] or row[self.at] - self.last[1] > self.gap:
            self.last = key, row[self.at]
            return (row,)
        return ()


def throttle_runs(df: DataFrame, by: list[str], at: str, keys: list[str], gap: int, order: list[str] | None = None) -> DataFrame:
    """Drops a hit only if the last kept one, of any kind, has the same keys (null equals null) and is at most ``gap`` before."""
    rest = [c for c in df.columns if c not in by]
    split = sessions(df, by, at, gap, "_stretch")
    out = ordered_fold(split, [*by, "_stretch"], [at, *(order or [])], lambda: _KeyedThrottle(rest.index(at), [rest.index(k) for k in keys], gap), _typed(df, rest))
    return out.drop("_stretch").select(df.columns)


def _apart(df: DataFrame, by: list[str], start: str, end: str, slack: int, name: str = "_stretch") -> DataFrame:
    """Adds ``name``: a new one where a window starts more than ``slack`` after the end of all before it. What is folded starts anew there."""
    rows = scan(df, by, [start, end], {"_reach": max_before(end)}).withColumn("_new", F.when(F.col(start) - F.col("_reach") > slack, 1).otherwise(0))
    return scan(rows, by, [start, end], {name: running_sum("_new")}).drop("_reach", "_new")


def _only(df: DataFrame, *columns: str) -> DataFrame:
    """These columns, and the number of the range where there is one."""
    return df.select(*columns, *split(df))


class _Capped(Step):
    """Clusters with a bounded span; the earlier of equal peaks stays."""

    def __init__(self, gap, span):
        self.gap, self.span, self.now = gap, span, None

    def row(self, row):
        start, end, conf = row
        c = self.now
        if c and start - c[1] <= self.gap and max(c[1], end) - c[0] <= self.span:
            c[1] = max(c[1], end)
            if conf > c[2]:
                c[2:] = [conf, start, end]
            return ()
        self.now = [start, end, conf, start, end]
        return (tuple(c),) if c else ()

    def end(self):
        return (tuple(self.now),) if self.now else ()


def capped_clusters(df: DataFrame, by: list[str], start: str, end: str, conf: str, gap: int, span: int) -> DataFrame:
    """Joins a window to the last cluster if it starts within ``gap`` of its end and the whole stays within ``span``: start_us, end_us, conf, peak_start_us, peak_end_us."""
    rows = _apart(_only(df, *by, start, end, conf), by, start, end, gap)
    return ordered_fold(rows.drop(PART), [*by, "_stretch"], [start, end], lambda: _Capped(gap, span), "start_us long, end_us long, conf double, peak_start_us long, peak_end_us long").drop("_stretch")


def union_intervals(df: DataFrame, by: list[str], start: str, end: str, slack: int, conf: str = "conf", primary: str = "primary") -> DataFrame:
    """Unions of intervals at most ``slack`` apart: start_us, end_us, the largest conf, whether any was primary."""
    rows = _apart(df, by, start, end, slack, "island")
    return rows.groupBy(*by, "island").agg(F.min(start).alias("start_us"), F.max(end).alias("end_us"), F.max(conf).alias("conf"), F.bool_or(primary).alias("primary"))


class _Abut(Step):
    def __init__(self, longest, least):
        self.longest, self.least, self.now = longest, least, None

    def row(self, row):
        start, end = row
        if self.now and start <= self.now[1]:
            if end - self.now[0] <= self.longest:
                self.now[1] = max(self.now[1], end)
                return
            start = self.now[1]
            if end - start < self.least:
                return
        if self.now:
            yield tuple(self.now)
        self.now = [start, end]

    def end(self):
        return (tuple(self.now),) if self.now else ()


def fold_or_abut(df: DataFrame, by: list[str], start: str, end: str, longest: int, least: int) -> DataFrame:
    """Windows without overlap: one that touches the last extends it up to ``longest``, else starts where that ended (dropped below ``least``)."""
    rows = _apart(_only(df, *by, start, end), by, start, end, 0)
    return ordered_fold(rows.drop(PART), [*by, "_stretch"], [start, end], lambda: _Abut(longest, least), "start_us long, end_us long").drop("_stretch")


def last_cluster(df: DataFrame, by: list[str], seq: str, flag: Column, gap: int) -> DataFrame:
    """Adds in_last_cluster: flagged rows of the last group whose positions are at most ``gap`` apart; earlier ones are false, unflagged null."""
    rows = df.withColumn("_flag", flag).withColumn("_at", F.when(F.col("_flag"), F.col(seq)))
    rows = scan(rows, by, [seq], {"_before": last_before("_at")})
    rows = rows.withColumn("_start", F.when(F.col("_flag") & (F.col("_before").isNull() | (F.col(seq) - F.col("_before") > gap)), F.col(seq)))
    rows = scan(rows, by, [seq], {"_first": whole_max("_start")})
    return rows.withColumn("in_last_cluster", F.when(F.col("_flag"), F.col(seq) >= F.col("_first"))).drop("_flag", "_at", "_before", "_start", "_first")


def boolean_runs(df: DataFrame, by: list[str], seq: str, at: str, flag: Column, value: str, tail: int = 10, least: int = 0) -> DataFrame:
    """Runs of true that a false row ends (an open last run is dropped): start_us, end_us (of the false row) and the mean of the last ``tail`` values."""
    rows = df.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_off", F.when(F.col("_flag"), 0).otherwise(1))
    rows = scan(rows, by, [seq], {"_run": running_sum("_off")})
    ends = rows.where(~F.col("_flag")).select(*by, (F.col("_run") - 1).alias("_run"), F.col(at).alias("end_us"))
    back = Window.partitionBy(*by, "_run").orderBy(F.col(seq).desc())
    inside = rows.where("_flag").withColumn("_n", F.row_number().over(back))
    runs = inside.groupBy(*by, "_run").agg(F.min(at).alias("start_us"), F.avg(F.when(F.col("_n") <= tail, F.col(value))).alias("energy"))
    return runs.join(ends, [*by, "_run"]).where(F.col("end_us") - F.col("start_us") >= least).drop("_run")


def middle(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row at position n div 2 (from 0) of each group of n."""
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("_i", F.row_number().over(_w(by, order)) - 1).withColumn("_n", n).where("_i = floor(_n / 2)").drop("_i", "_n")


def greedy_peaks(df: DataFrame, by: list[str], at: str, score: str, apart: int, most: int) -> DataFrame:
    """At most ``most`` rows of each group, best first (the earlier of ties), each at least ``apart`` from all better ones taken. Each is one aggregate over what is left."""
    rest, found = df.select(*by, at, score), None
    for rank in range(1, most + 1):
        top = F.max(F.struct(F.col(score).alias("s"), (-F.col(at)).alias("t"))).alias("_m")
        best = rest.groupBy(*by).agg(top).select(*by, (-F.col("_m.t")).alias("_at"), F.col("_m.s").alias("_s"))
        own = best.select(*by, F.col("_at").alias(at), F.col("_s").alias(score), F.lit(rank).cast("long").alias("rank"))
        found = own if found is None else found.unionByName(own)
        rest = rest.join(best.select(*by, "_at"), by).where(F.abs(F.col(at) - F.col("_at")) >= apart).drop("_at")
    return found


def virtual_steps(df: DataFrame, by: list[str], seq: str, replay: Column) -> DataFrame:
    """Adds step: positions where a run of replays counts once."""
    rows = scan(df.withColumn("_r", replay), by, [seq], {"_b": lag("_r")})
    rows = rows.withColumn("_c", F.when(F.col("_r") & F.coalesce("_b", F.lit(False)), 0).otherwise(1))
    return scan(rows, by, [seq], {"step": running_sum("_c")}).drop("_r", "_b", "_c")


def replaced(df: DataFrame, new: DataFrame, by: list[str], at: str, kind: str, order: list[str]) -> DataFrame:
    """Events with those of ``new`` in place of all of the same kind in the same group, in order of time again: adds pos (from 0)."""
    rows = df.join(new.select(*by, kind).distinct(), [*by, kind], "left_anti").unionByName(new)
    return scan(rows, by, [at, *order], {"pos": row_number()}).withColumn("pos", F.col("pos") - 1)


def last_of_kind(df: DataFrame, by: list[str], at: str, kind: str, kinds: list[str]) -> DataFrame:
    """Of the listed kinds only the last row of each group stays; other rows all do."""
    last = df.where(F.col(kind).isin(kinds)).groupBy(*by, kind).agg(F.max(at).alias("_last"))  # at most a row for each kind and group
    return df.join(last, [*by, kind], "left").where(F.col("_last").isNull() | (F.col(at) == F.col("_last"))).select(df.columns)

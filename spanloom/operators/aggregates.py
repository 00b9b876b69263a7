"""Peaks, votes, best readings, de-duplication, learned durations and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_peak(df: DataFrame, by: list[str], at: str, score: str) -> DataFrame:
    """The highest score of each key and the first time it is reached."""
    top = F.max(F.struct(F.col(score).alias("s"), (-F.col(at)).alias("t")))
    return df.groupBy(*by).agg(top.alias("_m")).select(*by, F.col("_m.s").alias(score), (-F.col("_m.t")).alias(at))


def weighted_vote(df: DataFrame, by: list[str], value: str, weight: str, order: str) -> DataFrame:
    """The value of the largest total weight; of ties the one seen first."""
    votes = df.groupBy(*by, value).agg(F.sum(weight).alias("votes"), F.min(order).alias("seen"))
    best = F.max_by(F.struct(value, "votes", "seen"), F.struct(F.col("votes").alias("v"), (-F.col("seen")).alias("s"))).alias("_m")
    return votes.groupBy(*by).agg(best).select(*by, "_m.*")


def best_by(df: DataFrame, by: list[str], ranks: list[Column], order: str, columns: list[str]) -> DataFrame:
    """The row of the greatest ranks, in their order of weight; the first in ``order`` of ties."""
    key = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(ranks)], (-F.col(order)).alias("o"), *columns)
    return df.groupBy(*by).agg(F.max(key).alias("_m")).select(*by, *[F.col(f"_m.{c}").alias(c) for c in columns])


def most_rows(df: DataFrame, by: list[str], version: str, order: str) -> DataFrame:
    """Of the versions of each table the one with the most rows, the first of ties; with the place where the table was first seen."""
    versions = df.groupBy(*by, version).agg(F.count("*").alias("rows"), F.min(order).alias("first_seen"))
    w = Window.partitionBy(*by).orderBy(F.col("rows").desc(), "first_seen")
    out = versions.withColumn("_n", F.row_number().over(w)).withColumn("first_seen", F.min("first_seen").over(Window.partitionBy(*by)))
    return out.where("_n = 1").drop("_n")


def exact_medians(df: DataFrame, by: list[str], value: str, low: int, high: int, bins: int = 4_096) -> DataFrame:
    """median and n of a whole-numbered ``value`` in [low, high) for each key, without bringing a key's rows together.

    Equal values are counted first; counts of bins of values show in which one or
    two the middle lies, and only those are looked at value by value.
    """
    width = -(-(high - low) // bins)
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_k")).withColumn("_bin", F.floor((F.col(value) - low) / width))
    per = counts.groupBy(*by, "_bin").agg(F.sum("_k").alias("_rows"))
    ahead = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_rows").over(ahead), F.lit(0))).withColumn("n", F.sum("_rows").over(Window.partitionBy(*by)))
    lower, upper = F.expr("(n - 1) div 2"), F.expr("n div 2")
    holds = lambda at, before, rows: (F.col(before) <= at) & (at < F.col(before) + F.col(rows))
    inside = counts.join(per.where(holds(lower, "_before", "_rows") | holds(upper, "_before", "_rows")), [*by, "_bin"])
    within = Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_k").over(within), F.lit(0)))
    middle = lambda at: F.max(F.when(holds(at, "_at", "_k"), F.col(value)))
    return inside.groupBy(*by, "n").agg(((middle(lower) + middle(upper)) / 2).alias("median")).select(*by, "median", "n")


def step_medians(df: DataFrame, by: list[str], run: str, order: str, at: str, step: str, longest: int, runs: int) -> DataFrame:
    """Median time from each step's line to the next, over the latest ``runs`` runs of each group, durations in [0, ``longest``)."""
    latest = df.groupBy(*by, run).agg(F.max(at).alias("_end"))
    latest = latest.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_end").desc(), run))).where(F.col("_n") <= runs).select(*by, run)
    rows = df.join(latest, [*by, run]).withColumn("_d", F.lead(at).over(Window.partitionBy(*by, run).orderBy(order)) - F.col(at))
    return exact_medians(rows.where((F.col("_d") >= 0) & (F.col("_d") < longest)), [step], "_d", 0, longest)


def class_weights(df: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """total / (k * count) for each of the k classes, 0 for one without rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total, k = df.agg(F.count("*")).scalar(), classes.agg(F.count("*")).scalar()
    rows = classes.join(counts, label, "left").select(label, F.coalesce(F.col("n"), F.lit(0)).alias("n"))
    return rows.withColumn("weight", F.when(F.col("n") > 0, total / (k * F.col("n"))).otherwise(0.0))


def levels(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Root mean square of each key and its decibels against the loudest one: rms and db."""
    r = df.groupBy(*by).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return r.withColumn("db", 20 * F.log10(F.col("rms") / r.agg(F.max("rms")).scalar()))


def quantiles(df: DataFrame, by: list[str], value: str, share: float, bins: int = 4_096) -> DataFrame:
    """by, level (the interpolated quantile of numbers of any size), above (values greater than it) and n, without bringing a key's rows together.

    Equal values are counted first. Counts of bins between each key's least and
    greatest value show where the one or two values lie that the quantile is made of,
    and only those bins are looked at value by value.
    """
    span = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    bin_of = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0).cast("long"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k")).join(span, by).withColumn("_bin", bin_of)
    per = counts.groupBy(*by, "_bin").agg(F.sum("_k").alias("_rows"))
    ahead = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_rows").over(ahead), F.lit(0))).withColumn("n", F.sum("_rows").over(Window.partitionBy(*by)))
    place = (F.col("n") - 1) * F.lit(share)
    lower, upper = F.floor(place), F.ceil(place)
    holds = lambda at, before, rows: (F.col(before) <= at) & (at < F.col(before) + F.col(rows))
    inside = counts.join(per.where(holds(lower, "_before", "_rows") | holds(upper, "_before", "_rows")), [*by, "_bin"])
    within = Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_k").over(within), F.lit(0)))
    pick = lambda at, c: F.max(F.when(holds(at, "_at", "_k"), c))
    found = inside.groupBy(*by, "n").agg(pick(lower, F.col(value)).alias("_a"), pick(upper, F.col(value)).alias("_b"), pick(upper, F.col("_at")).alias("_from"), pick(upper, F.col("_at") + F.col("_k")).alias("_to"))
    part = place - lower
    level = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") * (1 - part) + F.col("_b") * part)
    # All values up to the upper one aren't above the level, and that one isn't if it is the level.
    above = F.col("n") - F.when(F.col("_b") <= F.col("level"), F.col("_to")).otherwise(F.col("_from"))
    return found.withColumn("level", level).select(*by, "level", above.alias("above"), "n")


def above_percentile(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """Each key's percentile (interpolated) and how many of its values are above it: level and above."""
    return quantiles(df, by, value, share).drop("n")


def widths(df: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """The largest length of each column's text in each group, under the given names."""
    return df.groupBy(*by).agg(*(F.max(F.length(F.col(c).cast("string"))).cast("long").alias(name) for c, name in columns.items()))


def surname(name: Column) -> Column:
    """The last word of a name, if it is letters only, three at least."""
    last = F.element_at(F.split(F.trim(name), r"\s+"), -1)
    return F.when(last.rlike(r"^\p{L}{3,}$"), last)


def surnames(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """The different last words of names that are letters only, three at least, as one sorted array of each group: names."""
    last = surname(F.col(name)).alias("_w")
    return df.select(*by, last).where("_w is not null").groupBy(*by).agg(F.array_sort(F.collect_set("_w")).alias("names"))


def f1_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 (0 where undefined) and support of every class, from the confusion counts alone."""
    cells = df.groupBy(truth, guess).agg(F.count("*").alias("n"))
    rows = cells.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).alias("hit"))
    columns = cells.groupBy(F.col(guess).alias("label")).agg(F.sum("n").alias("guessed"))
    both = rows.join(columns, "label", "full").na.fill(0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    both = both.withColumn("precision", ratio("hit", "guessed")).withColumn("recall", ratio("hit", "support"))
    return both.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)).drop("hit", "guessed")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def unit(x: Column) -> Column:
    """An array less its mean, of length one; zeros where it is flat. The dot product of two is their normalised cross-correlation."""
    centred = let(F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x), lambda m: F.transform(x, lambda v: v - m))
    return let(centred, lambda c: let(F.sqrt(dot(c, c)), lambda n: F.transform(c, lambda v: F.when(n > 0, v / n).otherwise(0.0))))

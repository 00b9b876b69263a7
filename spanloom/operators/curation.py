"""Training-set curation by one arithmetic hash: the same rows on every run and in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(key: str, seed: int = 42) -> Column:
    """(id * 2654435761 + seed) modulo 2^32."""
    return (F.col(key).cast("long") * F.lit(2654435761) + F.lit(seed)) % F.lit(4294967296)


#: Ranges of the hash in which a group's rows are counted and ranked, each on its own.
RANGES = 1_024


def _drawn(df: DataFrame, by: list[str], key: str, seed: int, wanted: Column | None = None) -> DataFrame:
    """Adds _i, the place (from 0) in the order of hash and key, and _n, the group's rows.

    Counts of hash ranges give where each begins, so rows are ranked range by range
    and no group is one task. Ranges for whose first place (_first) ``wanted`` does
    not hold are left out.
    """
    rows = df.withColumn("_h", shuffle_key(key, seed)).withColumn("_range", F.floor(F.col("_h") / (4294967296 // RANGES)))
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_rows"))
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_first", F.coalesce(F.sum("_rows").over(ahead), F.lit(0))).withColumn("_n", F.sum("_rows").over(Window.partitionBy(*by))).drop("_rows")
    first = first if wanted is None else first.where(wanted)
    names = [*by, "_range"]
    first = first.select(*(F.col(c).alias(f"_of{i}") for i, c in enumerate(names)), "_first", "_n")
    same = [F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(names)]
    found = rows.join(first, on=same).drop(*(f"_of{i}" for i in range(len(names))))
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_h", key)) - 1
    return found.withColumn("_i", F.col("_first") + place).drop("_h", "_range", "_first")


def capped_sample(df: DataFrame, by: list[str], key: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows of each group, drawn by hash; only hash ranges that the cap reaches are ranked."""
    return _drawn(df, by, key, seed, F.col("_first") < cap).where(F.col("_i") < cap).drop("_i", "_n")


def split_exact(df: DataFrame, by: list[str], key: str, percent: int = 80, seed: int = 42) -> DataFrame:
    """Adds part: exactly floor(percent * n / 100) rows of each group train, the others validate."""
    rows = _drawn(df, by, key, seed)
    return rows.withColumn("part", F.when(F.col("_i") < F.floor(F.col("_n") * percent / F.lit(100)), "train").otherwise("validate")).drop("_i", "_n")


def batches(df: DataFrame, by: list[str], key: str, size: int = 3, most: int | None = None, seed: int = 42) -> DataFrame:
    """Adds batch and place: shuffled rows of each group in batches of ``size``, a last one of a single row dropped."""
    rows = _drawn(df, by, key, seed)
    rows = rows.withColumn("batch", F.floor(F.col("_i") / size).cast("long")).withColumn("place", (F.col("_i") % size).cast("long"))
    rows = rows.where(F.least(F.col("_n") - F.col("batch") * size, F.lit(size)) > 1)
    return (rows if most is None else rows.where(F.col("batch") < most)).drop("_i", "_n")


def collision_names(df: DataFrame, name: str, folder: str, key: str) -> DataFrame:
    """Adds target: the name, with the folder before it for all but the first of one name."""
    first = df.groupBy(name).agg(F.min(key).alias("_first"))  # a row for each name, however many files have it
    same = F.col(name).eqNullSafe(F.col("_name"))
    rows = df.join(first.withColumnRenamed(name, "_name"), same, "left").drop("_name")
    return rows.withColumn("target", F.when(F.col(key) == F.col("_first"), F.col(name)).otherwise(F.concat_ws("_", folder, name))).drop("_first")


def classes_with(df: DataFrame, label: str, least: int) -> DataFrame:
    """Labels of at least ``least`` rows."""
    return df.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least)

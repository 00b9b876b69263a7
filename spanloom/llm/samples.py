"""Bounded samples of labelled rows, and joins with a side of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of ids that are sent to every task at most (8 bytes each); larger sides are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


#: Groups that may be so large that drawing from them takes a first cut by hash; all others have fewer than 1 / LARGE_GROUPS of the rows.
LARGE_GROUPS = 500


def lowest(rows: DataFrame, by: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each value of ``by``: those whose seeded id hash is lowest.

    Of a large group only rows below a bar go on to be ranked, so no group is a
    large task. The bar follows from the group's count and lets some more than
    ``n`` rows pass (fewer by a chance of about 1e-9).
    """
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    counts = rows.groupBy(by).agg(F.count("*").alias("_k")).where(F.col("_k") > n)
    bars = counts.orderBy(F.desc("_k"), by).limit(LARGE_GROUPS).select(by, (F.lit((n + 6 * n**0.5 + 30) * 2.0**64) / F.col("_k") - F.lit(2.0**63)).alias("_bar"))
    near = rows.join(F.broadcast(bars), by, "left").where(F.col("_bar").isNull() | (h.cast("double") < F.col("_bar"))).drop("_bar")
    order = Window.partitionBy(by).orderBy(h, "doc_id")
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def matched(docs: DataFrame, ids: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` joined with ``ids`` on doc_id, without moving texts where the ids are few."""
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", how)


#: Rows of a look-up whose table, no longer than they are, goes to every task.
SMALL_LOOKUP = 100_000


def looked_up(rows: DataFrame, key: str, table: DataFrame, total: int, small: int | None = None) -> DataFrame:
    """``rows`` (``total`` of them) left-joined with ``table`` on a long ``key``; ``table`` has some of their keys, each once, with the number of its rows as ``weight``.

    Keys of more than 1 / LARGE_GROUPS of all ``total`` rows (so there are at most
    LARGE_GROUPS) are looked up by broadcast, and their rows are dealt out by a
    hash instead of their key: no key is a large task. With no more than ``small``
    rows (SMALL_LOOKUP) the whole table is looked up by broadcast.
    """
    if total <= (SMALL_LOOKUP if small is None else small):
        return rows.join(F.broadcast(table.drop("weight")), key, "left").select(*rows.columns, *[c for c in table.columns if c not in (key, "weight")])
    values = [c for c in table.columns if c not in (key, "weight")]
    large = F.col("weight") * LARGE_GROUPS > total
    head = table.where(large).select(key, F.struct(*values).alias("_large"))
    rest = table.where(~large).select(F.col(key).alias("_key"), F.struct(*values).alias("_small"))
    first = rows.join(F.broadcast(head), key, "left")
    first = first.withColumn("_key", F.when(F.col("_large").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns)))
    found = first.join(rest, "_key", "left").withColumn("_found", F.coalesce("_large", "_small"))
    return found.select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in values])

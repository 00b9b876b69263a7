"""Operator 10: balanced, contiguous shards from global byte-size prefix sums.

Rows have one total order: (bucket, hot-text rank, text hash, salt, doc_id).
A bucket is the top bits of the text's hash, so equal texts stand together. A
text that holds more than ``1 / hot_share`` of all rows is salted by doc_id into
buckets of its own, so that no task ever sorts an unbounded group; these stand
together too, and what the text holds in all is known from their totals. Per-bucket
totals (at most ``buckets`` + hot_share * salts rows) are summed up into each
bucket's first byte and row, a window adds what comes before a row inside its
bucket, and the cuts fall at equal byte targets.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import drop, written

SHARDS, OVERHEAD = 40, 16


def sizes(docs: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size (UTF-8 bytes + ``overhead``; null text: none), text_crc32 (of no bytes for null) and the text's 64-bit hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )


def _order(rows: DataFrame, buckets: int, hot_share: int, salts: int) -> DataFrame:
    """Adds bucket (string key of one bounded group, sorting as the total order does)."""
    # At most hot_share keys can hold more than 1 / hot_share of the rows each: a proven bound for the broadcast.
    hot = (
        rows.groupBy("key").agg(F.count("*").alias("n")).where((F.col("n") > 1000) & (F.col("n") * hot_share > rows.count()))
        .select("key", F.lit(1).alias("is_hot"))
    )
    bucket = F.pmod(F.shiftrightunsigned("key", 40), F.lit(buckets))
    salt = F.when(F.col("is_hot").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(0))
    hot_key = F.when(F.col("is_hot").isNotNull(), F.col("key")).otherwise(F.lit(0))
    return rows.join(F.broadcast(hot), "key", "left").select("doc_id", "size", "text_crc32", "key", F.struct(bucket.alias("b"), hot_key.alias("h"), salt.cast("long").alias("s")).alias("bucket"))


def shard(docs: DataFrame, n_shards: int = SHARDS, overhead: int = OVERHEAD, buckets: int = 4096, hot_share: int = 500, salts: int = 64, group_share: int = 100) -> DataFrame:
    """Each row's shard and slot under the law ``bytes``.

    A row goes to the shard in which its first byte falls when the whole table
    is cut into ``n_shards`` equal byte ranges, so each shard is within one
    row's size of the target. Equal texts stand together, and a group of them of
    at most ``1 / group_share`` of a shard isn't cut, however many rows it has: it
    goes where its first byte falls. Every row counts (repeated doc_ids and rows
    too); an empty table gives no rows; null text counts ``overhead`` bytes, a very
    long one its own and goes whole.
    """
    rows = written(sizes(docs, overhead), "sizes")
    ordered = _order(rows, buckets, hot_share, salts)
    totals = ordered.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    # The buckets of one salted text: they follow each other.
    text = Window.partitionBy("bucket.b", "bucket.h")
    salted = F.col("bucket.h") != 0
    # One row a bucket: bounded by the parameters, not by the input.
    first = totals.select(
        "bucket",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("all_bytes"),
        F.when(salted, F.sum("bytes").over(text)).alias("text_bytes"),
    )
    first = first.withColumn("text_byte", F.when(salted, F.min("bytes_before").over(text)))
    inside = Window.partitionBy("bucket").orderBy("key", "doc_id", "size", "text_crc32")
    group = Window.partitionBy("bucket", "key")
    placed = (
        ordered.withColumn("row", F.row_number().over(inside) - 1)
        .withColumn("byte", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(F.broadcast(first), "bucket")
        .withColumn("row", F.col("row") + F.col("rows_before"))
        .withColumn("byte", F.col("byte") + F.col("bytes_before"))
        .withColumn("group_bytes", F.coalesce("text_bytes", F.sum("size").over(group)))
        .withColumn("group_byte", F.coalesce("text_byte", F.min("byte").over(group)))
        .withColumn("byte", F.when(F.col("group_bytes") * n_shards * group_share <= F.col("all_bytes"), F.col("group_byte")).otherwise(F.col("byte")))
        .withColumn("shard", F.expr(f"int((byte * {n_shards}) div greatest(all_bytes, 1))"))
    )
    placed = written(placed.select("doc_id", "size", "text_crc32", "shard", "row"), "placed")
    drop(rows)
    starts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # n_shards rows
    out: list[Column] = [
        F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.lit("bytes").alias("law"), F.col("shard"),
        (F.col("row") - F.col("first_row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    ]
    return placed.join(F.broadcast(starts), "shard").select(*out)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in 40 shards of near-equal bytes."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op10_sharding": op10_sharding}
ORACLES: dict[str, str] = {}

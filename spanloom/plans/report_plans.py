"""Queries of reports, picture statistics and file choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregates as ag
from ..sources import media
from .base import SEG, S, hits, segments, table


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'FIRST' WHEN 1 THEN 'SECOND' WHEN 2 THEN 'THIRD' ELSE 'OTHER' END")
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name", rank.alias("rank"))


def star_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.in_rank_order(_stars(spark, sf_dir), ["c_nationkey"], "rank", "c_custkey").select("c_nationkey", F.col("place").cast("long").alias("place"), "c_custkey")


def description_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.in_rank_order(_stars(spark, sf_dir), ["c_nationkey"], "rank", "c_custkey").withColumn("line", F.concat("rank", F.lit(": "), "c_name"))
    return media.description(rows, ["c_nationkey"], "place", "line")


def mid_period_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    raw = F.expr("CASE WHEN k % 7 = 0 THEN '1ST' ELSE concat(k % 22, ':', lpad(k % 12, 2, '0'), '\n3RD') END")
    return o.select("k", tx.mid_period(raw).cast("int").alias("running"))


def confirm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(tx.mentions(F.col("p_type"), ("promo", "Large"))).select("p_partkey", "p_type")


def settled_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = tx.settled_picture(F.col("conf"), F.col("event_id") % 20, F.col("value") * 2)
    return hits(spark, sf_dir).select("event_id", ok.cast("int").alias("done"))


def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: one of each customer, the newest."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return media.newest_of_name(o, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


def level_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clip's 85th percentile and how many of its values are above."""
    return ag.above_percentile(hits(spark, sf_dir), ["clip_id"], "value", 0.85).select("clip_id", F.round("level", 6).alias("level"), "above")


def footage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).groupBy("clip_id").agg(F.sum("dur_us").alias("total_us"), F.sum(F.floor(F.col("dur_us") / S)).alias("frames"), F.count("*").alias("n"))


_STAR = "st AS (SELECT c_nationkey, c_custkey, c_name, CASE c_custkey % 4 WHEN 0 THEN 'FIRST' WHEN 1 THEN 'SECOND' ELSE 'THIRD' END AS rank, c_custkey % 4 + 1 AS place FROM customer WHERE c_custkey % 4 < 3 QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_custkey % 4 ORDER BY c_custkey DESC) = 1)"
ORACLES = {
    "star_order": f"WITH {_STAR} SELECT c_nationkey, place, c_custkey FROM st",
    "description_text": f"WITH {_STAR} SELECT c_nationkey, '__TITLE__' || chr(10) || chr(10) || string_agg(rank || ': ' || c_name, chr(10) ORDER BY place) AS text FROM st GROUP BY c_nationkey",
    "mid_period_reject": "SELECT o_orderkey AS k, (o_orderkey % 7 <> 0 AND (o_orderkey % 22 <= 19 OR (o_orderkey % 22 = 20 AND o_orderkey % 12 > 5)))::INT AS running FROM orders",
    "confirm_text": "SELECT p_partkey, p_type FROM part WHERE upper(p_type) LIKE '%PROMO%' OR upper(p_type) LIKE '%LARGE%'",
    "settled_cards": f"WITH {SEG} SELECT event_id, (conf >= 0.65 OR (event_id % 20 >= 10 AND value * 2 > 140))::INT AS done FROM hit",
    "newest_orders": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
    "level_threshold": f"WITH {SEG}, p AS (SELECT clip_id, quantile_cont(value, 0.85) AS level FROM hit GROUP BY clip_id) SELECT clip_id, round(any_value(level), 6) AS level, count(*) FILTER (value > level) AS above FROM hit JOIN p USING (clip_id) GROUP BY clip_id",
    "footage_total": f"WITH {SEG} SELECT clip_id, sum(dur_us)::BIGINT AS total_us, sum(dur_us // {S})::BIGINT AS frames, count(*) AS n FROM seg GROUP BY clip_id",
}
QUERIES = {name: globals()[name] for name in ORACLES}

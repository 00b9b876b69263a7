"""Queries of the text scalars and of job states, over texts put together from the tables' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregates as ag
from ..operators import jobs as jb
from ..operators import joins as jn
from .base import table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_totalprice")


def clean_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    col = F.expr("CASE k % 3 WHEN 0 THEN 'MIN' WHEN 1 THEN 'SV%' ELSE 'G' END")
    raw = F.expr("CASE WHEN k % 11 = 0 THEN '' WHEN k % 7 = 0 THEN translate(concat(k % 60, ':', lpad(k % 13, 2, '0')), '01', 'Ol') WHEN k % 5 = 0 THEN concat('-', k % 1000) ELSE translate(string(k), '01', 'oI') END")
    return o.select("k", tx.clean_numeric(raw, col).alias("cleaned"))


def parse_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    raw = F.expr("concat(CASE k % 4 WHEN 0 THEN 'EDMO' WHEN 1 THEN concat('SJS ', k % 10) WHEN 2 THEN 'CGY O 12:34' ELSE 'BYFIELD' END, '|', k % 130, '|20:00\n', 'ANA ', k % 9, '|', k % 37)")
    b = tx.parse_board(raw)
    return o.select("k", b.alias("b")).select("k", "b.*")


def clock_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("concat(CASE k % 3 WHEN 0 THEN concat(k % 21, ':', lpad(k % 8, 2, '0')) WHEN 1 THEN '20:00' ELSE concat(':', k % 2, '.', k % 10) END, '\n', CASE k % 5 WHEN 0 THEN '1st' WHEN 1 THEN '2ND' WHEN 2 THEN '3RD' WHEN 3 THEN 'OT' ELSE '' END)")
    return _orders(spark, sf_dir).select("k", tx.clock_class(raw).alias("event"))


def clean_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    raw = F.concat_ws(" ", F.lit("J."), "p_name", "p_brand", F.lit("brr"), "p_type")
    return p.select("p_partkey", tx.clean_name(raw).alias("name"), tx.plausible_name(F.col("p_brand")).cast("int").alias("plausible"))


def format_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _orders(spark, sf_dir).selectExpr("k", "concat('M, Player', chr(65 + int(k % 26))) AS player", "concat(k % 60, ':', lpad(k % 60, 2, '0')) AS m", "string(k % 4) AS g", "string(k % 3) AS a", "string(k % 4 + CASE WHEN k % 5 = 0 THEN 9 ELSE k % 3 END) AS p", "CASE WHEN k % 2 = 0 THEN string(k % 8) ELSE '-' END AS h")
    return raw.select("k", tx.skater_line(*(F.col(c) for c in ("player", "m", "g", "a", "p", "h"))).alias("line")).where("line is not null")


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("k") * 7 % 20_000
    return _orders(spark, sf_dir).select("k", tx.duration_text(s).alias("duration"), tx.timecode((s % 6_000) / 4).alias("timecode"), tx.clip_name(F.lit("clip"), (s % 1_000) / 2).alias("clip"))


def stable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", tx.stable_id(F.col("url")).alias("id"), tx.scene_label(F.concat(F.lit("/clips/x_norm-scene-"), F.lpad(F.col("page_id").cast("string"), 3, "0"), F.lit(".mp4"))).alias("scene"))


def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).withColumn("status", F.expr("CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'upload_failed' ELSE 'processing' END"))
    o = o.withColumn("action", jb.next_action(F.col("status"), F.col("k") % 2 == 0))
    return o.select("k", "status", "action", jb.after(F.col("action"), F.col("k") % 5 != 0, F.col("k") % 3 != 0).alias("next_status"))


def skip_done_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return jn.pending(o.select("k"), o.where("o_orderstatus = 'F'"), ["k"])


def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.widths(table(spark, sf_dir, "customer"), ["c_mktsegment"], {"c_name": "name_width", "c_nationkey": "nation_width"})


def sorted_surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct last words of letters, three at least, as one sorted list a size."""
    return ag.surnames(table(spark, sf_dir, "part"), ["p_size"], "p_name").select("p_size", F.array_join("names", ",").alias("names"))


def rms_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square by user, in decibels below the loudest."""
    r = ag.levels(table(spark, sf_dir, "events"), ["user_id"], "value")
    return r.select("user_id", F.round("rms", 6).alias("rms"), F.round("db", 6).alias("db"))


_RAW = "CASE WHEN k % 11 = 0 THEN '' WHEN k % 7 = 0 THEN translate((k % 60) || ':' || lpad((k % 13)::VARCHAR, 2, '0'), '01', 'Ol') WHEN k % 5 = 0 THEN '-' || (k % 1000) ELSE translate(k::VARCHAR, '01', 'oI') END"
_O = "o AS (SELECT o_orderkey AS k, o_orderstatus FROM orders)"
ORACLES = {
    "clean_numeric": f"""WITH {_O}, r AS (SELECT k, {_RAW} AS raw FROM o), t AS (SELECT *, translate(raw, 'OoIl', '0011') AS v, translate(raw, 'Oo', '00') AS z FROM r)
      SELECT k, CASE WHEN raw = '' THEN '' WHEN k % 3 = 1 THEN CASE WHEN z LIKE '-%' THEN '.' || substr(z, 2) WHEN regexp_matches(z, '^[0-9]') THEN '.' || z ELSE z END
        WHEN k % 3 = 0 THEN CASE WHEN regexp_full_match(v, '[0-9]{{1,2}}:[0-9]{{2}}') THEN v WHEN length(regexp_replace(v, '[^0-9]', '', 'g')) = 4 THEN substr(regexp_replace(v, '[^0-9]', '', 'g'), 1, 2) || ':' || substr(regexp_replace(v, '[^0-9]', '', 'g'), 3) ELSE '-' END
        WHEN regexp_full_match(v, '-?[0-9]+([.][0-9]+)?') THEN v ELSE '-' END AS cleaned FROM t""",
    "parse_board": f"WITH {_O} SELECT k, (CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN k % 10 WHEN 2 THEN 0 END)::INT AS score_away, (CASE WHEN k % 4 < 3 THEN k % 9 END)::INT AS score_home, (CASE WHEN k % 4 < 3 AND k % 130 < 100 THEN k % 130 END)::INT AS shots_away, (CASE WHEN k % 4 < 3 THEN k % 37 END)::INT AS shots_home FROM o",
    "clock_class": f"""WITH {_O}, c AS (SELECT k, CASE k % 3 WHEN 0 THEN k % 21 = 20 AND k % 8 = 0 WHEN 1 THEN true ELSE false END AS st, CASE k % 3 WHEN 0 THEN k % 21 = 0 AND k % 8 <= 5 WHEN 1 THEN false ELSE k % 2 = 0 END AS nz FROM o)
      SELECT k, CASE WHEN st THEN CASE k % 5 WHEN 1 THEN 'period_start' WHEN 2 THEN 'period_start' WHEN 3 THEN 'period_start' ELSE 'game_start' END WHEN nz THEN CASE k % 5 WHEN 0 THEN 'period_end' WHEN 1 THEN 'period_end' WHEN 2 THEN 'regulation_end' WHEN 3 THEN 'ot_period_end' END END AS event FROM c""",
    "clean_name": r"""SELECT p_partkey, array_to_string(list_filter(string_split_regex(trim(regexp_replace('J. ' || p_name || ' ' || p_brand || ' brr ' || p_type, '[^A-Za-z\s''-]', ' ', 'g')), '\s+'), lambda w: regexp_full_match(w, '[A-Za-z]{3,15}') AND regexp_matches(w, '[AEIOUaeiou]'))[1:3], ' ') AS name,
      (regexp_matches(trim(p_brand), '^[A-Za-z]') AND len(list_filter(string_split_regex(trim(p_brand), '\s+'), lambda w: length(regexp_replace(w, '[^A-Za-z]', '', 'g')) >= 3)) > 0)::INT AS plausible FROM part""",
    "format_lines": f"WITH {_O} SELECT k, 'M. Player' || chr((65 + k % 26)::INT) || ' — ' || (k % 60) || ':' || lpad((k % 60)::VARCHAR, 2, '0') || ' | ' || (k % 4) || ' G, ' || (k % 3) || ' A, ' || (k % 4 + k % 3) || ' P' || CASE WHEN k % 2 = 0 THEN ' | ' || (k % 8) || ' hits' ELSE '' END AS line FROM o WHERE k % 5 <> 0",
    "time_texts": f"""WITH {_O}, s AS (SELECT k, k * 7 % 20000 AS s FROM o), t AS (SELECT *, round_even((s % 6000) / 4, 0)::BIGINT AS t FROM s)
      SELECT k, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration, lpad((t // 60)::VARCHAR, 2, '0') || ':' || lpad((t % 60)::VARCHAR, 2, '0') AS timecode, 'clip_' || lpad(printf('%.1f', (s % 1000) / 2), 7, '0') AS clip FROM t""",
    "stable_names": "SELECT page_id, 'local-' || regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g') AS id, CASE WHEN page_id < 1000 THEN lpad(page_id::VARCHAR, 3, '0') ELSE substr(page_id::VARCHAR, 1, 3) END AS scene FROM pages",
    "job_transitions": f"""WITH {_O}, s AS (SELECT k, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'upload_failed' ELSE 'processing' END AS status FROM o), a AS (SELECT *, CASE WHEN status = 'done' THEN 'skip' WHEN status = 'upload_failed' AND k % 2 = 0 THEN 'upload' ELSE 'redo' END AS action FROM s)
      SELECT k, status, action, CASE WHEN action = 'skip' THEN 'done' WHEN action = 'redo' AND k % 5 = 0 THEN 'error' WHEN k % 3 <> 0 THEN 'done' ELSE 'upload_failed' END AS next_status FROM a""",
    "skip_done_anti": "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F'",
    "column_widths": "SELECT c_mktsegment, max(length(c_name)) AS name_width, max(length(c_nationkey::VARCHAR)) AS nation_width FROM customer GROUP BY c_mktsegment",
    "sorted_surnames": "SELECT p_size, string_agg(DISTINCT w, ',' ORDER BY w) AS names FROM (SELECT p_size, string_split(p_name, ' ')[-1] AS w FROM part) WHERE regexp_full_match(w, '[A-Za-z]{3,}') GROUP BY p_size",
    "rms_levels": "WITH r AS (SELECT user_id, sqrt(avg(value * value)) AS rms FROM events GROUP BY user_id) SELECT user_id, round(rms, 6) AS rms, round(20 * log10(rms / max(rms) OVER ()), 6) AS db FROM r",
}
QUERIES = {name: globals()[name] for name in ORACLES}

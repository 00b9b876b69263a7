"""Queries of file listings, settings, logs, sinks and the scalars of names and reports. Pages and orders stand in for files and readings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import intervals as iv
from ..operators import jobs as jb
from ..operators import selection as sl
from ..shared import shared_dir
from ..sources import media
from .base import HIT, SEG, S, hits, segments, table

NOW, SETTLE = 40_000_000_000, 300_000_000
_PATH = "concat('/in/', CASE page_id % 3 WHEN 0 THEN 'raw' WHEN 1 THEN concat('raw/m', page_id % 7) ELSE 'other/x' END, '/clip.', page_id, CASE page_id % 5 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' WHEN 2 THEN '.txt' WHEN 3 THEN '.webm' ELSE '' END)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, path, modified_us and length of pages as files."""
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"{_PATH} AS path", "page_id * 1000003 % 41000000000 AS modified_us", "page_id * 37 % 40000 AS length")


def media_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.wanted(_files(spark, sf_dir)).select("page_id", "folder", "stem", "suffix")


def settled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files right in one folder that weren't written to lately."""
    found = jb.settled(_files(spark, sf_dir), "modified_us", NOW, SETTLE, media.MEDIA)
    return media.wanted(found, root="/in/raw").select("page_id", "path")


def segment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in folders of matches; those right in the root give way to them."""
    return media.segment_files(_files(spark, sf_dir), "/in/raw").select("page_id", "match", "pos")


def segment_order_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where there are no folders of matches."""
    return media.segment_files(_files(spark, sf_dir), "/in/other/x").select("page_id", "match", "pos")


def labelled_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.with_label(media.wanted(_files(spark, sf_dir))).select("page_id", "label", "stem")


_STEM = "concat('a', page_id, CASE WHEN page_id % 4 = 0 THEN '_norm' ELSE '' END)"
_TRANSFER = "CASE page_id % 3 WHEN 0 THEN ' SMPTE2084' WHEN 1 THEN 'bt709' END"


def ingest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by stem and probed transfer function against the outputs that are there."""
    f = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_STEM} AS stem", f"{_TRANSFER} AS transfer").withColumn("hdr", media.is_hdr(F.col("transfer")))
    made = f.where("page_id % 5 < 3").select(F.concat("stem", F.when(F.col("page_id") % 4 == 0, "_sdr").otherwise("_norm")).alias("stem"), (F.col("page_id") * 37 % 40_000).alias("length"))
    return media.ingest_actions(f, made).select("page_id", F.col("hdr").cast("int").alias("hdr"), "target", "action")


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a cached result that is whole."""
    f = _files(spark, sf_dir)
    return media.missing_outputs(f.select("page_id"), f.where("page_id % 4 > 0").select("page_id", "length"), "page_id")


def config_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE page_id % 4 WHEN 0 THEN concat('{\"fps\": ', page_id % 50, '}') WHEN 1 THEN concat('{\"model\": \"m', page_id, '\", \"gate\": 0.5}') WHEN 2 THEN '' END")
    c = media.settings(raw, {"fps": 30, "model": "base", "gate": 0.25, "local": False})
    return table(spark, sf_dir, "pages").select("page_id", c.alias("c")).select("page_id", "c.fps", "c.model", "c.gate", F.col("c.local").cast("int").alias("local"))


def yaml_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A YAML document for each page, with a section, a list, quotes and comments; some are more than is read."""
    raw = F.expr("""concat('# of page ', page_id, '\nfps: ', page_id % 50, '  # frames\n', CASE page_id % 3 WHEN 0 THEN concat('model: "m # ', page_id, '"\n') WHEN 1 THEN concat('model: ', substring(url, 1, 12), '\n') ELSE '' END,
      CASE page_id % 4 WHEN 0 THEN 'gate: 0.5\nlocal: true\n' WHEN 1 THEN 'gate: null\nmore:\n  fps: 7\n  labels:\n    - goal\n    - "a b"\n  last: yes\nlocal: false\n' WHEN 2 THEN 'sizes: [1, 2]\n' ELSE 'labels:\n- goal\n- hit\n' END)""")
    c = media.settings(media.yaml_json(raw), {"fps": 30, "model": "base", "gate": 0.25, "local": False})
    return table(spark, sf_dir, "pages").select("page_id", c.alias("c")).select("page_id", "c.fps", "c.model", "c.gate", F.col("c.local").cast("int").alias("local"))


def cut_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training clips to cut around confident hits, by label."""
    h = hits(spark, sf_dir).withColumn("source", F.concat(F.lit("raw/clip."), F.col("clip_id").cast("string"), F.lit(".mp4"))).withColumn("s", F.col("t_us") - 1_704_067_200_000_000 - 4 * S).withColumn("e", F.col("s") + 7 * S)
    return media.cut_list(h, F.when((F.col("conf") >= 0.5) & (F.col("label") != "other"), F.col("label")), "source", "s", "e", "clips/")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of one CSV folder a market segment, written and read back; cells with quotes and commas are whole."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.concat(F.lit('"'), "c_name", F.lit('", '), F.col("c_nationkey").cast("string")).alias("cell"))
    path = f"{shared_dir(spark)}/csv/{uuid.uuid4().hex}"
    media.write_tables(c, ["c_mktsegment"], path)
    return spark.read.option("header", True).option("escape", '"').schema("c_custkey long, cell string, c_mktsegment string").csv(path)


def timeline_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).where("conf >= 0.6").select("clip_id", "seq", "label", "start_us", "end_us")
    return media.timeline_json(s, ["clip_id"], "seq")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))


def _scalar(spark: SparkSession, sf_dir: str, raw: str, **columns) -> DataFrame:
    return _orders(spark, sf_dir).withColumn("raw", F.expr(raw)).select("k", *(f(F.col("raw")).alias(name) for name, f in columns.items()))


def failure_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    err = F.expr("CASE WHEN k % 5 = 0 THEN 'av_write: No space left on device' ELSE 'x' END")
    return _orders(spark, sf_dir).select("k", media.failure_cause(err, F.expr("int(k % 4 - 2)")).alias("cause"))


def header_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scalar(spark, sf_dir, "CASE k % 3 WHEN 0 THEN concat('| Pause  Team ', k % 32, '  Stats x stats') WHEN 1 THEN 'PAUSE STATS' ELSE '' END", team=tx.header_team)


def name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "CASE k % 5 WHEN 0 THEN 'Connor McDavid' WHEN 1 THEN 'J. Élie de la Tour Petit' WHEN 2 THEN 'ab cd EFG' WHEN 3 THEN 'Nils  Höglander' ELSE '' END"
    return _scalar(spark, sf_dir, raw, quality=tx.name_quality, title=tx.title_score)


def player_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scalar(spark, sf_dir, "concat(CASE k % 4 WHEN 0 THEN '0. ' WHEN 1 THEN '| 12 ' WHEN 2 THEN 'M. ' ELSE '' END, 'Player', k % 100, CASE WHEN k % 3 = 0 THEN ' Jr 97 X y' ELSE '' END)", player=tx.player_line)


def star_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scalar(spark, sf_dir, "CASE WHEN k % 3 = 0 THEN concat(' SAVES ', k % 40) ELSE concat('GOALS: ', k % 4, ' | ASSISTS: ', k % 5, ' | HITS: ', k % 9, ' ') END", line=tx.star_line)


def goalie_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _orders(spark, sf_dir).selectExpr("k", "CASE WHEN k % 6 = 0 THEN '12' ELSE concat('G, Goalie', chr(65 + int(k % 26))) END AS player", "CASE WHEN k % 2 = 0 THEN string(k % 40) ELSE '-' END AS shots", "CASE WHEN k % 3 = 0 THEN concat('.', 900 + k % 90) ELSE 'x' END AS share", "CASE WHEN k % 5 = 0 THEN string(k % 7) END AS against")
    return raw.select("k", tx.goalie_line(*(F.col(c) for c in ("player", "shots", "share", "against"))).alias("line"))


_FLAGS = ("transition", "intro", "game_end", "regulation_end", "banner", "inferred")


def group_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with the flags that their key's remainders give; the first that holds decides."""
    flags = {name: F.col("k") % m == 0 for name, m in zip(_FLAGS, (11, 7, 5, 4, 3, 2), strict=True)}
    row = flags | {"to_period": F.when(F.col("k") % 2 == 0, (F.col("k") % 5).cast("int")), "label": F.when(F.col("k") % 13 > 0, "hit")}
    return _orders(spark, sf_dir).select("k", tx.group_kind(row).alias("g")).select("k", "g.kind", "g.detail")


def label_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ["replay", "goal_replay", "goal", "other"]
    raw = "concat('clip', k % 50, CASE k % 6 WHEN 0 THEN '_goal' WHEN 1 THEN '_goal_replay' WHEN 2 THEN '_other' WHEN 3 THEN 'goal' WHEN 4 THEN '_goal_other' ELSE '' END)"
    return _scalar(spark, sf_dir, raw, stem=lambda c: tx.strip_suffix(c, labels))


def digit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scalar(spark, sf_dir, "concat(translate(string(k), '13', 'l|'), CASE WHEN k % 2 = 0 THEN ' FIO' ELSE ' x' END)", digits=tx.digit_line)


def upload_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scalar(spark, sf_dir, "CASE WHEN k % 3 = 0 THEN 'no address' ELSE concat('done: https://y.example/watch?v=A-', k, '_z&t=1 and /watch?v=other') END", id=tx.id_from_output)


def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "CASE k % 5 WHEN 0 THEN concat('noise\\nEnd of game ', k % 9, ' \\nx') WHEN 1 THEN concat('first\\n', k % 8, ' – ', k % 5) WHEN 2 THEN ' only\\nlines' WHEN 3 THEN '' ELSE concat('5', '-', k % 4) END"
    return _scalar(spark, sf_dir, raw, line=tx.score_line)


def log_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = "CASE WHEN k % 4 = 0 THEN concat('  12:00:00 indented ', k) ELSE concat(lpad(k % 24, 2, '0'), ':', lpad(k % 60, 2, '0'), ':', lpad(k * 7 % 60, 2, '0'), '  step ', k % 10) END"
    return media.log_lines(_orders(spark, sf_dir).withColumn("line", F.expr(raw)), "line").select("k", "clock", "text")


def state_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state document for each customer's last digit, read back as rows; one of them is broken and one empty."""
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey % 10 AS doc", "concat('local-', o_orderkey) AS id", "CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'error' END AS status", "CASE WHEN o_orderstatus <> 'F' THEN concat('code ', o_orderkey % 3) END AS error")
    pair = F.concat(F.lit('"'), "id", F.lit('": '), F.to_json(F.struct("status", "error")))
    d = o.groupBy("doc").agg(F.concat(F.lit('{"processed": {'), F.array_join(F.collect_list(pair), ", "), F.lit("}}")).alias("value"))
    d = d.withColumn("value", F.when(F.col("doc") == 3, F.substring("value", 1, 20)).when(F.col("doc") == 4, "{}").otherwise(F.col("value")))
    return jb.state_rows(d)


def route_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long segments by window, all others whole."""
    return iv.by_route(segments(spark, sf_dir), "dur_us", 10 * S, 4 * S, 2 * S).select("clip_id", "seq", "route", "w_start_us", "w_end_us")


def highlight_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("event_id", sl.is_highlight(F.col("label"), F.col("conf")).cast("int").alias("highlight"))


_FS = f"f AS (SELECT page_id, '/in/' || CASE page_id % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'raw/m' || (page_id % 7) ELSE 'other/x' END AS folder, 'clip.' || page_id AS stem, CASE page_id % 5 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' WHEN 2 THEN '.txt' WHEN 3 THEN '.webm' ELSE '' END AS suffix, page_id * 1000003 % 41000000000 AS modified_us, page_id * 37 % 40000 AS length FROM pages), m AS (SELECT * FROM f WHERE page_id % 5 IN (0, 1, 3))"
_K = "o AS (SELECT o_orderkey AS k FROM orders)"
ORACLES = {
    "media_listing": f"WITH {_FS} SELECT page_id, folder, stem, lower(suffix) AS suffix FROM m",
    "settled_files": f"WITH {_FS} SELECT page_id, folder || '/' || stem || suffix AS path FROM m WHERE folder = '/in/raw' AND {NOW} - modified_us >= {SETTLE}",
    "segment_order": f"WITH {_FS} SELECT page_id, 'm' || (page_id % 7) AS match, row_number() OVER (PARTITION BY page_id % 7 ORDER BY stem || suffix) AS pos FROM m WHERE page_id % 3 = 1 AND page_id % 5 = 0",
    "segment_order_flat": f"WITH {_FS} SELECT page_id, '' AS match, row_number() OVER (ORDER BY stem || suffix) AS pos FROM m WHERE page_id % 3 = 2 AND page_id % 5 = 0",
    "labelled_listing": f"WITH {_FS} SELECT page_id, string_split(folder, '/')[-1] AS label, stem FROM m",
    "ingest_actions": """WITH t AS (SELECT page_id, (page_id % 3 = 0)::INT AS hdr, CASE WHEN page_id % 4 > 0 THEN 'a' || page_id || '_norm' WHEN page_id % 3 = 0 THEN 'a' || page_id || '_norm_sdr' END AS target FROM pages)
      SELECT *, CASE WHEN target IS NULL THEN 'as_is' WHEN page_id % 5 >= 3 THEN 'make' WHEN page_id * 37 % 40000 > 10000 THEN 'skip' ELSE 'remake' END AS action FROM t""",
    "cache_misses": "SELECT page_id FROM pages WHERE page_id % 4 = 0 OR page_id * 37 % 40000 <= 10000",
    "config_settings": "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN page_id % 50 ELSE 30 END AS fps, CASE WHEN page_id % 4 = 1 THEN 'm' || page_id ELSE 'base' END AS model, CASE WHEN page_id % 4 = 1 THEN 0.5 ELSE 0.25 END::DOUBLE AS gate, 0 AS local FROM pages",
    "yaml_settings": """SELECT page_id, CASE WHEN page_id % 4 = 2 THEN 30 ELSE page_id % 50 END AS fps, CASE WHEN page_id % 4 = 2 OR page_id % 3 = 2 THEN 'base' WHEN page_id % 3 = 0 THEN 'm # ' || page_id ELSE substr(url, 1, 12) END AS model,
      CASE WHEN page_id % 4 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS gate, (page_id % 4 = 0)::INT AS local FROM pages""",
    "cut_list": f"""WITH {HIT}, c AS (SELECT 'raw/clip.' || clip_id || '.mp4' AS source, greatest(t_us - 1704067200000000 - {4 * S}, 0) AS start_us, t_us - 1704067200000000 + {3 * S} AS end_us, label, clip_id FROM hit WHERE conf >= 0.5 AND label <> 'other')
      SELECT source, start_us, end_us, 'clips/' || label || '/clip.' || clip_id || '_' || CASE WHEN start_us // 1000 < 1000000000 THEN lpad((start_us // 1000)::VARCHAR, 9, '0') ELSE (start_us // 1000)::VARCHAR END || '.mp4' AS target FROM c WHERE end_us > start_us""",
    "csv_round_trip": "SELECT c_mktsegment, c_custkey, '\"' || c_name || '\", ' || c_nationkey AS cell FROM customer",
    "timeline_json": f"WITH {SEG} SELECT clip_id, '[' || string_agg('{{\"seq\":' || seq || ',\"label\":\"' || label || '\",\"start_us\":' || start_us || ',\"end_us\":' || end_us || '}}', ',' ORDER BY seq) || ']' AS json FROM seg WHERE conf >= 0.6 GROUP BY clip_id",
    "failure_causes": f"WITH {_K} SELECT k, CASE WHEN k % 5 = 0 THEN 'disk full' WHEN k % 4 < 2 THEN 'signal ' || (2 - k % 4) WHEN k % 4 = 3 THEN 'error' END AS cause FROM o",
    "header_teams": f"WITH {_K} SELECT k, CASE WHEN k % 3 = 0 THEN 'TEAM ' || (k % 32) ELSE '' END AS team FROM o",
    "name_scores": f"WITH {_K} SELECT k, CASE k % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS quality, CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 0 END AS title FROM o",
    "player_lines": f"WITH {_K} SELECT k, CASE k % 4 WHEN 2 THEN 'M. ' ELSE '' END || 'Player' || (k % 100) || CASE WHEN k % 3 = 0 THEN ' Jr' || CASE WHEN k % 4 <> 2 THEN ' X' ELSE '' END ELSE '' END AS player FROM o",
    "star_lines": f"WITH {_K} SELECT k, CASE WHEN k % 3 = 0 THEN 'SAVES ' || (k % 40) ELSE (k % 4) || ' G, ' || (k % 5) || ' A, ' || (k % 9) || ' hits' END AS line FROM o",
    "goalie_lines": f"WITH {_K}, p AS (SELECT k, concat_ws(', ', CASE WHEN k % 2 = 0 THEN (k % 40) || ' shots' END, CASE WHEN k % 3 = 0 THEN '.' || (900 + k % 90) || ' SV%' END, CASE WHEN k % 5 = 0 THEN (k % 7) || ' GA' END) AS parts FROM o) SELECT k, CASE WHEN k % 6 > 0 AND parts <> '' THEN 'G. Goalie' || chr((65 + k % 26)::INT) || ' — ' || parts END AS line FROM p",
    "group_kinds": f"""WITH {_K} SELECT k, CASE WHEN k % 11 = 0 THEN 'transition' WHEN k % 7 = 0 THEN 'intro' WHEN k % 5 = 0 THEN 'game_end' WHEN k % 4 = 0 THEN 'end_of_regulation' WHEN k % 3 = 0 OR k % 2 = 0 THEN 'goal' WHEN k % 13 > 0 THEN 'hit' ELSE 'highlight' END AS kind,
      CASE WHEN k % 11 = 0 THEN CASE WHEN k % 2 = 0 AND k % 5 = 2 THEN '2ND PERIOD' WHEN k % 2 = 0 AND k % 5 = 3 THEN '3RD PERIOD' ELSE 'OVERTIME' END WHEN k % 7 = 0 THEN '{tx.KINDS["intro"]}' WHEN k % 5 = 0 THEN '{tx.KINDS["game_end"]}' WHEN k % 4 = 0 THEN '{tx.KINDS["end_of_regulation"]}' WHEN k % 3 = 0 THEN '{tx.KINDS["banner"]}' WHEN k % 2 = 0 THEN '{tx.KINDS["inferred"]}' ELSE '' END AS detail FROM o""",
    "label_suffixes": f"WITH {_K} SELECT k, 'clip' || (k % 50) || CASE k % 6 WHEN 1 THEN '_goal' WHEN 3 THEN 'goal' WHEN 4 THEN '_goal' ELSE '' END AS stem FROM o",
    "digit_lines": f"WITH {_K} SELECT k, translate(k::VARCHAR, '3', '1') || CASE WHEN k % 2 = 0 THEN ' 111' ELSE ' x' END AS digits FROM o",
    "upload_ids": f"WITH {_K} SELECT k, CASE WHEN k % 3 > 0 THEN 'A-' || k || '_z' END AS id FROM o",
    "score_lines": f"WITH {_K} SELECT k, CASE k % 5 WHEN 0 THEN 'End of game ' || (k % 9) WHEN 1 THEN (k % 8) || ' – ' || (k % 5) WHEN 2 THEN 'only' WHEN 3 THEN '' ELSE '5-' || (k % 4) END AS line FROM o",
    "log_clock": f"WITH {_K} SELECT k, k % 24 * 3600 + k % 60 * 60 + k * 7 % 60 AS clock, 'step ' || (k % 10) AS text FROM o WHERE k % 4 > 0",
    "state_documents": "SELECT 'local-' || o_orderkey AS video_id, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'error' END AS status, CASE WHEN o_orderstatus <> 'F' THEN 'code ' || (o_orderkey % 3) END AS error FROM orders WHERE o_custkey % 10 NOT IN (3, 4)",
    "route_windows": f"""WITH {SEG}, x AS (SELECT *, unnest(range(0, CASE WHEN dur_us <= {10 * S} THEN 1 ELSE ceil((dur_us - {4 * S}) / {2 * S})::BIGINT + 1 END)) AS i FROM seg)
      SELECT clip_id, seq, CASE WHEN dur_us > {10 * S} THEN 'windowed' ELSE 'single' END AS route, i * {2 * S} AS w_start_us, CASE WHEN dur_us > {10 * S} THEN least(i * {2 * S} + {4 * S}, dur_us) ELSE dur_us END AS w_end_us FROM x""",
    "highlight_flags": f"WITH {HIT} SELECT event_id, (label IN ('goal', 'goal_replay', 'scoring_chance') AND conf >= 0.55)::INT AS highlight FROM hit",
}
QUERIES = {name: globals()[name] for name in ORACLES}

"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import events as ev
from ..operators import joins as jn
from .base import HIT, SEG, S, hits, segments, table

BUCKET = 60 * S


def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    points = seg.where("label = 'goal'").select("clip_id", F.col("seq").alias("point"), (F.col("start_us") + 7 * S).alias("at_us"))
    return jn.point_in_interval(points, seg.select("clip_id", "seq", "start_us", "end_us"), ["clip_id"], "at_us", "start_us", "end_us", BUCKET).select("clip_id", "point", "seq", (F.col("at_us") - F.col("start_us")).alias("local_us"))


def overlap_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    windows = seg.where("label = 'faceoff_cutscene'").select("clip_id", F.col("seq").alias("window"), (F.col("start_us") - 3 * S).alias("w0"), (F.col("start_us") + 3 * S).alias("w1"))
    tagged = jn.overlapping(seg.select("clip_id", "seq", "start_us", "end_us"), windows, ["clip_id"], ("start_us", "end_us"), ("w0", "w1"), BUCKET)
    return tagged.groupBy("clip_id", "window").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), (F.min("w0") - F.min("start_us")).alias("trim_us"))


def padded_overlap_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    spikes = seg.where("value > 60").select("clip_id", F.col("seq").alias("spike"), F.col("start_us").alias("s0"), F.col("end_us").alias("s1"), "value")
    return jn.first_overlap(seg.select("clip_id", "seq", "start_us", "end_us"), spikes, ["clip_id"], "seq", ("start_us", "end_us"), ("s0", "s1"), "spike", "value", 3 * S, BUCKET).select("clip_id", "seq", (F.col("value") * 10).alias("boost"))


def borrow_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    rows = seg.where("label = 'goal'").withColumn("deficit", 7 * S - F.floor(F.col("dur_us") / 3))
    return jn.borrowed(rows, seg, ["clip_id"], "deficit", "start_us", S // 20, BUCKET)


def asof_last_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    clusters = ev.sessions(h.where("label = 'goal'"), ["clip_id"], "t_us", 24 * S).groupBy("clip_id", "session").agg(F.min("t_us").alias("start_us"))
    points = h.where("label = 'faceoff_cutscene'").select("clip_id", F.col("event_id").alias("point"), "t_us")
    return jn.last_before(points, clusters, ["clip_id"], "t_us", "start_us", "session")


def persist_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.persists(segments(spark, sf_dir).withColumn("v", F.floor(F.col("value") / 10)), ["clip_id"], "seq", "v").select("clip_id", "seq", F.col("persists").cast("int").alias("ok"))


def refine_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    events = h.where("label = 'goal'").select("clip_id", "event_id", F.col("value").alias("target"), (F.col("t_us") - 48 * S).alias("lo"), F.col("t_us").alias("at"))
    return jn.first_within(events, h.select("clip_id", F.col("t_us").alias("p"), "value"), ["clip_id"], "lo", "at", "event_id", "p", (F.col("value") >= F.col("target")) & (F.col("value") <= F.col("target") + 20), BUCKET).select("clip_id", "event_id", "refined_us")


def confirm_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.confirmed(hits(spark, sf_dir), ["clip_id"], "t_us", F.col("conf") >= 0.3, 10 * S, 2).select("clip_id", "event_id", F.col("confirmed").cast("int").alias("confirmed"))


def follower_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with followers that name them, within a bound of positions."""
    seg = segments(spark, sf_dir).select("clip_id", "seq", "label")
    w = Window.partitionBy("clip_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    child = seg.withColumn("parent", F.last(F.when(F.col("label") == "goal", F.col("seq")), ignorenulls=True).over(w)).where("label = 'goal_replay'")
    return child.where("parent is not null and seq - parent <= 16").groupBy("clip_id", "parent").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


def orphan_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir).select("clip_id", "seq", "label")
    children = seg.where("label = 'goal_replay'").select("clip_id", F.explode(F.array(*[F.col("seq") - i for i in (1, 2, 3)])).alias("seq"))
    return jn.orphans(seg.where("label = 'goal'"), children, ["clip_id", "seq"])


def unlabelled_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.orphans(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = spark.createDataFrame([("purchase", "goal"), ("click", "scoring_chance"), ("error", None)], "event_type string, mapped string")
    return jn.looked_up(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", lookup, "mapped").groupBy("event_type", "outcome").agg(F.count("*").alias("n"))


def nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jn.nearest_centre(hits(spark, sf_dir).where("conf >= 0.2"), "value", [25.0, 45.0, 65.0, 85.0], "row_no")
    return rows.withColumn("m", F.floor(F.col("t_us") / 1_000_000) % 60).transform(lambda d: jn.nearest_centre(d, "m", [10.0, 30.0, 50.0], "col_no")).select("event_id", "row_no", "col_no")


def fuzzy_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names whose last word was misread at one place (a letter lost, replaced or doubled), snapped to the surnames of all parts."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    roster = p.select(ag.surname(F.col("p_name")).alias("entry")).where("entry is not null").distinct()
    read = p.withColumn("w", F.element_at(F.split("p_name", " "), -1)).withColumn("at", (F.col("p_partkey") % F.length("w")).cast("int"))
    wrong = F.expr("substring(w, 1, at) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE substring(w, at + 1, 1) || substring(w, at + 1, 1) END || substring(w, at + 2)")
    read = read.select("p_partkey", F.concat(F.expr("substring(p_name, 1, length(p_name) - length(w))"), wrong).alias("name"))
    return jn.snapped(read, "p_partkey", "name", roster, "entry").select("p_partkey", "name", "corrected")


ORACLES = {
    "point_in_interval": f"WITH {SEG} SELECT p.clip_id, p.seq AS point, s.seq, p.start_us + {7 * S} - s.start_us AS local_us FROM seg p JOIN seg s ON p.clip_id = s.clip_id AND p.start_us + {7 * S} >= s.start_us AND p.start_us + {7 * S} < s.end_us WHERE p.label = 'goal'",
    "overlap_tag": f"WITH {SEG} SELECT w.clip_id, w.seq AS \"window\", count(*) AS n, min(s.seq) AS first_seq, min(w.start_us - {3 * S}) - min(s.start_us) AS trim_us FROM seg w JOIN seg s ON w.clip_id = s.clip_id AND s.end_us > w.start_us - {3 * S} AND s.start_us < w.start_us + {3 * S} WHERE w.label = 'faceoff_cutscene' GROUP BY w.clip_id, w.seq",
    "padded_overlap_boost": f"WITH {SEG} SELECT s.clip_id, s.seq, min_by(k.value, k.seq) * 10 AS boost FROM seg s JOIN seg k ON s.clip_id = k.clip_id AND k.value > 60 AND s.end_us + {3 * S} > k.start_us AND s.start_us - {3 * S} < k.end_us GROUP BY s.clip_id, s.seq",
    "borrow_preceding": f"""WITH {SEG}, g AS (SELECT clip_id, seq, start_us, {7 * S} - dur_us // 3 AS deficit FROM seg WHERE label = 'goal')
      SELECT g.clip_id, g.seq, s.seq AS from_seq, greatest(s.start_us, g.start_us - g.deficit) - s.start_us AS from_us, s.dur_us AS to_us FROM g JOIN seg s ON s.clip_id = g.clip_id AND s.seq < g.seq AND s.dur_us > 0 AND s.end_us - (g.start_us - g.deficit) > {S // 20} WHERE g.deficit > {S // 20}""",
    "asof_last_cluster": f"""WITH {HIT}, sess AS (SELECT clip_id, min(t_us) AS start_us, session FROM (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY t_us ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY clip_id ORDER BY t_us) > {24 * S} THEN 1 ELSE 0 END AS new FROM hit WHERE label = 'goal')) GROUP BY clip_id, session)
      SELECT h.clip_id, h.event_id AS point, h.t_us, coalesce(max_by(s.session, s.start_us) FILTER (s.start_us < h.t_us), max_by(s.session, s.start_us)) AS session FROM hit h LEFT JOIN sess s USING (clip_id) WHERE h.label = 'faceoff_cutscene' GROUP BY ALL""",
    "persist_probe": f"WITH {SEG} SELECT clip_id, seq, coalesce(lead(floor(value / 10)) OVER w BETWEEN floor(value / 10) AND floor(value / 10) + 1, true)::INT AS ok FROM seg WINDOW w AS (PARTITION BY clip_id ORDER BY seq)",
    "refine_first": f"WITH {HIT} SELECT g.clip_id, g.event_id, coalesce(min(h.t_us), g.t_us) AS refined_us FROM hit g LEFT JOIN hit h ON h.clip_id = g.clip_id AND h.t_us > g.t_us - {48 * S} AND h.t_us < g.t_us AND h.value >= g.value AND h.value <= g.value + 20 WHERE g.label = 'goal' GROUP BY g.clip_id, g.event_id, g.t_us",
    "confirm_count": f"WITH {HIT} SELECT clip_id, event_id, (count(*) FILTER (conf >= 0.3) OVER (PARTITION BY clip_id ORDER BY t_us RANGE BETWEEN {10 * S} PRECEDING AND {10 * S} FOLLOWING) >= 2)::INT AS confirmed FROM hit",
    "follower_join": f"WITH {SEG}, c AS (SELECT *, max(CASE WHEN label = 'goal' THEN seq END) OVER (PARTITION BY clip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM seg) SELECT clip_id, parent, count(*) AS n, max(seq) AS last_seq FROM c WHERE label = 'goal_replay' AND seq - parent <= 16 GROUP BY clip_id, parent",
    "orphan_parents": f"WITH {SEG} SELECT clip_id, seq, label FROM seg g WHERE label = 'goal' AND NOT EXISTS (SELECT 1 FROM seg c WHERE c.clip_id = g.clip_id AND c.label = 'goal_replay' AND c.seq BETWEEN g.seq + 1 AND g.seq + 3)",
    "unlabelled_anti": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "label_lookup": "SELECT event_type, CASE WHEN event_type IN ('purchase', 'click') THEN 'mapped' WHEN event_type = 'error' THEN 'discarded' ELSE 'unknown' END AS outcome, count(*) AS n FROM events GROUP BY ALL",
    "nearest_cell": f"WITH {HIT}, c AS (SELECT event_id, value, floor(t_us / 1000000)::BIGINT % 60 AS m FROM hit WHERE conf >= 0.2) SELECT event_id, (SELECT arg_min(i, (abs(value - x), i)) FROM (VALUES (0, 25.0), (1, 45.0), (2, 65.0), (3, 85.0)) t(i, x))::INT AS row_no, (SELECT arg_min(i, (abs(m - x), i)) FROM (VALUES (0, 10.0), (1, 30.0), (2, 50.0)) t(i, x))::INT AS col_no FROM c",
    # With one letter lost a word of four letters is near enough to its own, with one replaced one of seven, with one doubled any.
    "fuzzy_roster": """WITH p AS (SELECT p_partkey, p_name, string_split(p_name, ' ')[-1] AS w FROM part), r AS (SELECT *, (p_partkey % length(w))::INT AS k, substr(p_name, 1, length(p_name) - length(w)) AS head FROM p),
      x AS (SELECT p_partkey, p_name, w, head || substr(w, 1, k) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE substr(w, k + 1, 1) || substr(w, k + 1, 1) END || substr(w, k + 2) AS name FROM r)
      SELECT p_partkey, name, CASE WHEN length(w) >= CASE p_partkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 3 END THEN p_name ELSE name END AS corrected FROM x""",
}
QUERIES = {name: globals()[name] for name in ORACLES}

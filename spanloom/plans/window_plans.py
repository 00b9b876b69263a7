"""Queries of interval algebra, selection, aggregates and curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import assembly as asm
from ..operators import curation as cu
from ..operators import events as ev
from ..operators import intervals as iv
from ..operators import joins as jn
from ..operators import rules as ru
from ..operators import selection as sl
from ..operators.scans import last_before, scan
from .base import HIT, SEG, WIDTH, S, hits, segments, table, width

CLIP = ["clip_id"]
SCENE = ["clip_id", "session"]


def cap_pad_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    p = iv.padded(F.floor(F.col("dur_us") / 4), F.floor(F.col("dur_us") / 2), 7 * S, 5 * S, F.col("dur_us"))
    r = s.withColumn("p", p).withColumn("c", iv.capped(F.col("p.s"), F.col("p.e"), F.floor(F.col("dur_us") / 3), 16 * S))
    return r.select("clip_id", "seq", F.col("p.s").alias("pad_start_us"), F.col("p.e").alias("pad_end_us"), F.col("c.s").alias("cap_start_us"), F.col("c.e").alias("cap_end_us"))


def split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.split_long(segments(spark, sf_dir), "start_us", "dur_us", 10 * S).select("clip_id", "seq", "part", "part_start_us", "part_us")


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.sliding(segments(spark, sf_dir), "dur_us", 4 * S, 2 * S).select("clip_id", "seq", "w_start_us", "w_end_us")


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes are sessions of hits; every hit is a window of two to ten seconds from its scene's start."""
    h = ev.sessions(hits(spark, sf_dir), CLIP, "t_us", 24 * S).select(*SCENE, "t_us", (F.col("t_us") + width()).alias("e"), "label", "conf")
    h = h.join(h.groupBy(*SCENE).agg(F.min("t_us").alias("t0"), (F.max("e") - F.min("t_us")).alias("dur")), SCENE)
    return h.select(*SCENE, (F.col("t_us") - F.col("t0")).alias("s"), (F.col("e") - F.col("t0")).alias("e"), "label", "conf", "dur")


def peak_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clusters of each scene, padded and cut."""
    h = _scenes(spark, sf_dir)
    c = iv.scene_clusters(h, SCENE, "s", "e", "label", "conf", "s", 4 * S, 20 * S, keep=("dur",))
    t = iv.trim_of(F.col("start_us"), F.col("end_us"), F.col("peak_start_us"), F.col("peak_end_us"), F.col("dur"), 7 * S, 5 * S, 16 * S)
    i = F.row_number().over(Window.partitionBy(*SCENE).orderBy("start_us")) - 1
    return c.withColumn("t", t).withColumn("i", i.cast("long")).select(*SCENE, "i", "label", "conf", F.col("t.s").alias("trim_start_us"), F.col("t.e").alias("trim_end_us"))


def scene_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary window of each scene, number 0, and its extras."""
    t = iv.scene_trims(_scenes(spark, sf_dir), SCENE, "s", "e", "label", "conf", "dur", 4 * S, 20 * S, 7 * S, 5 * S, 16 * S, S)
    own = F.array(F.struct(F.col("trim_start_us").alias("s"), F.col("trim_end_us").alias("e"), F.col("conf").alias("c")))
    rows = t.select(*SCENE, "label", "window_start_us", "window_end_us", F.posexplode(F.concat(own, "extras")).alias("number", "w"))
    return rows.select(*SCENE, "label", "window_start_us", "window_end_us", F.col("number").cast("long").alias("number"), F.col("w.s").alias("start_us"), F.col("w.e").alias("end_us"), F.col("w.c").alias("conf"))


def banner_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = segments(spark, sf_dir).select("clip_id", "seq", ru.by_banner(F.col("label"), F.col("conf"), F.col("value") > 70, 0.5).alias("r"))
    return r.select("clip_id", "seq", "r.label", "r.conf", F.col("r.rescue").cast("int").alias("rescue"))


def gate_demote(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, conf = F.col("label"), F.col("conf")
    return hits(spark, sf_dir).select("event_id", ru.demoted_replay(label, conf, 0.4).alias("label"), ru.weak_replay(label, conf, 0.4).cast("int").alias("demoted"))


def select_reel(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).where("conf >= 0.2")
    return sl.select_capped(s, CLIP, "seq", (F.col("label") == "goal") & (F.col("conf") >= 0.5), F.col("label") == "goal_replay", "conf", 36, 4).select("clip_id", "seq", "label")


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with the flags and chains that groups are made from."""
    s, e = segments(spark, sf_dir), F.col("event_id")
    more = F.when((s["label"] == "faceoff_cutscene") & (e % 4 < 3), F.array(F.lit("hit_replay"), F.lit("celebration"), F.lit("save"))[(e % 4).cast("int")]).otherwise(F.col("label"))
    rows = s.withColumn("label", more)
    rows = scan(rows, CLIP, ["seq"], {"_goal": last_before(F.when(F.col("label") == "goal", F.col("seq"))), "_chance": last_before(F.when(F.col("label") == "scoring_chance", F.col("seq")))})
    follows = F.col("label").isin("goal_replay", "celebration", "hit_replay") & (e % 3 > 0)
    return rows.withColumns({
        "intro": F.col("seq") == 0, "game_end": e % 41 == 0, "regulation_end": F.floor(F.col("t_us") / (40 * S)) % 9 == 4, "banner": e % 4 == 1, "inferred": e % 8 == 2,
        "goal_seq": F.when(follows | ((F.col("label") == "goal") & (e % 6 == 0)), F.col("_goal")), "chance_seq": F.when(e % 5 == 0, F.col("_chance")), "n_leads": 1 + (e % 3 == 0).cast("int"),
    })


def reel_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of each clip's output, claims settled, capped, without menus in the regulation ends."""
    s = _chained(spark, sf_dir)
    groups = asm.claimed_groups(s, CLIP, "seq", 0.2, 0.1)
    return asm.reel_groups(groups, CLIP, 24, 4, s.where(F.col("event_id") % 7 == 0).select("clip_id", "seq"))


def reel_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).where("conf >= 0.3 and dur_us > 0")
    r = sl.output_timeline(s, CLIP, F.when(F.col("label") == "faceoff_cutscene", 0).when(F.col("label") == "other", 2).otherwise(1), "seq", "dur_us", 900 * S)
    return r.select("clip_id", "pos", "seq", "out_start_us", "out_end_us")


def hit_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: gated hits, throttled into events, placed on the timeline, listed as the stretches of the output."""
    seg = segments(spark, sf_dir)
    gated = seg.where(F.col("conf") >= F.when(F.col("label") == "scoring_chance", 0.5).otherwise(0.3)).select("clip_id", (F.col("start_us") + F.floor(F.col("dur_us") / 2)).alias("at_us"))
    kept = ev.throttle(gated, CLIP, "at_us", 3 * S)
    placed = jn.point_in_interval(kept, seg.select("clip_id", "seq", "label", "start_us", "end_us", "dur_us"), CLIP, "at_us", "start_us", "end_us", 60 * S)
    rows = placed.groupBy("clip_id", "seq", "label").agg(F.count("*").alias("n"), F.min("at_us").alias("first_us"), F.min("dur_us").alias("dur_us"))
    return sl.output_timeline(rows, CLIP, F.lit(0), "seq", "dur_us").select("clip_id", "pos", "seq", "label", "n", "first_us", "out_start_us", "out_end_us")


def ot_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = hits(spark, sf_dir).withColumn("period", F.floor(F.col("t_us") / (168 * S)) % 6)
    g = p.groupBy("clip_id", "period").agg(F.bool_or(F.col("label") == "faceoff_cutscene").alias("clock"), F.count_if((F.col("label") == "goal") & (F.col("conf") >= 0.5)).alias("goals"), F.count_if((F.col("label") == "scoring_chance") & (F.col("conf") >= 0.5)).alias("chances"))
    return g.select("clip_id", "period", "goals", "chances", (F.col("clock") | (F.col("goals") >= 1) | (F.col("chances") >= 2)).cast("int").alias("confirmed"))


def peak_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.first_peak(hits(spark, sf_dir).withColumn("v", F.floor(F.col("value") / 10)), ["clip_id", "label"], "t_us", "v")


def argmax_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's best class by a score map; the first of ties."""
    d = table(spark, sf_dir, "documents").where("n_chars > 0")
    scores = F.array(*[F.struct((F.col("n_chars") % m).alias("score"), F.lit(-i).alias("o"), F.lit(f"c{m}").alias("name")) for i, m in enumerate((7, 11, 13))])
    return d.select("doc_id", F.array_max(scores).alias("m")).select("doc_id", F.col("m.name").alias("name"), F.col("m.score").alias("score"))


def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir).withColumn("weight", F.when(F.col("conf") >= 0.5, 2).otherwise(1))
    return ag.weighted_vote(h, CLIP, "label", "weight", "t_us").select("clip_id", "label", "votes")


def lexi_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return ag.best_by(c, ["c_nationkey"], [F.floor(F.col("c_acctbal") / 1000), F.length("c_mktsegment")], "c_custkey", ["c_custkey", "c_name"]).select("c_nationkey", "c_custkey", "c_name")


def dedup_most_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linenumber", "l_orderkey")
    return ag.most_rows(li, ["l_suppkey", "l_returnflag"], "l_linenumber", "l_orderkey")


def median_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir).withColumn("run", F.floor(F.col("t_us") / (72 * S)))
    return ag.step_medians(h, CLIP, "run", "t_us", "t_us", "label", 7200 * S, 40)


def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame vector's best of five template vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", ag.unit(F.col("embedding").cast("array<double>")).alias("v"))
    t = F.broadcast(e.where("vec_id < 5").select(F.col("vec_id").alias("template"), F.col("v").alias("t")))  # five rows
    r = e.where("vec_id >= 5").join(t, F.size("v") == F.size("t")).select("vec_id", "template", F.round(ag.dot(F.col("v"), F.col("t")), 6).alias("corr"))
    return ag.best_by(r, ["vec_id"], [F.col("corr")], "template", ["template", "corr"])


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("quality") * 2 + F.col("toxic")).alias("class"))
    return ag.class_weights(rows, "class", spark.range(4).select(F.col("id").cast("int").alias("class")))


def confusion_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("quality", ((F.col("doc_id") * 7 + F.col("quality") * 3) % 5 > 1).cast("int").alias("guess"))
    return ag.f1_scores(rows, "quality", "guess")


def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.capped_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", 7)


def split_80_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.split_exact(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id")


def batch_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.batches(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id")


def collision_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("clip_"), (F.col("doc_id") % 300).cast("string")).alias("name"))
    return cu.collision_names(d, "name", "source", "doc_id").select("doc_id", "target")


def class_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cu.classes_with(table(spark, sf_dir, "documents"), "source", 5)


_WIN = f"""num AS (SELECT *, row_number() OVER (PARTITION BY clip_id, session ORDER BY t_us, event_id) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY t_us ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY clip_id ORDER BY t_us) > {24 * S} THEN 1 ELSE 0 END AS new FROM hit))),
  sc AS (SELECT clip_id, session, min(t_us) AS t0, max(t_us + {WIDTH}) - min(t_us) AS dur, arg_max(label, ((label <> 'other')::INT, conf, -n)) AS bl, arg_max(conf, ((label <> 'other')::INT, conf, -n)) AS bc FROM num GROUP BY ALL),
  pool AS (SELECT n.clip_id, n.session, n.t_us - s.t0 AS s, n.t_us - s.t0 + {WIDTH} AS e, n.conf, s.dur, s.bl, row_number() OVER (PARTITION BY n.clip_id, n.session ORDER BY n.t_us, {WIDTH}) AS k FROM num n JOIN sc s USING (clip_id, session) WHERE (n.label = s.bl OR n.label = 'scoring_chance') AND n.conf >= least(0.45, s.bc - 0.20)),
  walk AS (SELECT clip_id, session, dur, bl, k, 0 AS i, s, e, conf, s AS ps, e AS pe FROM pool WHERE k = 1
    UNION ALL SELECT clip_id, session, dur, bl, k + 1, CASE WHEN j THEN i ELSE i + 1 END, CASE WHEN j THEN s ELSE bs END, CASE WHEN j THEN greatest(e, be) ELSE be END, CASE WHEN j THEN greatest(conf, bconf) ELSE bconf END, CASE WHEN j AND NOT bconf > conf THEN ps ELSE bs END, CASE WHEN j AND NOT bconf > conf THEN pe ELSE be END
    FROM (SELECT w.*, b.s AS bs, b.e AS be, b.conf AS bconf, b.s - w.e <= {4 * S} AND greatest(w.e, b.e) - w.s <= {20 * S} AS j FROM walk w JOIN pool b ON b.clip_id = w.clip_id AND b.session = w.session AND b.k = w.k + 1)),
  cl AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY clip_id, session, i ORDER BY k DESC) = 1),
  pd AS (SELECT *, greatest(0, s - {7 * S}) AS a, least(dur, e + {5 * S}) AS b, (ps + pe) // 2 AS c FROM cl),
  tr AS (SELECT *, CASE WHEN b - a <= {16 * S} THEN a ELSE greatest(a, least(c - {8 * S}, b - {16 * S})) END AS ts, CASE WHEN b - a <= {16 * S} THEN b ELSE greatest(a, least(c - {8 * S}, b - {16 * S})) + {16 * S} END AS te FROM pd)"""
_KEY = "(doc_id * 2654435761 + 42) % 4294967296"

ORACLES = {
    "hit_timeline": f"""WITH RECURSIVE {SEG}, g AS (SELECT clip_id, start_us + dur_us // 2 AS at_us FROM seg WHERE conf >= CASE WHEN label = 'scoring_chance' THEN 0.5 ELSE 0.3 END), num AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY at_us) AS n FROM g),
      walk AS (SELECT clip_id, n, at_us, at_us AS kept, true AS keep FROM num WHERE n = 1 UNION ALL SELECT b.clip_id, b.n, b.at_us, CASE WHEN b.at_us - a.kept > {3 * S} THEN b.at_us ELSE a.kept END, b.at_us - a.kept > {3 * S} FROM walk a JOIN num b ON b.clip_id = a.clip_id AND b.n = a.n + 1),
      r AS (SELECT s.clip_id, s.seq, s.label, count(*) AS n, min(w.at_us) AS first_us, min(s.dur_us) AS dur_us FROM walk w JOIN seg s ON s.clip_id = w.clip_id AND w.at_us >= s.start_us AND w.at_us < s.end_us WHERE w.keep GROUP BY ALL)
      SELECT clip_id, row_number() OVER w AS pos, seq, label, n, first_us, (coalesce(sum(dur_us) OVER (PARTITION BY clip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS out_start_us, (sum(dur_us) OVER (PARTITION BY clip_id ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS out_end_us FROM r WINDOW w AS (PARTITION BY clip_id ORDER BY seq)""",
    "cap_pad_clamp": f"""WITH {SEG}, p AS (SELECT clip_id, seq, greatest(0, dur_us // 4 - {7 * S}) AS a, least(dur_us, dur_us // 2 + {5 * S}) AS b, dur_us // 3 AS c FROM seg), k AS (SELECT *, CASE WHEN b - a <= {16 * S} THEN a ELSE greatest(a, least(c - {8 * S}, b - {16 * S})) END AS s FROM p)
      SELECT clip_id, seq, a AS pad_start_us, b AS pad_end_us, s AS cap_start_us, CASE WHEN b - a <= {16 * S} THEN b ELSE s + {16 * S} END AS cap_end_us FROM k""",
    "split_long": f"WITH {SEG}, n AS (SELECT *, greatest(1, ceil(dur_us / {10 * S}))::BIGINT AS n FROM seg), x AS (SELECT *, unnest(range(0, n)) AS part FROM n) SELECT clip_id, seq, part, start_us + dur_us // n * part AS part_start_us, CASE WHEN part = n - 1 THEN dur_us - dur_us // n * (n - 1) ELSE dur_us // n END AS part_us FROM x",
    "sliding_windows": f"WITH {SEG}, x AS (SELECT *, unnest(range(0, CASE WHEN dur_us <= {4 * S} THEN 1 ELSE ceil((dur_us - {4 * S}) / {2 * S})::BIGINT + 1 END)) AS i FROM seg WHERE dur_us > 0) SELECT clip_id, seq, i * {2 * S} AS w_start_us, least(i * {2 * S} + {4 * S}, dur_us) AS w_end_us FROM x",
    "peak_windows": f"WITH RECURSIVE {HIT}, {_WIN} SELECT clip_id, session, i::BIGINT AS i, bl AS label, conf, ts AS trim_start_us, te AS trim_end_us FROM tr",
    "scene_trims": f"""WITH RECURSIVE {HIT}, {_WIN}, o AS (SELECT *, i = CASE WHEN bl = 'scoring_chance' THEN 0 ELSE arg_max(i, (conf, -i)) OVER (PARTITION BY clip_id, session) END AS p, max(conf) OVER (PARTITION BY clip_id, session) AS top FROM tr),
      x AS (SELECT * FROM o WHERE NOT p AND conf >= 0.60 QUALIFY row_number() OVER (PARTITION BY clip_id, session ORDER BY i) <= 2), u AS (SELECT * FROM x UNION ALL SELECT * FROM o WHERE p AND bl = 'scoring_chance'),
      m AS (SELECT *, sum(new) OVER (PARTITION BY clip_id, session ORDER BY ts, te, conf, p ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts > max(te) OVER (PARTITION BY clip_id, session ORDER BY ts, te, conf, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {S} THEN 1 ELSE 0 END AS new FROM u)),
      g AS (SELECT clip_id, session, g, min(ts) AS ts, max(te) AS te, max(conf) AS conf, bool_or(p) AS p FROM m GROUP BY ALL),
      e AS (SELECT clip_id, session, row_number() OVER (PARTITION BY clip_id, session ORDER BY ts) AS number, ts, te, conf FROM g WHERE NOT p),
      q AS (SELECT clip_id, session, bl, s, e, top FROM o WHERE p)
      SELECT q.clip_id, q.session, bl AS label, s AS window_start_us, q.e AS window_end_us, 0::BIGINT AS number, g.ts AS start_us, g.te AS end_us, top AS conf FROM q LEFT JOIN g ON g.clip_id = q.clip_id AND g.session = q.session AND g.p
      UNION ALL SELECT q.clip_id, q.session, bl, s, q.e, number, e.ts, e.te, e.conf FROM q JOIN e USING (clip_id, session)""",
    "banner_override": f"WITH {SEG} SELECT clip_id, seq, CASE WHEN value > 70 THEN 'goal' WHEN label = 'goal' THEN 'other' ELSE label END AS label, CASE WHEN value > 70 THEN 1.0 ELSE conf END AS conf, (NOT value > 70 AND label = 'goal' AND conf >= 0.5)::INT AS rescue FROM seg",
    "gate_demote": f"WITH {HIT} SELECT event_id, CASE WHEN label = 'goal_replay' AND conf < 0.4 THEN 'other_replay' ELSE label END AS label, (label = 'goal_replay' AND conf < 0.4)::INT AS demoted FROM hit",
    "select_reel": f"""WITH {SEG}, c AS (SELECT *, CASE WHEN label = 'goal' AND conf >= 0.5 THEN 0 WHEN label = 'goal_replay' THEN 2 ELSE 1 END AS k FROM seg WHERE conf >= 0.2),
      r AS (SELECT *, greatest(36 - count(*) FILTER (k = 0) OVER (PARTITION BY clip_id), 0) AS room, count(*) FILTER (k = 1) OVER (PARTITION BY clip_id) AS others, row_number() OVER (PARTITION BY clip_id, k ORDER BY seq) AS f, row_number() OVER (PARTITION BY clip_id, k ORDER BY conf DESC, seq) AS b FROM c)
      SELECT clip_id, seq, label FROM r WHERE k = 0 OR (k = 1 AND f <= room) OR (k = 2 AND b <= least(greatest(room - others, 0), 4))""",
    "reel_groups": f"""WITH RECURSIVE {SEG}, l AS (SELECT *, CASE WHEN label = 'faceoff_cutscene' AND event_id % 4 < 3 THEN (['hit_replay', 'celebration', 'save'])[event_id % 4 + 1] ELSE label END AS k FROM seg),
      b AS (SELECT *, max(CASE WHEN k = 'goal' THEN seq END) OVER w AS pg, max(CASE WHEN k = 'scoring_chance' THEN seq END) OVER w AS pc FROM l WINDOW w AS (PARTITION BY clip_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      r AS (SELECT clip_id, event_id, seq, k, conf, seq = 0 AS intro, event_id % 41 = 0 AS fin, (t_us // {40 * S}) % 9 = 4 AS reg, event_id % 4 = 1 OR event_id % 8 = 2 AS exempt, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS leads, event_id % 7 = 0 AS menu,
        CASE WHEN (k IN ('goal_replay', 'celebration', 'hit_replay') AND event_id % 3 > 0) OR (k = 'goal' AND event_id % 6 = 0) THEN pg END AS gs, CASE WHEN event_id % 5 = 0 THEN pc END AS cs,
        conf >= CASE WHEN k = 'scoring_chance' THEN 0.1 ELSE 0.2 END AND k <> 'other' AND k <> 'faceoff_cutscene' AS ok FROM b),
      walk AS (SELECT clip_id, -1::BIGINT AS seq, []::BIGINT[] AS goals, []::BIGINT[] AS chances, NULL::BIGINT AS run, false AS cg, false AS cc, false AS own FROM (SELECT DISTINCT clip_id FROM r)
        UNION ALL SELECT clip_id, seq, CASE WHEN own AND NOT reg AND k = 'goal' THEN list_append(goals, seq) ELSE goals END, CASE WHEN own AND NOT reg AND k = 'scoring_chance' THEN list_append(chances, seq) ELSE chances END, CASE WHEN free AND reg THEN coalesce(run, seq) END, cg, cc, own
        FROM (SELECT *, free AND (reg OR (ok AND k NOT IN ('celebration', 'goal_replay'))) AS own FROM (SELECT *, NOT (intro OR fin OR cg OR cc) AS free FROM (SELECT r.*, w.goals, w.chances, w.run, coalesce(list_contains(w.goals, r.gs) AND r.seq - r.gs <= 16, false) AS cg, coalesce(list_contains(w.chances, r.cs) AND r.seq - r.cs <= 9, false) AS cc FROM walk w JOIN r ON r.clip_id = w.clip_id AND r.seq = w.seq + 1)))),
      m AS (SELECT r.*, w.run, w.cg, w.cc, w.own FROM walk w JOIN r USING (clip_id, seq)),
      led AS (SELECT clip_id, seq AS lead, unnest(range(0, CASE WHEN k = 'scoring_chance' THEN leads ELSE 1 END)) AS no, CASE WHEN exempt THEN 0 WHEN k = 'hit_replay' THEN 2 ELSE 1 END AS c, conf FROM m WHERE own AND NOT reg),
      rk AS (SELECT *, greatest(24 - count(*) FILTER (c = 0) OVER (PARTITION BY clip_id), 0) AS room, count(*) FILTER (c = 1) OVER (PARTITION BY clip_id) AS others, row_number() OVER (PARTITION BY clip_id, c ORDER BY lead, no) AS f, row_number() OVER (PARTITION BY clip_id, c ORDER BY conf DESC, lead, no) AS h FROM led),
      kept AS (SELECT clip_id, lead, no FROM rk WHERE c = 0 OR (c = 1 AND f <= room) OR (c = 2 AND h <= least(greatest(room - others, 0), 4))),
      e AS (SELECT kept.clip_id, lead, no, lead AS seq, CASE k WHEN 'goal' THEN 'goal' WHEN 'scoring_chance' THEN 'chance' WHEN 'hit_replay' THEN 'hit' ELSE 'single' END AS kind FROM kept JOIN m ON m.clip_id = kept.clip_id AND m.seq = kept.lead
        UNION ALL SELECT f.clip_id, f.gs, 0, f.seq, 'goal' FROM m f JOIN kept ON kept.clip_id = f.clip_id AND kept.lead = f.gs AND f.cg
        UNION ALL SELECT f.clip_id, f.cs, l.leads - 1, f.seq, 'chance' FROM m f JOIN m l ON l.clip_id = f.clip_id AND l.seq = f.cs AND f.cc JOIN kept ON kept.clip_id = f.clip_id AND kept.lead = f.cs AND kept.no = l.leads - 1),
      a AS (SELECT *, 1 AS section FROM e UNION ALL SELECT clip_id, run, 0, seq, 'regulation', 1 FROM m WHERE run IS NOT NULL AND NOT menu UNION ALL SELECT clip_id, NULL, 0, seq, 'intro', 0 FROM m WHERE intro UNION ALL SELECT clip_id, NULL, 0, seq, 'game_end', 2 FROM m WHERE fin)
      SELECT clip_id, dense_rank() OVER (PARTITION BY clip_id ORDER BY section, lead, no) AS pos, row_number() OVER (PARTITION BY clip_id, section, lead, no ORDER BY seq) AS place, seq, no::BIGINT AS lead_no, kind FROM a""",
    "reel_timeline": f"""WITH {SEG}, r AS (SELECT clip_id, seq, dur_us, row_number() OVER w AS pos, coalesce(sum(dur_us) OVER (PARTITION BY clip_id ORDER BY k, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM (SELECT *, CASE label WHEN 'faceoff_cutscene' THEN 0 WHEN 'other' THEN 2 ELSE 1 END AS k FROM seg WHERE conf >= 0.3 AND dur_us > 0) WINDOW w AS (PARTITION BY clip_id ORDER BY k, seq))
      SELECT clip_id, pos, seq, a AS out_start_us, least(a + dur_us, {900 * S}) AS out_end_us FROM r WHERE a < {900 * S}""",
    "ot_evidence": f"WITH {HIT}, g AS (SELECT clip_id, (t_us // {168 * S}) % 6 AS period, bool_or(label = 'faceoff_cutscene') AS c, count(*) FILTER (label = 'goal' AND conf >= 0.5) AS goals, count(*) FILTER (label = 'scoring_chance' AND conf >= 0.5) AS chances FROM hit GROUP BY ALL) SELECT clip_id, period, goals, chances, (c OR goals >= 1 OR chances >= 2)::INT AS confirmed FROM g",
    "peak_per_key": f"WITH {HIT} SELECT clip_id, label, max(floor(value / 10))::BIGINT AS v, arg_max(t_us, (floor(value / 10), -t_us)) AS t_us FROM hit GROUP BY ALL",
    "argmax_class": "SELECT doc_id, CASE WHEN n_chars % 7 >= n_chars % 11 AND n_chars % 7 >= n_chars % 13 THEN 'c7' WHEN n_chars % 11 >= n_chars % 13 THEN 'c11' ELSE 'c13' END AS name, greatest(n_chars % 7, n_chars % 11, n_chars % 13) AS score FROM documents WHERE n_chars > 0",
    "weighted_vote": f"WITH {HIT}, v AS (SELECT clip_id, label, sum(CASE WHEN conf >= 0.5 THEN 2 ELSE 1 END)::BIGINT AS votes, min(t_us) AS seen FROM hit GROUP BY ALL) SELECT clip_id, label, votes FROM v QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY votes DESC, seen) = 1",
    "lexi_best": "SELECT c_nationkey, c_custkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000) DESC, length(c_mktsegment) DESC, c_custkey) = 1",
    "dedup_most_rows": """WITH v AS (SELECT l_suppkey, l_returnflag, l_linenumber, count(*) AS "rows", min(l_orderkey) AS first_seen FROM lineitem GROUP BY ALL)
      SELECT l_suppkey, l_returnflag, l_linenumber, "rows", min(first_seen) OVER (PARTITION BY l_suppkey, l_returnflag) AS first_seen FROM v QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY "rows" DESC, v.first_seen) = 1""",
    "median_durations": f"""WITH {HIT}, h AS (SELECT *, t_us // {72 * S} AS run FROM hit), l AS (SELECT clip_id, run FROM (SELECT clip_id, run, max(t_us) AS e FROM h GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY e DESC, run) <= 40),
      d AS (SELECT label, lead(t_us) OVER (PARTITION BY clip_id, run ORDER BY t_us) - t_us AS d FROM h JOIN l USING (clip_id, run)) SELECT label, median(d) AS median, count(*) AS n FROM d WHERE d >= 0 AND d < {7200 * S} GROUP BY label""",
    "class_weights": "WITH r AS (SELECT quality * 2 + toxic AS class FROM labels), k AS (SELECT unnest(range(0, 4))::INT AS class) SELECT k.class, count(r.class) AS n, CASE WHEN count(r.class) > 0 THEN (SELECT count(*) FROM r)::DOUBLE / (4 * count(r.class)) ELSE 0 END AS weight FROM k LEFT JOIN r USING (class) GROUP BY k.class",
    "confusion_f1": """WITH r AS (SELECT quality AS q, ((doc_id * 7 + quality * 3) % 5 > 1)::INT AS g FROM labels), c AS (SELECT x AS label, count(*) FILTER (q = x) AS support, count(*) FILTER (q = x AND g = x) AS hit, count(*) FILTER (g = x) AS guessed FROM r, (VALUES (0), (1)) t(x) GROUP BY x),
      p AS (SELECT label, support, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM c) SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM p""",
    "capped_sample": f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_KEY}, doc_id) <= 7",
    "split_80_20": f"SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {_KEY}, doc_id) <= floor(count(*) OVER (PARTITION BY lang) * 0.8) THEN 'train' ELSE 'validate' END AS part FROM documents",
    "batch_of_three": f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_KEY}, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source, i // 3 AS batch, i % 3 AS place FROM r WHERE least(n - i // 3 * 3, 3) > 1",
    "collision_rename": "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY doc_id % 300 ORDER BY doc_id) = 1 THEN '' ELSE source || '_' END || 'clip_' || (doc_id % 300) AS target FROM documents",
    "class_list": "SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 5",
    "template_match": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_avg(embedding::DOUBLE[]) AS m FROM embeddings), c AS (SELECT vec_id, list_transform(v, lambda x: x - m) AS v FROM e),
      r AS (SELECT a.vec_id, b.vec_id AS template, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS corr FROM c a, c b WHERE a.vec_id >= 5 AND b.vec_id < 5)
      SELECT vec_id, template, corr FROM r QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY corr DESC, template) = 1""",
}
QUERIES = {name: globals()[name] for name in ORACLES}

"""Groups of the output: which segments lead, which are claimed by one before them, and which groups fit.

A goal claims what is chained to it in the next ``GOAL_REACH`` rows, a chance in the next
``CHANCE_REACH``, a row that ends regulation the rows after it that do so too. What is
claimed can't lead, and what it would have claimed stays free: so it is an ordered fold.
Claims reach only a few rows ahead. A clip is cut wherever no claim and no run passes,
and the pieces are folded on their own, so a long clip is many small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import Step, ordered_fold
from .scans import PART, max_before, running_sum, scan
from .selection import select_capped

# Rows that a goal and a chance look ahead.
GOAL_REACH, CHANCE_REACH = 16, 9
# What may be shown, and of these what is shown only with what it follows.
SHOWN = ("goal", "save", "hit", "fight", "celebration", "goal_replay", "other_replay", "hit_replay", "scoring_chance")
FOLLOWING = ("celebration", "goal_replay", "other_replay")

#: Columns that a claim needs besides the order, in this order.
_NEEDS = ("label", "passes", "structural", "regulation_end", "goal_seq", "chance_seq", "n_leads", "exempt", "conf")
_GROUPS = "lead_seq long, lead_no long, seq long, kind string, exempt boolean, conf double"


class _Claims(Step):
    def __init__(self):
        self.goals: list[int] = []
        self.chances: dict[int, int] = {}
        self.run: tuple[int, int] | None = None  # its first row and its last

    def row(self, row):
        seq, label, passes, structural, regulation_end, goal_seq, chance_seq, n_leads, exempt, conf = row
        self.goals = [g for g in self.goals if seq - g <= GOAL_REACH]
        self.chances = {c: n for c, n in self.chances.items() if seq - c <= CHANCE_REACH}
        used = structural
        if goal_seq in self.goals:
            used = True
            yield goal_seq, 0, seq, "goal", False, None
        if chance_seq in self.chances:
            used = True
            yield chance_seq, self.chances[chance_seq] - 1, seq, "chance", False, None
        if used:
            return
        if regulation_end:
            first = self.run[0] if self.run and self.run[1] == seq - 1 else seq
            self.run = first, seq
            yield first, 0, seq, "regulation", False, None
        elif not passes or label in FOLLOWING:
            return
        elif label == "goal":
            self.goals.append(seq)
            yield seq, 0, seq, "goal", exempt, conf
        elif label == "scoring_chance":
            self.chances[seq] = n_leads
            for k in range(n_leads):
                yield seq, k, seq, "chance", exempt, conf
        else:
            yield seq, 0, seq, "hit" if label == "hit_replay" else "single", exempt, conf


def passes(label: Column, conf: Column, least: float, least_chance: float) -> Column:
    """Whether a segment may be shown: a label that is, and its least confidence."""
    return F.coalesce(label.isin(*SHOWN) & (conf >= F.when(label == "scoring_chance", least_chance).otherwise(least)), F.lit(False))


def _pieces(df: DataFrame, by: list[str], seq: str) -> DataFrame:
    """Adds _piece: a new one where no row from here on is chained to one before, and no run of regulation ends goes on."""
    chained = df.select(*by, F.col(seq).alias("_s"), F.explode(F.array(F.when(F.col(seq) - F.col("goal_seq") <= GOAL_REACH, F.col("goal_seq")), F.when(F.col(seq) - F.col("chance_seq") <= CHANCE_REACH, F.col("chance_seq")))).alias("_lead"))
    reach = chained.where("_lead < _s").groupBy(*by, F.col("_lead").alias(seq)).agg(F.max("_s").alias("_reach"))
    rows = df.join(reach, [*by, seq], "left").withColumn("_reach", F.greatest("_reach", F.when(F.col("regulation_end"), F.col(seq) + 1)))
    rows = scan(rows, by, [seq], {"_far": max_before("_reach")}).withColumn("_new", F.when(F.col(seq) <= F.col("_far"), 0).otherwise(1))
    return scan(rows, by, [seq], {"_piece": running_sum("_new")}).drop("_reach", "_far", "_new")


def claimed_groups(df: DataFrame, by: list[str], seq: str, least: float = 0.55, least_chance: float = 0.45) -> DataFrame:
    """Members of all groups: section (0 intro, 1 middle, 2 end), lead_seq and lead_no (null and 0 outside the middle), seq, kind, exempt and conf of leads.

    Columns of ``df``: label, conf, intro, game_end, regulation_end, goal_seq and
    chance_seq (places of what a row is chained to, or null), n_leads (windows that a
    chance is shown in; what is chained follows the last), banner and inferred (goals
    that no cap counts). ``seq`` numbers each group's rows. Intros and ends are taken
    first, whatever their label; a run of regulation ends is one group at its place.
    """
    structural = F.coalesce("intro", F.lit(False)) | F.coalesce("game_end", F.lit(False))
    rows = _pieces(df, by, seq).withColumns(
        {
            "passes": passes(F.col("label"), F.col("conf"), least, least_chance), "structural": structural, "regulation_end": F.coalesce("regulation_end", F.lit(False)),
            "exempt": F.coalesce("banner", F.lit(False)) | F.coalesce("inferred", F.lit(False)), "n_leads": F.coalesce(F.col("n_leads").cast("long"), F.lit(1).cast("long")),
        }
    )
    part = rows.select(*by, "_piece", F.col(seq).alias("seq"), *_NEEDS)
    middle = ordered_fold(part, [*by, "_piece"], ["seq"], _Claims, _GROUPS).drop("_piece").withColumn("section", F.lit(1))
    empty = {"lead_seq": F.lit(None).cast("long"), "lead_no": F.lit(0).cast("long"), "exempt": F.lit(False), "conf": F.lit(None).cast("double")}
    ends = [df.where(flag).select(*by, F.col(seq).alias("seq")).withColumns(empty | {"kind": F.lit(flag), "section": F.lit(k)}) for flag, k in (("intro", 0), ("game_end", 2))]
    return middle.unionByName(ends[0]).unionByName(ends[1])


def reel_groups(groups: DataFrame, by: list[str], cap: int, most_hits: int, menus: DataFrame | None = None) -> DataFrame:
    """The groups that fit, in order: pos, place (both from 1), seq, lead_no and kind.

    Intros, ends and regulation ends are outside the cap, exempt groups are in and
    counted, others come first come first served, hits take what room is left, the most
    confident first. ``menus`` (by, seq) are rows that show a menu: they are stripped
    from regulation ends, and a group with nothing left is none.
    """
    leads = groups.where("section = 1 and kind <> 'regulation' and seq = lead_seq and conf is not null").select(*by, "lead_seq", "lead_no", "kind", "exempt", "conf").withColumn("_at", F.struct("lead_seq", "lead_no"))
    kept = select_capped(leads, by, "_at", F.col("exempt"), F.col("kind") == "hit", "conf", cap, most_hits).select(*by, "lead_seq", "lead_no")
    inside = groups.where("section = 1 and kind <> 'regulation'").join(kept, [*by, "lead_seq", "lead_no"])
    fixed = groups.where("section <> 1 or kind = 'regulation'")
    if menus is not None:
        seen = fixed.join(menus.select(*by, "seq").distinct().withColumn("_menu", F.lit(True)), [*by, "seq"], "left")
        fixed = seen.where("kind <> 'regulation' or _menu is null").drop("_menu")
    rows = inside.select(*by, "section", "lead_seq", "lead_no", "seq", "kind").unionByName(fixed.select(*by, "section", "lead_seq", "lead_no", "seq", "kind"))
    order = Window.partitionBy(*by).orderBy("section", "lead_seq", "lead_no")
    own = Window.partitionBy(*by, "section", "lead_seq", "lead_no").orderBy("seq")
    rows = rows.withColumn("pos", F.dense_rank().over(order).cast("long")).withColumn("place", F.row_number().over(own).cast("long"))
    return rows.select(*by, "pos", "place", "seq", "lead_no", "kind")

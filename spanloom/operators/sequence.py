"""Order-dependent passes over a clip's segments: context, chains, inferred and rescued goals, periods, counters.

What depends on rows alone is written with windows; what a decision changes for
later rows is an ordered fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import Step, Trial, chunked_fold, ordered_fold
from .scans import lag, last_before, lead, next_after, running_sum, scan, split, whole_max, whole_min

NORMAL, INTERMISSION, REPLAY_TAIL = "normal", "intermission", "replay_tail"
FACEOFFS = ("faceoff", "faceoff_cutscene")


def prior_context(df: DataFrame, by: list[str], seq: str, start: Column, period_end: Column, faceoff: Column, goal: Column) -> DataFrame:
    """Adds context: the class of the nearest earlier boundary; in one row a start goes before a period's end, that before a face-off, that before a goal."""
    kind = F.when(start, NORMAL).when(period_end, INTERMISSION).when(faceoff, NORMAL).when(goal, REPLAY_TAIL)
    rows = scan(df.withColumn("_kind", kind), by, [seq], {"_before": last_before("_kind")})
    return rows.withColumn("context", F.coalesce("_before", F.lit(NORMAL))).drop("_kind", "_before")


class _Chain(Step):
    """Followers of one goal: rows come from the goal on, up to the next one."""

    def __init__(self, rows: int, gap: int, skip: int):
        self.rows, self.most, self.skip, self.n, self.base = rows, gap, skip, -1, None
        self.gap, self.started, self.stopped, self.order = 0, False, False, 0

    def row(self, row):
        seq, label, dur = row
        self.n += 1
        if self.n == 0:
            self.base = seq
            return
        if self.stopped or self.n > self.rows or label == "faceoff_cutscene":
            self.stopped = True
            return
        if label in ("celebration", "goal_replay") or label in ("other_replay", "hit_replay") and (self.started or self.gap == 0):
            self.started, self.gap, self.order = True, 0, self.order + 1
            yield seq, self.base, self.order, "follow"
        elif dur <= self.skip:
            return
        elif not self.started and self.gap + dur <= self.most:
            self.gap += dur
            self.order += 1
            yield seq, self.base, self.order, "bridge"
        else:
            self.gap += dur
            self.stopped = self.gap > self.most


def goal_chains(df: DataFrame, by: list[str], seq: str, goal: Column, rows: int, gap: int, skip: int) -> DataFrame:
    """Each follower with its goal's seq, its order and whether it follows or bridges. Chains never cross a goal, so each is folded on its own."""
    numbered = scan(df.withColumn("_goal", F.when(goal, 1).otherwise(0)), by, [seq], {"goal_no": running_sum("_goal")})
    part = numbered.where("goal_no > 0").select(*by, "goal_no", F.col(seq).alias("seq"), "label", "dur_us")
    return ordered_fold(part, [*by, "goal_no"], ["seq"], lambda: _Chain(rows, gap, skip), "seq long, goal_seq long, chain_order long, kind string")


#: What each place in a chain takes off the goal's score, and the least confidence of what is chained.
CHAIN_STEP, CHAIN_CONFIDENCE = 0.01, 0.9


def chain_scores(chains: DataFrame, rows: DataFrame, by: list[str], seq: str, score: str, conf: str) -> DataFrame:
    """Score and confidence of chained rows (see :func:`goal_chains`): score falls with the place behind the goal's score, or its confidence where that is null."""
    goal = rows.select(*by, F.col(seq).alias("goal_seq"), F.coalesce(score, conf, F.lit(1.0)).alias("_base"))
    own = rows.select(*by, F.col(seq).alias("seq"), F.col(conf).alias("_conf"))
    both = chains.join(goal, [*by, "goal_seq"]).join(own, [*by, "seq"])
    return both.withColumn("score", F.col("_base") - F.col("chain_order") * CHAIN_STEP).withColumn("conf", F.greatest(F.coalesce("_conf", F.lit(0.0)), F.lit(CHAIN_CONFIDENCE))).drop("_base", "_conf")


class _Infer(Step):
    def __init__(self, state: str | None):
        self.state = state or NORMAL

    def row(self, row):
        seq, label, banner, starts, period_end, candidate, forward = row
        promoted = bool(candidate and forward and self.state == NORMAL)
        if starts:
            self.state = NORMAL
        elif period_end:
            self.state = INTERMISSION
        elif label in FACEOFFS:
            self.state = NORMAL
        elif banner or promoted:
            self.state = REPLAY_TAIL
        return ((seq,),) if promoted else ()


def inferred_goals(df: DataFrame, by: list[str], seq: str, steps: int, least: float) -> DataFrame:
    """Promoted rows: candidates in normal play with a confident face-off within ``steps`` virtual steps and no goal before it.

    Columns: label, ml_label, conf, banner, starts, period_end. The look ahead
    needs only rows as they are; the context behind a row depends on promotions, so it
    is a fold of three states. ``seq`` numbers each group's rows from 0.
    """
    replay = F.col("label").isin("goal_replay", "other_replay", "hit_replay")
    rows = scan(df.withColumn("_r", replay), by, [seq], {"_before": lag("_r"), "_after": lead("_r")})
    rows = rows.withColumn("_c", F.when(F.col("_r") & F.coalesce("_before", F.lit(False)), 0).otherwise(1))
    rows = scan(rows, by, [seq], {"_step": running_sum("_c")})
    stop = F.when(F.col("banner") | (F.col("label") == "goal"), F.lit(0)).when(F.col("label").isin(*FACEOFFS) & (F.col("conf") >= 0.6), F.lit(1))
    rows = rows.withColumn("_stop", F.when(stop.isNotNull(), F.struct(stop.alias("k"), F.col("_step").alias("s"))))
    rows = scan(rows, by, [seq], {"_found": next_after("_stop")})
    # A replay run that goes on from the row itself is entered at its next step.
    start = F.col("_step") - F.when(F.col("_r") & F.coalesce("_after", F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("forward", F.coalesce((F.col("_found.k") == 1) & (F.col("_found.s") - start <= steps), F.lit(False)))
    candidate = ~F.col("banner") & ~F.col("starts") & ~F.col("period_end") & F.col("label").isin("scoring_chance", "other") & ((F.col("ml_label") == "goal") | ((F.col("ml_label") == "scoring_chance") & (F.col("conf") >= least)))
    part = rows.withColumn("candidate", candidate).select(*by, F.col(seq).alias("seq"), "label", "banner", "starts", "period_end", "candidate", "forward", *split(df))
    return chunked_fold(part, by, "seq", _Infer, lambda: Trial([NORMAL, INTERMISSION, REPLAY_TAIL], _Infer), "string", "seq long")


def adjacent_chances(df: DataFrame, by: list[str], seq: str, chance: Column, barrier: Column, edge: int, between: int, trim_start: str, trim_end: str) -> DataFrame:
    """Pairs of consecutive chances whose trims reach their segments' edges, with at most ``between`` of time and no barrier between them: seq and next_seq."""
    rows = df.withColumn("_chance", chance)
    rows = scan(rows, by, [seq], {"_wall": running_sum(F.when(barrier, 1).otherwise(0)), "_filler": running_sum(F.when(F.col("_chance"), 0).otherwise(F.col("dur_us")))})
    only = scan(rows.where("_chance"), by, [seq], {"_next": lead(seq), "_next_start": lead(trim_start), "_next_wall": lead("_wall"), "_next_filler": lead("_filler")})
    good = (F.col("dur_us") - F.col(trim_end) <= edge) & (F.col("_next_start") <= edge) & (F.col("_next_filler") - F.col("_filler") <= between) & (F.col("_next_wall") == F.col("_wall"))
    return only.where(good).select(*by, F.col(seq).alias("seq"), F.col("_next").alias("next_seq"))


class _Periods(Step):
    def __init__(self, state: int | None):
        self.state = state or 1

    def row(self, row):
        seq, period_start, game_start, period_end, regulation_end, declared = row
        p = self.state
        if period_start or game_start:
            if declared is not None:
                p = max(p, min(declared, 3))
            elif period_start and p < 3:
                p += 1
        self.state = min(p + 1, 3) if period_end else 4 if regulation_end else p
        return ((seq, p),)


def period_numbers(df: DataFrame, by: list[str], seq: str) -> DataFrame:
    """The period of every segment, from flags period_start, game_start, period_end, regulation_end and a declared number (or null). ``seq`` numbers each group's rows from 0."""
    part = df.select(*by, F.col(seq).alias("seq"), "period_start", "game_start", "period_end", "regulation_end", "declared", *split(df))
    return chunked_fold(part, by, "seq", _Periods, lambda: Trial([1, 2, 3, 4], _Periods), "long", "seq long, period long")


class _Counter(Step):
    """A counter that only grows by small steps, from its first value on; at the end a row of where its value was last shown."""

    def __init__(self, state: int | None):
        self.state, self.last = state, None

    def row(self, row):
        seq, v, confirmed, first_seq, first, most = row
        if seq == first_seq:
            self.state, self.last = first, seq
            return ((seq, v, None, None, False),)
        step = v - self.state
        if step == 0:
            self.last = seq
        elif confirmed and 1 <= step <= most:
            lo, self.state, self.last = self.last, v, seq
            return ((seq, v, step, lo, False),)
        return ()

    def end(self):
        return () if self.last is None else ((self.last, self.state, None, None, True),)


class _CounterTrial(Step):
    """What a chunk makes of every value that the counter may have before it: a reading moves on whoever stands just below it, and from then on those go together."""

    def __init__(self):
        self.at, self.moved = None, set()

    def row(self, row):
        seq, v, confirmed, first_seq, first, most = row
        if self.at is None:
            self.at = {first: [None]}
        if confirmed and seq != first_seq:
            for below in range(v - most, v):
                came = self.at.pop(below, [])
                if below not in self.moved:
                    self.moved.add(below)
                    came.append(below)
                here = self.at.get(v, [])
                small, large = sorted((came, here), key=len)
                large.extend(small)
                self.at[v] = large
        return ()

    def end(self):
        pairs = [(start, value) for value, starts in (self.at or {}).items() for start in starts]
        return ((([p[0] for p in pairs]), [p[1] for p in pairs]),)


def counter_events(df: DataFrame, by: list[str], seq: str, value: str, most: int) -> DataFrame:
    """Accepted increments: a reading 1 to ``most`` above the last accepted, unless the next one read is not within one above it.

    Unread (null) rows confirm and count for nothing else. The first value needs two
    equal readings in a row, whoever stands before them.
    """
    rows = scan(df, by, [seq], {"_later": lead(value)})
    probe = F.coalesce((F.col("_later") >= F.col(value)) & (F.col("_later") <= F.col(value) + 1), F.lit(True))
    return counter_rows(rows, by, seq, value, probe, most).where("step is not null").drop("lo")


def counter_rows(df: DataFrame, by: list[str], seq: str, value: str, confirmed: Column, most: int | Column) -> DataFrame:
    """seq, v, step and lo of what a counter is believed to show: its first value (step is null), then confirmed increments; lo is where the value before was last read.

    Of equal readings in a row only the first and last, and the first confirmed after one
    that isn't, can change anything; the fold gets no others.
    """
    most = F.lit(most) if isinstance(most, int) else most
    part = df.withColumn("confirmed", confirmed).withColumn("most", most.cast("long")).select(*by, F.col(seq).alias("seq"), F.col(value).cast("long").alias("v"), "confirmed", "most", *split(df)).where("v is not null")
    part = scan(part, by, ["seq"], {"_before": lag("v")}).withColumn("_again", F.when(F.col("v") == F.col("_before"), F.struct("seq", "v")))
    part = scan(part, by, ["seq"], {"_first": whole_min("_again")}).where("seq >= _first.seq")
    part = part.select(*by, "seq", "v", "confirmed", F.col("_first.seq").alias("first_seq"), F.col("_first.v").alias("first"), "most", *split(df))
    part = scan(part, by, ["seq"], {"_b": lag(F.struct("v", "confirmed")), "_a": lead("v")})
    inside = F.col("_b.v").eqNullSafe(F.col("v")) & F.col("_a").eqNullSafe(F.col("v")) & (~F.col("confirmed") | F.col("_b.confirmed"))
    part = part.where(~inside).drop("_b", "_a")
    found = chunked_fold(part, by, "seq", _Counter, _CounterTrial, "long", "seq long, v long, step long, lo long, shown boolean")
    if split(df):  # a value last read in a range before
        found = scan(found, by, ["seq", "shown"], {"_lo": last_before(F.when(F.col("shown"), F.col("seq")))})
        found = found.withColumn("lo", F.when(F.col("step").isNotNull(), F.coalesce("lo", "_lo"))).drop("_lo")
    return found.where("not shown").drop("shown")


def groups_of(df: DataFrame, by: list[str], seq: str, flag: Column, name: str = "run") -> DataFrame:
    """Runs of consecutive flagged rows, numbered from 1; other rows are left out."""
    rows = scan(df.withColumn("_f", F.coalesce(flag, F.lit(False))), by, [seq], {"_b": lag("_f")})
    rows = rows.withColumn("_n", F.when(F.col("_f") & ~F.coalesce("_b", F.lit(False)), 1).otherwise(0))
    return scan(rows, by, [seq], {name: running_sum("_n")}).where("_f").drop("_f", "_b", "_n")


def empty_sentinel(df: DataFrame, by: list[str], seq: str, empty: Column, stop: int) -> DataFrame:
    """Rows before the ``stop``-th empty one in a row, without the empty rows at the end."""
    # The number of empty rows since the last other one: their count less their count there.
    rows = scan(df.withColumn("_e", empty), by, [seq], {"_all": running_sum(F.when(F.col("_e"), 1).otherwise(0))})
    rows = scan(rows.withColumn("_at", F.when(~F.col("_e"), F.col("_all"))), by, [seq], {"_base": last_before("_at")})
    rows = rows.withColumn("_k", F.when(F.col("_e"), F.col("_all") - F.coalesce("_base", F.lit(0))))
    rows = scan(rows, by, [seq], {"_stop": whole_min(F.when(F.col("_k") >= stop, F.col(seq)))}).where(F.col("_stop").isNull() | (F.col(seq) < F.col("_stop")))
    rows = scan(rows, by, [seq], {"_last": whole_max(F.when(~F.col("_e"), F.col(seq)))})
    return rows.where(F.col(seq) <= F.col("_last")).drop("_e", "_all", "_at", "_base", "_k", "_stop", "_last")


def unrolled(df: DataFrame, by: list[str], order: str, clock: str, day: int = 86_400, back: int = 3_600) -> DataFrame:
    """Adds elapsed: a clock of day seconds made monotone, a day more after each step back of over an hour."""
    rows = scan(df, by, [order], {"_before": lag(clock)}).withColumn("_roll", F.when(F.col("_before") - F.col(clock) > back, day).otherwise(0))
    rows = scan(rows, by, [order], {"_days": running_sum("_roll")})
    return rows.withColumn("elapsed", (F.col(clock) + F.col("_days")).cast("long")).drop("_before", "_roll", "_days")

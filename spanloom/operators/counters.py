"""Counters of two sides read off a screen: a scan of whole clips, and readings segment by segment.

Readings are wide rows: ``at`` (a frame's number) and a column for each counter, null
where it couldn't be read. Real counters never fall, so a reading is only believed where
it is a small step up and still holds a moment later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .folds import Step, chunked_fold
from .joins import first_within
from .scans import PART, lag, last_before, lead, scan, split
from .sequence import counter_rows

SIDES = ("home", "away")


def _held(later: Column, value: Column) -> Column:
    """A later reading confirms a value or one more; what couldn't be read does too."""
    return F.coalesce((later >= value) & (later <= value + 1), F.lit(True))


def _long(rows: DataFrame, by: list[str], kinds: Iterable[str], extra: Callable[[str], dict[str, Column]]) -> DataFrame:
    """by, at, kind, side and value of what was read, and what ``extra`` has for a column; columns are named kind_side."""
    series = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("side"), F.col(n := f"{k}_{s}").alias("value"), *[c.alias(x) for x, c in extra(n).items()]) for k in kinds for s in SIDES])
    return rows.select(*by, "at", F.explode(series).alias("x"), *split(rows)).select(*by, "at", "x.*", *split(rows)).where("value is not null")


def _wide(reads: DataFrame, by: list[str], at: str, kinds: Iterable[str]) -> DataFrame:
    return reads.select(*by, F.col(at).cast("long").alias("at"), *[F.col(f"{k}_{s}").cast("long").alias(f"{k}_{s}") for k in kinds for s in SIDES], *split(reads))


def _sampled(reads: DataFrame, by: list[str], at: str, kinds: Iterable[str], every: int, gap: int) -> DataFrame:
    """Every ``every``-th frame, long, with whether each reading holds ``gap`` frames later.

    Of the frames only samples and those ``gap`` later are kept, in order, so the later
    one is among the next few rows; nothing is joined.
    """
    wanted = lambda d: (d % every == 0) | ((d - gap) % every == 0)
    rows = _wide(reads, by, at, kinds).where(wanted(F.col("at")))
    names = [f"{k}_{s}" for k in kinds for s in SIDES]
    rows = rows.withColumn("_n0", F.struct("at", *names))
    hops = sum(bool(wanted(d)) for d in range(1, gap + 1))
    for i in range(hops):
        rows = scan(rows, by, ["at"], {f"_n{i + 1}": lead(f"_n{i}")})
    later = F.coalesce(*[F.when(F.col(f"_n{i}.at") == F.col("at") + gap, F.col(f"_n{i}")) for i in range(hops + 1)])
    rows = rows.where(F.col("at") % every == 0).withColumn("_later", later)
    return _long(rows, by, kinds, lambda n: {"confirmed": _held(F.col(f"_later.{n}"), F.col(n))})


def _probes(reads: DataFrame, by: list[str], at: str, kinds: Iterable[str], refine: int) -> DataFrame:
    """Frames, long, that may be the first to show a new value.

    Looked at one by one, a frame that shows the same as the one read before it is none:
    either that one is as good, or it is the last that showed the old value.
    """
    rows = _wide(reads, by, at, kinds)
    if refine > 1:
        return _long(rows, by, kinds, lambda n: {}).drop(PART)
    rows = scan(rows, by, ["at"], {f"_b_{k}_{s}": last_before(f"{k}_{s}") for k in kinds for s in SIDES})
    return _long(rows, by, kinds, lambda n: {"_b": F.col(f"_b_{n}")}).where(~F.col("value").eqNullSafe(F.col("_b"))).drop("_b", PART)


def counter_scan(reads: DataFrame, by: list[str], at: str, kinds: dict[str, int], every: int, gap: int, refine: int, refined: set[str], replicated: set[str]) -> DataFrame:
    """Events of whole clips: kind, side, at, event_at, n, home and away.

    ``kinds`` are the counters and the largest step of each. Every ``every``-th frame is
    a sample; each side is scanned on its own. A first value needs two equal readings in
    a row. A step must hold ``gap`` frames later. A step of a ``refined`` counter is
    placed at the first frame, ``refine`` apart, after the last one that showed the old
    value, that shows the new one (or one more); one of a ``replicated`` counter by d
    gives d events. The other side's value is what was believed then (null: nothing
    yet); of one frame, home comes first.
    """
    key = [*by, "kind", "side"]
    samples = _sampled(reads, by, at, kinds, every, gap)
    most = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("kind")]
    found = counter_rows(samples, key, "at", "value", F.col("confirmed"), most)
    # Both sides' believed values, in one order: one row for each change, so few.
    changes = found.select(*key, F.col("seq").alias("at"), F.col("v").alias("value"), "step", "lo").withColumn("turn", F.when(F.col("side") == "home", 0).otherwise(1))
    mine = {s: F.when(F.col("side") == s, F.col("value")) for s in SIDES}
    both = scan(changes, [*by, "kind"], ["at", "turn"], {f"_{s}": last_before(c) for s, c in mine.items()})
    lo = F.when(F.col("kind").isin(*refined), F.col("lo")).alias("lo")
    events = both.where("step is not null").select(*key, "at", "step", *[F.coalesce(mine[s], F.col(f"_{s}")).alias(s) for s in SIDES], F.col("value").alias("new"), lo)
    on_grid = ((F.col("probe") - F.col("lo") - 1) % refine == 0) & (F.col("seen") >= F.col("new")) & (F.col("seen") <= F.col("new") + 1)
    probes = _probes(reads, by, at, [k for k in kinds if k in refined], refine).select(*key, F.col("at").alias("probe"), F.col("value").alias("seen"))
    out = first_within(events, probes, key, "lo", "at", "at", "probe", on_grid, 8 * every).withColumnRenamed("refined_us", "event_at")
    times = F.when(F.col("kind").isin(*replicated), F.col("step")).otherwise(F.lit(1)).cast("int")
    return out.withColumn("n", F.explode(F.sequence(F.lit(1), times))).select(*key, "at", "event_at", F.col("n").cast("long").alias("n"), *SIDES)


def _pair(home, away) -> str | None:
    """Two counts as one state."""
    return None if home is None or away is None else f"{home},{away}"


class _Segment(Step):
    """One segment a row: its samples against the pair that the last segment left, if that was visible.

    ``state`` is that pair, None where nothing was visible (or at the start). Samples are
    one list of at, home, away and which of both hold (see :func:`_flat`).
    """

    def __init__(self, most: int, state: str | None):
        self.most, self.state = most, state or None

    def row(self, row):
        seq, samples, *rest = row
        run = tuple(map(int, self.state.split(","))) if self.state else None
        seen, good, shots = None, None, []
        for at, home, away, holds in zip(*[iter(samples or ())] * 4, strict=True):
            if run is None:
                run = seen = home, away
                good = at
                continue
            left, right = home - run[0], away - run[1]
            if left == right == 0:
                seen, good = run, at
            elif 0 <= left <= self.most and 0 <= right <= self.most and (not left or holds & 1) and (not right or holds & 2):
                shots.append({"at": at, "lo": good, "home": home if left else None, "away": away if right else None, "n": left + right})
                run = seen = home, away
                good = at
        self.state = _pair(*seen) if seen else None
        return ((seq, seen is not None, *(seen or (None, None)), shots, *rest),)


class _SegmentTrial(Step):
    """What a run of segments makes of each pair that the segment before may have left.

    Only pairs within reach of a reading of the first segment can matter there; with any
    other the first segment stays unseen, as with a pair that no reading is near. From
    then on states that have met go together.
    """

    def __init__(self, most: int):
        self.most, self.at = most, None

    def row(self, row):
        if self.at is None:
            near = {None, OUT_OF_REACH}
            for _, home, away, _ in zip(*[iter(row[1] or ())] * 4, strict=True):
                near |= {_pair(home - i, away - j) for i in range(self.most + 1) for j in range(self.most + 1)}
            self.at = {state: [state] for state in near}
        after: dict = {}
        for state, starts in self.at.items():
            step = _Segment(self.most, state)
            step.row(row)
            after.setdefault(step.state, []).extend(starts)
        self.at = after
        return ()

    def end(self):
        pairs = [(start, state) for state, starts in (self.at or {}).items() for start in starts]
        return (([p[0] for p in pairs], [p[1] for p in pairs]),)


#: A pair that no reading is near.
OUT_OF_REACH = "-1000000,-1000000"


def score_up(home: Column, away: Column, most: int = 3) -> Column:
    """Whether a score changed by these differences: each side as before or up by at most ``most``, and one of them up."""
    return (F.least(home, away) >= 0) & (F.greatest(home, away).between(1, most))


def segment_counters(segments: DataFrame, by: list[str], seq: str, samples: str, most: int = 2) -> DataFrame:
    """seq, hud_visible, shots_home, shots_away, score_home, score_away, score_changed, shot_count and shots of every segment.

    ``samples`` is an array of structs in order of ``at``: shots_home, shots_away,
    score_home and score_away as read there, later_home, later_away, then_home and
    then_away as read a moment later (null: unread, or past the end). ``seq`` numbers a
    clip's segments from 0.

    Shots start from what the segment before left, if anything was visible there, and
    else from the first reading. Both sides must be readable, each unchanged or up by at
    most ``most``, and what went up must hold. A segment is visible if a reading was
    believed. A score changed if the segment before was visible and it is a small step
    (:func:`score_up`) from the last score that any segment had; a segment's own score is
    its first reading, then such steps that hold. ``shots`` are the believed steps: at, lo
    (where the old pair was last seen in the segment, or null), the new values of the
    sides that changed, and n.
    """
    # A segment stays one row: its own score, and what its shots need, go through the fold together.
    score = _own_score(samples, segments.schema[samples].dataType)
    part = segments.select(*by, F.col(seq).alias("seq"), samples, *split(segments)).withColumn("_s", score)
    part = part.select(*by, "seq", _flat(samples).alias("samples"), F.col("_s.h").alias("score_home"), F.col("_s.a").alias("score_away"), *[F.col(c).alias("_range") for c in split(part)], *split(part))
    shot = "array<struct<at:bigint,lo:bigint,home:bigint,away:bigint,n:bigint>>"
    both = chunked_fold(
        part, by, "seq", lambda state: _Segment(most, state), lambda: _SegmentTrial(most), "string",
        f"seq long, hud_visible boolean, shots_home long, shots_away long, shots {shot}, score_home long, score_away long" + ", _range long" * len(split(part)), OUT_OF_REACH,
    )
    both = both.withColumnRenamed("_range", PART)
    pair = F.when(F.col("score_home").isNotNull(), F.struct(F.col("score_home").alias("h"), F.col("score_away").alias("a")))
    both = scan(both, by, ["seq"], {"_visible": lag("hud_visible"), "_last": last_before(pair)})
    changed = F.col("_visible") & score_up(F.col("score_home") - F.col("_last.h"), F.col("score_away") - F.col("_last.a"))
    count = F.aggregate("shots", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return both.select(*by, "seq", "hud_visible", "shots_home", "shots_away", "score_home", "score_away", F.coalesce(changed, F.lit(False)).alias("score_changed"), count.alias("shot_count"), "shots")


def _flat(samples: str) -> Column:
    """at, shots_home, shots_away and a number (1: home holds, 2: away does) of each sample with both shots, one after the other in one array."""

    def four(x: Column) -> Column:
        home, away = x["shots_home"].cast("long"), x["shots_away"].cast("long")
        holds = F.when(_held(x["later_home"], home), 1).otherwise(0) + F.when(_held(x["later_away"], away), 2).otherwise(0)
        return F.array(x["at"].cast("long"), home, away, holds.cast("long"))

    return F.flatten(F.transform(F.filter(samples, lambda x: x["shots_home"].isNotNull() & x["shots_away"].isNotNull()), four))


def _own_score(samples: str, kind: DataType) -> Column:
    """A segment's own score (h and a); nothing is carried from others: a fold over its few samples."""
    start = F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("a"))

    def step(best: Column, x: Column) -> Column:
        new = F.struct(x["score_home"].cast("long").alias("h"), x["score_away"].cast("long").alias("a"))
        up = new["h"] - best["h"], new["a"] - best["a"]
        held = ((up[0] == 0) | _held(x["then_home"], new["h"])) & ((up[1] == 0) | _held(x["then_away"], new["a"]))
        return F.when(new["h"].isNull() | new["a"].isNull(), best).when(best["h"].isNull() | (score_up(*up) & held), new).otherwise(best)

    return F.aggregate(F.coalesce(samples, F.array().cast(kind)), start, step)


def shot_times(counters: DataFrame, reads: DataFrame, by: list[str], seq: str, at: str, refine: int, bucket: int) -> DataFrame:
    """One row for each shot: seq, n, at (the sample) and event_at, the first frame after ``lo``, ``refine`` apart, that shows the new values of the sides that changed."""
    key = [*by, "seq"]
    shots = counters.select(*key, F.explode("shots").alias("s")).select(*key, "s.at", "s.lo", "s.home", "s.away", F.col("s.n").alias("_n"))
    probes = reads.select(*by, F.col(seq).alias("seq"), F.col(at).alias("probe"), "shots_home", "shots_away")
    shows = lambda new, now: F.col(new).isNull() | F.coalesce((F.col(now) >= F.col(new)) & (F.col(now) <= F.col(new) + 1), F.lit(False))
    accepts = ((F.col("probe") - F.col("lo") - 1) % refine == 0) & shows("home", "shots_home") & shows("away", "shots_away")
    rows = first_within(shots, probes, key, "lo", "at", "at", "probe", accepts, bucket).withColumnRenamed("refined_us", "event_at")
    return rows.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*key, "n", "at", "event_at")

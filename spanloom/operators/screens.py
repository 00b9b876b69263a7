"""Screens read as a whole: tables of statistics from placed words, and cards whose digits are voted on.

A screen is a row of its own here; its words, lines and readings are bounded by what
fits on it, so they are grouped by screen and never by clip.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import aggregates as ag
from . import events as ev
from . import sequence as sq
from . import trims as tr
from .joins import point_in_interval

TABS = ("ALL SKATERS", "GOALIES")
#: Least confidence of a word, and the column that holds names.
LEAST_WORD, NAMES = 20, "PLAYER"


def table_screens(frames: DataFrame, by: list[str], at: str, first: str, second: str, ready: str, tail: int, gap: int, least: float = 0.75, least_ready: float = 0.80) -> DataFrame:
    """The middle frame of each run of frames that show a finished table, in the last ``tail`` of each clip; adds tab.

    ``first`` and ``second`` are the matches of the two tabs (the first wins a tie),
    ``ready`` that of what is shown when the table is there.
    """
    end = frames.groupBy(*by).agg(F.max(at).alias("_end"))
    passes, which = tr.joint_gate(F.col(first), F.col(second), F.col(ready), least, least_ready)
    shown = frames.join(end, by).where((F.col(at) >= F.col("_end") - tail) & passes).withColumn("tab", F.element_at(F.array(*map(F.lit, TABS)), which + 1)).drop("_end")
    return ev.middle(ev.sessions(shown, by, at, gap, "_screen"), [*by, "_screen"], at).drop("_screen")


def _bands(centres: DataFrame, by: list[str], centre: str) -> DataFrame:
    """Adds _from and _to: the stretch that is nearest to each centre of its screen; halfway belongs to the lower."""
    w = Window.partitionBy(*by).orderBy(centre)  # a screen's few centres
    return centres.withColumn("_from", (F.lag(centre).over(w) + F.col(centre)) / 2).withColumn("_to", (F.lead(centre).over(w) + F.col(centre)) / 2)


def _within(value: str, low: str, high: str) -> Column:
    return (F.col(low).isNull() | (F.col(value) > F.col(low))) & (F.col(high).isNull() | (F.col(value) <= F.col(high)))


def cells(words: DataFrame, screen: list[str], columns: DataFrame, rows: DataFrame) -> DataFrame:
    """screen, row_no, column and value: of each cell the first word that is nearest to it, cleaned; names left out.

    ``words`` have text, conf, x, y and ord (reading order); ``columns`` (screen, column,
    cx) and ``rows`` (screen, row_no, cy) are each screen's own.
    """
    seen = words.where((F.trim("text") != "") & (F.col("conf") >= LEAST_WORD))
    across = _bands(columns, screen, "cx").select(*screen, "column", F.col("_from").alias("_x0"), F.col("_to").alias("_x1"))
    down = _bands(rows, screen, "cy").select(*screen, "row_no", F.col("_from").alias("_y0"), F.col("_to").alias("_y1"))
    placed = seen.join(across, screen).where(_within("x", "_x0", "_x1")).join(down, screen).where(_within("y", "_y0", "_y1") & (F.col("column") != NAMES))
    first = placed.groupBy(*screen, "row_no", "column").agg(F.min_by(F.trim("text"), "ord").alias("_text"))
    return first.select(*screen, "row_no", "column", tx.clean_numeric(F.col("_text"), F.col("column")).alias("value"))


def _place(pixel: Column, centres: list[float], shifts: list[float]) -> Column:
    """The upper end of the stretch of pixels around one that has the same nearest of ``centres`` as it has under each of ``shifts``."""
    ordered = sorted(centres)
    cuts = sorted({(a + b) / 2 + s for a, b in pairwise(ordered) for s in shifts})
    if not cuts:
        return F.lit(0.0)
    low, high = math.floor(cuts[0]), math.floor(cuts[-1]) + 1  # all above are alike, as all below are
    ends = [float(cuts[i]) if (i := bisect_left(cuts, x)) < len(cuts) else float(high) for x in range(low, high + 1)]
    return F.get(F.lit(ends), F.least(F.greatest(pixel - low, F.lit(0)), F.lit(high - low)).cast("int"))


def _nearest(value: Column, centres: dict, shift: Column) -> Column:
    """Name of the nearest of a few centres that stand ``shift`` further on; halfway belongs to the lower."""
    ordered = sorted(centres.items(), key=lambda c: c[1])
    out = F.lit(ordered[-1][0])
    for (name, low), (_, high) in reversed(list(pairwise(ordered))):
        out = F.when(value <= F.lit((low + high) / 2) + shift, F.lit(name)).otherwise(out)
    return out


def page_cells(words: DataFrame, page: list[str], screens: DataFrame, screen: list[str], columns: dict[str, float], rows: dict[int, float], right: list[float], down: list[float], text: Callable[[Column], Column]) -> DataFrame:
    """What :func:`cells` finds where many screens show the same ``page`` of words, each shifted: screen, row_no, column and value.

    ``words`` have the page's columns, conf, x and y in whole pixels, and key, a long in
    reading order from which ``text`` gives the word. ``screens`` have
    screen, page, dx and dy, which are among ``right`` and ``down``; columns and rows are
    at the same places of all, but for that shift.

    Words are not copied to screens. Words that no shift tells apart stand at one place
    of their page, and only the first of a place can be the first of a cell; then the
    first of each column is found for each dx of a page, and of those each screen takes
    the first in each of its rows. A page has no more places than cuts allow, however
    many words it has. Group words by page beforehand and they are not shuffled again.
    """
    seen = words.where((F.trim(text(F.col("key"))) != "") & (F.col("conf") >= LEAST_WORD))
    seen = seen.withColumn("_x", _place(F.col("x"), list(columns.values()), right)).withColumn("_y", _place(F.col("y"), list(rows.values()), down)).where("x is not null and y is not null")
    places = seen.groupBy(*page, "_x", "_y").agg(F.min("key").alias("key"))
    shown = screens.select(*page, "dx").distinct()
    across = places.join(shown.hint("shuffle_hash"), page).withColumn("column", _nearest(F.col("_x"), columns, F.col("dx"))).where(F.col("column") != NAMES)
    strips = across.groupBy(*page, "dx", "column", "_y").agg(F.min("key").alias("key"))
    found = strips.join(screens.select(*screen, *page, "dx", "dy").hint("shuffle_hash"), [*page, "dx"]).withColumn("row_no", _nearest(F.col("_y"), rows, F.col("dy")))
    first = found.groupBy(*screen, "row_no", "column").agg(F.min("key").alias("key"))
    return first.select(*screen, "row_no", "column", tx.clean_numeric(F.trim(text(F.col("key"))), F.col("column")).alias("value"))


def tables(words: DataFrame, screen: list[str], columns: DataFrame, rows: DataFrame, names: DataFrame, stop: int = 3) -> DataFrame:
    """Tables (see :func:`cell_tables`) of each screen's own words."""
    return cell_tables(cells(words, screen, columns, rows), screen, rows, names, stop)


def cell_tables(found: DataFrame, screen: list[str], rows: DataFrame, names: DataFrame, stop: int = 3) -> DataFrame:
    """screen, row_no, name and cells (a map of column to value, empty where nothing was read) of each screen's table, up to the ``stop``-th empty row in a row and without empty rows at its end.

    ``names`` (screen, row_no, line) are the lines of the name column.
    """
    found = found.groupBy(*screen, "row_no").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("cells"))
    none = F.create_map().cast("map<string,string>")
    grid = rows.select(*screen, "row_no").join(found, [*screen, "row_no"], "left").join(names, [*screen, "row_no"], "left")
    grid = grid.select(*screen, "row_no", F.coalesce(tx.player_line(F.col("line")), F.lit("")).alias("name"), F.coalesce("cells", none).alias("cells"))
    empty = (F.col("name") == "") & ~F.exists(F.map_values("cells"), lambda v: (v != "") & (v != "-"))
    return sq.empty_sentinel(grid, screen, "row_no", empty, stop)


def statistics(tables: DataFrame, screens: DataFrame, screen: list[str], team: list[str], at: str) -> DataFrame:
    """Rows of the fullest screen of each ``team`` (its columns, tab among them); the first of ties. ``screens`` has them, and the time, for each screen."""
    known = list(dict.fromkeys([*screen, *team, at]))
    every = tables.join(screens.select(*known), screen)
    # One row for each screen, with its rows in it: they are not asked for again.
    whole = every.groupBy(*known).agg(F.collect_list(F.struct(*[c for c in every.columns if c not in known])).alias("_rows"))  # what fits on a screen
    first = F.row_number().over(Window.partitionBy(*team).orderBy(F.size("_rows").desc(), at, *screen))
    return whole.withColumn("_n", first).where("_n = 1").select(*known, F.inline("_rows"))


def card_peaks(frames: DataFrame, by: list[str], rank: str, at: str, score: str, tail: int, least: float = 0.85) -> DataFrame:
    """Where each rank's card matches best in the last ``tail`` of each clip (the first time of ties), if well enough: peak and score."""
    end = frames.groupBy(*by).agg(F.max(at).alias("_end"))
    shown = frames.join(end, by).where(F.col(at) >= F.col("_end") - tail)
    return ag.first_peak(shown, [*by, rank], at, score).where(F.col(score) >= least).select(*by, rank, F.col(at).alias("peak"), score)


def around(peaks: DataFrame, rows: DataFrame, by: list[str], at: str, before: int, after: int, bucket: int) -> DataFrame:
    """Rows of the same clip in [peak - before, peak + after] of each peak."""
    spans = peaks.withColumn("_s", F.col("peak") - before).withColumn("_e", F.col("peak") + after + 1)
    return point_in_interval(rows, spans, by, at, "_s", "_e", bucket).drop("_s", "_e")


def position_votes(reads: DataFrame, by: list[str], values: str, weight: str, order: list[str], positions: int = 3) -> DataFrame:
    """by and digits: for each position the value with the most weight behind it, of ties the one read first; 0 where nothing or no number was read there."""
    votes = reads.select(*by, F.posexplode(values).alias("_pos", "_v"), weight, F.struct(*order).alias("_o")).where((F.col("_pos") < positions) & F.col("_v").isNotNull())
    sums = votes.groupBy(*by, "_pos", "_v").agg(F.sum(weight).alias("_w"), F.min("_o").alias("_first"))
    place = F.row_number().over(Window.partitionBy(*by, "_pos").orderBy(F.col("_w").desc(), "_first"))
    won = sums.withColumn("_n", place).where("_n = 1").groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_v"))).alias("_m"))  # one for each position
    digit = lambda i: F.when(F.col("_m")[i].rlike(r"^\d+$"), F.col("_m")[i]).otherwise("0")
    return won.select(*by, F.array(*[digit(i) for i in range(positions)]).alias("digits"))


def bottom_word(words: DataFrame, by: list[str], text: str, top: str, order: str, within: int = 60, letters: int = 3) -> DataFrame:
    """by and word: of the words with at least ``letters`` letters that stand within ``within`` of the lowest one, the longest; the first of ties."""
    good = words.select(*by, F.trim(text).alias("word"), top, order).where(F.length(F.regexp_replace("word", r"[^\p{L}]", "")) >= letters)
    low = good.groupBy(*by).agg(F.max(top).alias("_low"))
    return ag.best_by(good.join(low, by).where(F.col(top) >= F.col("_low") - within), by, [F.length("word")], order, ["word"])


def best_name(reads: DataFrame, by: list[str], name: str, order: str) -> DataFrame:
    """by and name: the cleaned reading of the best quality, then the most words in title case, then the most letters; the first of ties."""
    clean = reads.withColumn("_name", tx.clean_name(F.col(name)))
    ranks = [tx.name_quality(F.col("_name")), tx.title_score(F.col("_name")), F.length(F.regexp_replace("_name", r"[^\p{L}]", ""))]
    return ag.best_by(clean, by, ranks, order, ["_name"]).withColumnRenamed("_name", "name")

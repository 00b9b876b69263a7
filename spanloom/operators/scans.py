"""Prefix scans over ordered groups, split where a group is too long for one task.

A window numbers, sums up or looks around in a group's rows in one task. For groups of
more than ``ROWS`` rows, :func:`ranged` cuts the order into ranges of about that many
and adds their number as ``PART``; operators see that column and scan in two levels:
each range on its own, then one row for each range (its count, sums, first and last
values) is scanned, and what came before (or comes after) is handed to the range's rows.
Tables without a long group get no such column and plain windows.

``PART`` follows the order that it was made for. Where rows are put in another order,
drop it or make it anew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Column with the number of a group's range, from 0 in order; only there if some group is split.
PART = "_part"
#: Column with a number for a text's place.
PLACE = "_place"
#: Rows of one group that a task takes.
ROWS = 200_000
#: A group is cut in at most so many ranges; its cuts are one array.
MOST_RANGES = 4_096
#: Cuts of long groups (8 bytes each) that are sent to every task at most.
BROADCAST_CUTS = 1_000_000


def split(df: DataFrame) -> list[str]:
    """``PART``, if ``df`` has it: for selections that keep it."""
    return [c for c in (PART,) if c in df.columns]


def ranged(df: DataFrame, by: list[str], at: str, rows: int | None = None) -> DataFrame:
    """``df`` with ``PART``, if any group has more than ``rows`` rows; equal values of ``at`` stay together.

    Groups are counted first, unless the whole table is no longer than that. The cuts
    of long groups are quantiles, merged from sketches of all tasks. Of texts the bytes
    that follow what all of a group begin with stand for their order.
    """
    rows = rows or ROWS
    if df.count() <= rows:
        return df
    long = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    found = long.agg(F.max("_n").alias("most"), F.count("*").alias("n")).first()
    if not found["n"]:
        return df
    k = min(-(-found["most"] // rows), MOST_RANGES)
    small = found["n"] * k <= BROADCAST_CUTS
    sent = (lambda t: F.broadcast(t)) if small else (lambda t: t)
    if isinstance(df.schema[at].dataType, StringType):
        ends = df.join(sent(long.select(*by)), by, "left_semi").groupBy(*by).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
        ends = ends.select(*by, F.expr("aggregate(sequence(1, greatest(1, least(length(_a), length(_b)))), 0, (n, i) -> if(n = i - 1 and substring(_a, i, 1) = substring(_b, i, 1), i, n))").alias("_same"))
        df = df.join(sent(ends), by, "left").withColumn(PLACE, F.conv(F.rpad(F.substring(F.hex(F.encode(F.substr(at, F.col("_same") + 1), "UTF-8")), 1, 14), 14, "0"), 16, 10).cast("long"))
        at = PLACE
    cuts = df.join(sent(long.select(*by)), by, "left_semi").groupBy(*by).agg(F.percentile_approx(at, [i / k for i in range(1, k)], 20 * k).alias("_cuts"), F.ceil(F.count("*") / rows).alias("_own"))
    # The longest group has k ranges, a shorter one as many as its own length asks for.
    part = F.floor(F.size(F.filter("_cuts", lambda c: c < F.col(at))) * F.least("_own", F.lit(k)) / k)
    return df.join(sent(cuts), by, "left").withColumn(PART, F.coalesce(part, F.lit(0)).cast("long")).drop("_cuts", "_own", "_same", PLACE)


@dataclass
class Scan:
    """One column of a scan: its value in a window of rows; what a range hands on; how ranges' values combine in a window over ranges; how the two meet."""

    local: Callable[[WindowSpec], Column]
    summary: Callable[[Column], Column]
    carry: Callable[[Column, WindowSpec], Column]
    meet: Callable[[Column, Column], Column]


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _until(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def _after(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(1, Window.unboundedFollowing)


def _whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _sum(mine: Column, carried: Column) -> Column:
    return F.coalesce(mine + carried, mine, carried)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_number() -> Scan:
    return Scan(lambda w: F.row_number().over(w).cast("long"), lambda o: F.count("*"), lambda s, w: F.sum(s).over(_before(w)), _sum)


def running_sum(c: Column | str) -> Scan:
    """Sum up to and with the row."""
    return Scan(lambda w: F.sum(_c(c)).over(_until(w)), lambda o: F.sum(_c(c)), lambda s, w: F.sum(s).over(_before(w)), _sum)


def sum_before(c: Column | str) -> Scan:
    """Sum of the rows before; 0 for the first."""
    return Scan(lambda w: F.coalesce(F.sum(_c(c)).over(_before(w)), F.lit(0)), lambda o: F.sum(_c(c)), lambda s, w: F.sum(s).over(_before(w)), _sum)


def max_before(c: Column | str) -> Scan:
    return Scan(lambda w: F.max(_c(c)).over(_before(w)), lambda o: F.max(_c(c)), lambda s, w: F.max(s).over(_before(w)), lambda a, b: F.greatest(a, b))


def whole_max(c: Column | str) -> Scan:
    """The largest value of the whole group."""
    return Scan(lambda w: F.max(_c(c)).over(_whole(w)), lambda o: F.max(_c(c)), lambda s, w: F.max(s).over(_whole(w)), lambda a, b: F.coalesce(b, a))


def whole_min(c: Column | str) -> Scan:
    return Scan(lambda w: F.min(_c(c)).over(_whole(w)), lambda o: F.min(_c(c)), lambda s, w: F.min(s).over(_whole(w)), lambda a, b: F.coalesce(b, a))


def whole_sum(c: Column | str) -> Scan:
    return Scan(lambda w: F.sum(_c(c)).over(_whole(w)), lambda o: F.sum(_c(c)), lambda s, w: F.sum(s).over(_whole(w)), lambda a, b: F.coalesce(b, a))


def last_before(c: Column | str) -> Scan:
    """The last value before the row that isn't null."""
    return Scan(
        lambda w: F.last(_c(c), ignorenulls=True).over(_before(w)), lambda o: F.max_by(_c(c), F.when(_c(c).isNotNull(), o)),
        lambda s, w: F.last(s, ignorenulls=True).over(_before(w)), lambda a, b: F.coalesce(a, b),
    )


def next_after(c: Column | str) -> Scan:
    """The first value after the row that isn't null."""
    return Scan(
        lambda w: F.first(_c(c), ignorenulls=True).over(_after(w)), lambda o: F.min_by(_c(c), F.when(_c(c).isNotNull(), o)),
        lambda s, w: F.first(s, ignorenulls=True).over(_after(w)), lambda a, b: F.coalesce(a, b),
    )


def lag(c: Column | str) -> Scan:
    """The value of the row before, null or not."""
    boxed = F.struct(_c(c).alias("v"))
    return Scan(lambda w: F.lag(boxed).over(w), lambda o: F.max_by(boxed, o), lambda s, w: F.lag(s).over(w), lambda a, b: F.coalesce(a, b)["v"])


def lead(c: Column | str) -> Scan:
    """The value of the row after, null or not."""
    boxed = F.struct(_c(c).alias("v"))
    return Scan(lambda w: F.lead(boxed).over(w), lambda o: F.min_by(boxed, o), lambda s, w: F.lead(s).over(w), lambda a, b: F.coalesce(a, b)["v"])


def scan(df: DataFrame, by: list[str], order: list[str], columns: dict[str, Scan]) -> DataFrame:
    """``df`` with one column for each scan over its groups' rows in ``order`` (ascending; no two rows of a range equal, or equal ones alike)."""
    if PART not in df.columns:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumns({name: s.meet(s.local(w), F.lit(None)) for name, s in columns.items()})
    w, place = Window.partitionBy(*by, PART).orderBy(*order), F.struct(*order)
    rows = df.withColumns({f"_l{i}": s.local(w) for i, s in enumerate(columns.values())})
    over = Window.partitionBy(*[f"_k{i}" for i in range(len(by))]).orderBy("_p")
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    ranges = df.groupBy(*keys, F.col(PART).alias("_p")).agg(*[s.summary(place).alias(f"_s{i}") for i, s in enumerate(columns.values())])  # a row for each range
    carried = ranges.select(*[f"_k{i}" for i in range(len(by))], "_p", *[s.carry(F.col(f"_s{i}"), over).alias(f"_c{i}") for i, s in enumerate(columns.values())])
    same = F.col(PART) == F.col("_p")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(carried, same)
    return joined.select(*[c for c in df.columns if c not in columns], *[s.meet(F.col(f"_l{i}"), F.col(f"_c{i}")).alias(name) for i, (name, s) in enumerate(columns.items())])

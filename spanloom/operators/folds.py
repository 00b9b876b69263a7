"""Ordered folds: state carried from row to row of a group, never the whole group in memory.

Rows of a group stand together and in order in one partition and pass through as
Arrow batches; what is kept between rows is the step's own state. Split a group
where its state is known to start anew (a long gap) and pass that as part of
``by``, so that one large group is no single task. A step whose states can be followed
through a chunk without knowing the right one needs no such place: :func:`chunked_fold`
cuts anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .scans import PART

class Step:
    """One group's fold: ``row`` gets a row's columns but those of ``by``, as a tuple; ``row`` and ``end`` give the rows to send on."""

    def row(self, row: tuple) -> Iterable[tuple]:
        raise NotImplementedError

    def end(self) -> Iterable[tuple]:
        return ()


def ordered_fold(df: DataFrame, by: list[str], order: list[str | Column], make: Callable[[], Step], schema: str, batch_rows: int = 5_000) -> DataFrame:
    """Folds each group's rows in order; the columns ``by`` come first in the result."""
    kinds = StructType([df.schema[c] for c in by] + list(_parse_datatype_string(schema)))
    arrow = to_arrow_schema(kinds)
    names = [c for c in df.columns if c not in by]

    def run(batches):
        step, seen, out = None, None, []
        for batch in batches:
            cells = {c: _cells(batch.column(i)) for i, c in enumerate(batch.schema.names)}
            for key, row in zip(zip(*(cells[c] for c in by), strict=True), zip(*(cells[c] for c in names), strict=True), strict=True):
                if step is None or key != seen:
                    if step is not None:
                        out += [seen + tuple(r) for r in step.end()]
                    step, seen = make(), key
                out += [key + tuple(r) for r in step.row(row)]
                if len(out) >= batch_rows:
                    yield _batch(out, arrow)
                    out = []
        if step is not None:
            out += [seen + tuple(r) for r in step.end()]
        if out:
            yield _batch(out, arrow)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, kinds)


def _cells(column: pa.Array) -> list:
    """``to_pylist``; numbers and lists of them at once instead of one by one."""
    kind = column.type
    if pa.types.is_list(kind):
        values = _cells(column.values)
        out = [values[a:b] for a, b in pairwise(column.offsets.to_pylist())]
    elif pa.types.is_integer(kind):
        out = (column.fill_null(0) if column.null_count else column).to_numpy(zero_copy_only=False).tolist()
    else:
        return column.to_pylist()
    return [v if there else None for v, there in zip(out, column.is_valid().to_pylist(), strict=True)] if column.null_count else out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*rows, strict=True)), schema, strict=True)], schema=schema)


class Trial(Step):
    """Where a chunk leads from each of a few states; None is the state at a group's start."""

    def __init__(self, states: list, make: Callable):
        self.starts = [None, *states]
        self.steps = [make(s) for s in self.starts]

    def row(self, row):
        for step in self.steps:
            for _ in step.row(row):
                pass
        return ()

    def end(self):
        return ((self.starts, [s.state for s in self.steps]),)


class _Walk(Step):
    """The state that each chunk starts in; one that a chunk doesn't list goes through it unchanged."""

    def __init__(self, other: object):
        self.state, self.other = None, other

    def row(self, row):
        chunk, starts, ends = row
        become = dict(zip(starts, ends, strict=True))
        before, self.state = self.state, become.get(self.state, self.state if self.other is None else become.get(self.other))
        return ((chunk, before),)


class _From(Step):
    """A chunk from its start on; the last column of a row is the state there."""

    def __init__(self, make: Callable):
        self.make, self.step = make, None

    def row(self, row):
        if self.step is None:
            self.step = self.make(row[-1])
        return self.step.row(row[:-1])

    def end(self):
        return self.step.end() if self.step else ()


def chunked_fold(df: DataFrame, by: list[str], seq: str, make: Callable[[object], Step], trial: Callable[[], Step], kind: str, schema: str, other: object = None) -> DataFrame:
    """An ordered fold by ``seq`` of steps whose ``state`` is one value of the SQL type ``kind``, None at a group's start.

    Without a column ``PART`` (see ``scans``) groups are short and folded as they are.
    With it its ranges are folded side by side: ``trial`` folds a range into the states
    that change in it and what each becomes (a row of two arrays), for all ranges at
    once; then it is known what each starts in. A state that a range doesn't list goes
    through it unchanged, or, with ``other``, as that state does. A step's ``end`` is
    called for each range.
    """
    if PART not in df.columns:
        return ordered_fold(df, by, [seq], lambda: make(None), schema)
    part = df.withColumnRenamed(PART, "_chunk")
    # Groups of one range only have nothing to try. A row for each of the others, and one for each of their ranges; joined as their sizes turn out.
    long = part.where("_chunk > 0").select(*by).distinct()
    maps = ordered_fold(part.join(long, by, "left_semi"), [*by, "_chunk"], [seq], trial, f"starts array<{kind}>, ends array<{kind}>")
    starts = ordered_fold(maps, by, ["_chunk"], lambda: _Walk(other), f"_chunk long, _state {kind}")
    return ordered_fold(part.join(starts, [*by, "_chunk"], "left"), [*by, "_chunk"], [seq], lambda: _From(make), schema).drop("_chunk")

"""Throttle and counter as stream processors with timers: the state of a clip that has gone quiet goes, and nothing is left pending.

State is kept by value and list states under event time. A timer stands a fixed time
after the last row; when the watermark passes it, what is pending is settled and the
clip's state is cleared. Rows that come in the wrong order within a clip's history are
counted as late and sent on as such, not dropped in silence.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

MICROS = 1_000


def _ordered(rows: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """The numbers that decide, of one key's rows in a micro-batch, in order."""
    parts = [f[list(columns)] for f in rows]
    both = pd.concat(parts).sort_values(list(columns)) if parts else pd.DataFrame(columns=list(columns))
    return list(both.itertuples(index=False, name=None))


class _Timed(StatefulProcessor):
    """One timer for each key, moved on by every batch of its rows."""

    def init(self, handle) -> None:
        self.handle = handle

    def quiet(self, last_us: int, gap_us: int) -> None:
        """The key counts as quiet ``gap_us`` after ``last_us``."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((last_us + gap_us) // MICROS + 1)

    def close(self) -> None:
        pass


class _Throttle(_Timed):
    def __init__(self, key: str, at: str, ident: str, gap: int):
        self.columns, self.gap = (key, at, ident), gap

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "last long, newest long")

    def handleInputRows(self, key, rows, timerValues):
        last, newest = self.last.get() if self.last.exists() else (None, None)
        out = []
        for t, i in _ordered(rows, *self.columns[1:]):
            late = newest is not None and t < newest
            if not late and (last is None or t - last > self.gap):
                last = t
                out.append((key[0], t, i, False))
            elif late:
                out.append((key[0], t, i, True))
            newest = t if newest is None else max(newest, t)
        self.last.update((last, newest))
        self.quiet(newest, self.gap)
        yield pd.DataFrame(out, columns=[*self.columns, "late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # Beyond the gap every hit is kept: nothing of this key need be known.
        self.last.clear()
        yield pd.DataFrame([], columns=[*self.columns, "late"])


def throttle(stream: DataFrame, key: str, at: str, ident: str, ts: str, gap: int, late: str) -> DataFrame:
    """key, at, ident and late: hits that are kept (see ``streams.throttle``), and with ``late`` set those that came after a later one of their key.

    ``at`` are the microseconds of ``ts``, whose watermark is ``late`` behind. A key's
    state goes when the watermark is more than ``gap`` past its last hit; from there on
    the next hit is kept whatever the state was.
    """
    rows = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(key).transformWithStateInPandas(_Throttle(key, at, ident, gap), f"{key} long, {at} long, {ident} long, late boolean", "Append", "EventTime")


class _Counter(_Timed):
    def __init__(self, key: str, at: str, value: str, most: int, quiet_us: int):
        self.columns, self.most, self.quiet_us = (key, at, value), most, quiet_us

    def init(self, handle) -> None:
        super().init(handle)
        self.now = handle.getValueState("now", "now long, pending long, newest long")
        self.held = handle.getListState("held", "at long, value long")

    def _settled(self, key, now, held) -> list[tuple]:
        return [(key[0], held[0], held[1], held[1] - now, False)] if held is not None and now is not None else []

    def _frame(self, out):
        return pd.DataFrame(out, columns=[*self.columns, "step", "late"])

    def handleInputRows(self, key, rows, timerValues):
        now, pending, newest = self.now.get() if self.now.exists() else (None, None, None)
        held = next(iter(self.held.get()), None) if self.held.exists() else None
        out = []
        for t, v in _ordered(rows, *self.columns[1:]):
            v = None if pd.isna(v) else int(v)
            if newest is not None and t <= newest:
                out.append((key[0], t, v, None, True))
                continue
            if newest is not None and t - newest > self.quiet_us:  # quiet, though the watermark hasn't told yet
                out += self._settled(key, now, held)
                now = pending = held = None
            newest = t
            if held is not None:
                if v is None or held[1] <= v <= held[1] + 1:
                    out.append((key[0], held[0], held[1], held[1] - now, False))
                    now = held[1]
                held = None
            if v is None:
                continue
            if now is None:
                now, pending = (v, v) if v == pending else (None, v)
            elif 1 <= v - now <= self.most:
                held = (t, v)
        self.now.update((now, pending, newest))
        if held is None:
            self.held.clear()
        else:
            self.held.put([held])
        self.quiet(newest, self.quiet_us)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # Nothing came to speak against the pending value: the last of all is accepted.
        held = next(iter(self.held.get()), None) if self.held.exists() else None
        now = self.now.get()[0] if self.now.exists() else None
        self.now.clear()
        self.held.clear()
        yield self._frame(self._settled(key, now, held))


def counter(stream: DataFrame, key: str, at: str, value: str, ts: str, most: int, quiet_us: int, late: str) -> DataFrame:
    """key, at, value, step and late: accepted increments (see ``streams.counter``), and with ``late`` set (step is null) rows at or before one that had been read.

    A key that has been quiet for ``quiet_us`` is over: its pending value is accepted,
    and its state goes; what comes later starts anew.
    """
    rows = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(key).transformWithStateInPandas(_Counter(key, at, value, most, quiet_us), f"{key} long, {at} long, {value} long, step long, late boolean", "Append", "EventTime")


#: Settings of a session that runs these.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def settings(spark: SparkSession):
    """A session with ``SETTINGS`` while a stream is started, and as before after it."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

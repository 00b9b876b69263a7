"""The stateful operators on streams: sessions by watermark, throttle and counter with state per clip, and files that wait until they are settled.

What a micro-batch holds is bounded by its files (``files_per_batch``); of one key's
rows in it a task holds the numbers that decide, to put them in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of a micro-batch at most.
FILES_PER_BATCH = 8


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def sessions(stream: DataFrame, by: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of hits at most ``gap`` apart; one is sent when the watermark has passed its end. Rows later than ``late`` are dropped."""
    rows = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    out = rows.groupBy(*by, F.session_window("_t", gap)).agg(F.min("_t").alias("first_at"), F.max("_t").alias("last_at"), F.count("*").alias("n"))
    return out.drop("session_window")


def _ordered(frames: Iterator[pd.DataFrame], first: str, second: str) -> Iterator[tuple]:
    """The values of two columns, in the order of both."""
    parts = [(f[first].to_numpy(), f[second].to_numpy()) for f in frames]
    a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.lexsort((b, a))
    return zip(a[order].tolist(), b[order].tolist(), strict=True)


def throttle(stream: DataFrame, key: str, at: str, ident: str, gap: int) -> DataFrame:
    """Keeps a hit unless the last kept one of its key is at most ``gap`` before.

    Rows of one micro-batch are taken in order of time. A row at or before the
    last kept one is late: history isn't changed for it, it is dropped.
    """

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t, i in _ordered(frames, at, ident):
            if last is None or t - last > gap:
                last = t
                kept.append((k[0], t, i))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=[key, at, ident])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, {at} long, {ident} long", "last long", "append", "NoTimeout")


def counter(stream: DataFrame, key: str, order: str, value: str, most: int) -> DataFrame:
    """Accepted increments of a counter that only grows by 1 to ``most``; the first value needs two equal readings in a row.

    An increment waits for the next row of its key, which must be unread (null) or
    at most one above it; so the last row of all is never accepted. Rows before
    those of earlier micro-batches are dropped.
    """

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, pending, held, held_at, seen = state.get if state.exists else (None,) * 5
        out, newest = [], seen
        for o, v in _ordered(frames, order, value):
            if seen is not None and o <= seen:
                continue
            newest, v = o, None if pd.isna(v) else int(v)
            if held is not None:
                if v is None or held <= v <= held + 1:
                    out.append((k[0], held_at, held, held - now))
                    now = held
                held = None
            if v is None:
                continue
            if now is None:
                now, pending = (v, v) if v == pending else (None, v)
            elif 1 <= v - now <= most:
                held, held_at = v, o
        state.update((now, pending, held, held_at, newest))
        yield pd.DataFrame(out, columns=[key, order, value, "step"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, {order} long, {value} long, step long", "now long, pending long, held long, held_at long, seen long", "append", "NoTimeout")


def settle(stream: DataFrame, modified_us: str, settle_us: int, folder: str, now_us: Callable[[], int]) -> tuple[DataFrame, DataFrame]:
    """Runs a stream of files over what is there: those settled by now, and those that wait.

    A file that was written to in the last ``settle_us`` may still be growing. It
    isn't lost: each micro-batch begins with what the one before left waiting.
    Micro-batches write below their own number, so one that runs again replaces
    what it had written.
    """
    spark, done = stream.sparkSession, []

    def take(batch: DataFrame, number: int) -> None:
        rows = batch if not number else batch.unionByName(spark.read.schema(stream.schema).parquet(f"{folder}/waiting/{number - 1}"))
        ok = F.lit(now_us()) - F.col(modified_us) >= settle_us
        rows.where(ok).write.mode("overwrite").parquet(f"{folder}/settled/number={number}")
        rows.where(~ok).write.mode("overwrite").parquet(f"{folder}/waiting/{number}")
        done.append(number)

    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    empty = spark.createDataFrame([], stream.schema)
    if not done:
        return empty, empty
    settled = spark.read.schema(stream.schema).parquet(*(f"{folder}/settled/number={n}" for n in done))
    return settled, spark.read.schema(stream.schema).parquet(f"{folder}/waiting/{done[-1]}")


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there, into Parquet below ``folder``, and reads the result."""
    out = f"{folder}/streams/{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")

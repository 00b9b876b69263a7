"""Arrow batches as flat numpy arrays: the bytes of all texts and where each begins."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Bytes of text that a task turns into numpy arrays at once (a longer text goes alone).
CHUNK_BYTES = 512 << 10


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Hand freed memory back to the system: workers outlive their tasks, and what idle ones hold adds up beside the JVM."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc
        _LIBC.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, which hands its memory back when it is through."""

    def inner(batches):
        yield from run(batches)
        give_back()

    return inner


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, first = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[first : first + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of ``column`` (or one row), its bytes and offsets."""
    for batch in batches:
        data, at = flat(batch.column(batch.schema.get_field_index(column)))
        low, n = 0, batch.num_rows
        while low < n:
            high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low), data[at[low] : at[high]], at[low : high + 1] - at[low]
            low = high


def blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Blocks of about ``limit`` bytes of text: a number that no other block of the table has, and the pieces. The same partitions give the same blocks."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch, data, _ in chunks(batches, "text", min(limit, CHUNK_BYTES)):
        held.append(batch)
        size += len(data)
        if size >= limit:
            yield number, held
            number, held, size = number + 1, [], 0
    if held:
        yield number, held


_PACKED = pa.schema([("block", pa.int64()), ("docs", pa.binary())])
PACKED_SQL = "block long, docs binary"


def packed(limit: int):
    """For mapInArrow: the rows of each block with all their columns, in compressed pieces."""

    def run(batches):
        for number, parts in blocks(batches, limit):
            for part in parts:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                yield record_batch(_PACKED, [number], [sink.getvalue().to_pybytes()])

    return run


def unpacked(pieces: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`packed` pieces."""
    for piece in pieces:
        yield from pa.ipc.open_stream(piece.as_buffer())


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """Columns (arrays or lists), cast to the schema."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=False) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# 64-bit hashes of byte runs, all at once: prefix sums of b * p^i, wrapped at 2^64.
_P = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 64)
        with np.errstate(over="ignore"):
            up = np.full(size, _P, np.uint64)
            down = np.full(size, pow(_P, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def hasher(data: np.ndarray):
    """A function (starts, ends) -> 64-bit hashes of the byte runs data[start:end]."""
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    return hashes


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run data[start:end]."""
    return hasher(data)(starts, ends)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true that don't cross a text's end: starts, ends, and each text's first run (n + 1)."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    edge = np.ones(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1] if n else edge[1:n]
    edge |= cut
    at = np.flatnonzero(edge)
    starts = at[:-1][inside[at[:-1]]] if n else at[:0]
    ends = at[1:][inside[at[:-1]]] if n else at[:0]
    return starts, ends, np.searchsorted(starts, offsets)

"""A three-level n-gram trie in Elias-Fano levels, one flat image that is read where it lies: a column's buffer or a mapped file.

Level one holds the hashes of first words, level two the words that follow each of
them, level three those that follow each pair. A level is two Elias-Fano sequences:
monotone pointers (where a context's children begin) and the children's ids. Ids are
made monotone over the whole level by adding, to those of one context, the last value
of the context before: so a search inside a context is a search for the successor of
the context's base plus the id. Beside the ids lie quantised probabilities.
"""

from __future__ import annotations

import numpy as np

#: Ids inside a context are this many bits of a word's hash; codes are 1 / 1,024 of a power of two.
ID_BITS, STEPS = 32, 1_024
_ONE = np.uint64(1)
_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.int64)


def quantised(p: np.ndarray) -> np.ndarray:
    """uint16 codes of probabilities, rounded down, so no distribution's sum passes one; 0 stands for 0 (and what is below 2 ** -63)."""
    with np.errstate(divide="ignore"):
        steps = np.ceil(-np.log2(p) * STEPS - 1e-9)
    return np.where(steps < 63 * STEPS, steps + 1, 0).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.float64)
    return np.where(codes > 0, np.exp2((1 - codes) / STEPS), 0.0)


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after another, each at a multiple of 8 bytes, behind a directory of their kinds and lengths."""
    kinds = np.array([[ord(a.dtype.kind) << 8 | a.dtype.itemsize, a.size] for a in arrays], np.int64)
    parts = [np.array([len(arrays)], np.int64).tobytes(), kinds.tobytes()]
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        parts.append(raw + b"\0" * (-len(raw) % 8))
    return b"".join(parts)


def views(image) -> list[np.ndarray]:
    """The arrays of :func:`packed`, without a copy."""
    n = int(np.frombuffer(image, np.int64, 1)[0])
    at, out = 8 + 16 * n, []
    for kind, size in np.frombuffer(image, np.int64, 2 * n, 8).reshape(-1, 2):
        dtype = np.dtype(f"{chr(int(kind) >> 8)}{int(kind) & 255}")
        out.append(np.frombuffer(image, dtype, int(size), at) if size else np.zeros(0, dtype))
        at += -(-int(size) * dtype.itemsize // 8) * 8
    return out


class EliasFano:
    """A non-decreasing uint64 sequence: ``width`` low bits of each value packed, the high bits in unary with a count before every 256 bits."""

    ARRAYS = 4

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.width, self.low, self.high, self.before = int(head[0]), int(head[1]), low, high, before

    @staticmethod
    def arrays(values: np.ndarray) -> list[np.ndarray]:
        n = len(values)
        width = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1) if n else 0
        bits = np.arange(n, dtype=np.int64) * width
        low = np.zeros((n * width >> 6) + 2, np.uint64)
        if width:
            part = values & np.uint64((1 << width) - 1)
            word, off = bits >> 6, (bits & 63).astype(np.uint64)
            for to, piece in ((word, part << off), (word + 1, np.where(off > 0, part >> (np.uint64(63) - (off - (off > 0))), np.uint64(0)))):
                first = np.flatnonzero(np.diff(to, prepend=-1))
                low[to[first]] |= np.bitwise_or.reduceat(piece, first)
        place = (values >> np.uint64(width)).astype(np.int64) + np.arange(n) if n else bits
        unary = np.zeros(((int(place[-1]) if n else 0) // 256 + 2) * 256, np.uint8)
        unary[place] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(high).reshape(-1, 4).sum(axis=1, dtype=np.int64)
        return [np.array([n, width], np.int64), low, high, np.cumsum(counts) - counts]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        after = np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (self.low[word] >> off | after) & np.uint64((1 << self.width) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the k-th one (or zero)."""
        before = self.before if ones else np.arange(len(self.before)) * 256 - self.before
        block = np.searchsorted(before, k, "right") - 1
        left, word = k - before[block], block * 4
        flip = np.uint64(0) if ones else ~np.uint64(0)
        for _ in range(3):
            count = np.bitwise_count(self.high[word] ^ flip).astype(np.int64)
            on = left >= count
            left, word = left - count * on, word + on
        bits, place = self.high[word] ^ flip, word * 64
        for half in (32, 16, 8):
            count = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            on = left >= count
            left, place, bits = left - count * on, place + half * on, np.where(on, bits >> np.uint64(half), bits)
        return place + _SELECT[(bits & np.uint64(255)).astype(np.int64), np.minimum(left, 7)]

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at these places."""
        return (self._select(i, True) - i).astype(np.uint64) << np.uint64(self.width) | self._lows(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value that is at least x (n if there is none): the bucket of x's high bits, then bisection on low bits."""
        high = (x >> np.uint64(self.width)).astype(np.int64)
        buckets = len(self.high) * 64 - self.n  # zeros there are
        inside = high < buckets
        h = np.where(inside, high, 0)
        begin = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) + 1 - h, 0)
        lo, hi = begin.copy(), np.minimum(self._select(h, False) - h, self.n)
        want = x & np.uint64((1 << self.width) - 1)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = open_ & (self._lows(np.minimum(mid, max(self.n - 1, 0))) < want)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return np.where(inside, lo, self.n)

    def all(self) -> np.ndarray:
        """All values, decoded in order."""
        place = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        i = np.arange(self.n)
        return (place - i).astype(np.uint64) << np.uint64(self.width) | self._lows(i)


def _monotone(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ids, each context's raised by the last value of the one before (plus one)."""
    if not len(ids):
        return ids.astype(np.uint64)
    last = ids[first[1:] - 1].astype(np.uint64) + _ONE
    base = np.cumsum(last) - last
    return np.repeat(base, np.diff(first)) + ids.astype(np.uint64)


class Trie:
    """Levels of an image made by :func:`build`."""

    def __init__(self, image):
        a = views(image)
        take = lambda i: EliasFano(*a[i : i + EliasFano.ARRAYS])
        self.words, self.pointers, self.ids = take(0), (take(4), take(8)), (take(12), take(16))
        self.count, self.left1, self.share2, self.left2, self.share3 = a[20:25]

    @classmethod
    def open(cls, path: str) -> Trie:
        """A trie over a mapped file."""
        return cls(np.memmap(path, np.uint8, "r"))

    def first(self, u: np.ndarray, sweep: bool = False) -> np.ndarray:
        """The place of each first word's hash, -1 where it never began a pair."""
        return self._at(self.words, np.zeros(len(u), np.int64), np.full(len(u), self.words.n), u, sweep)

    def child(self, level: int, context: np.ndarray, ids: np.ndarray, sweep: bool = False) -> np.ndarray:
        """The place of each id among the children of its context (a place in the level before), -1 where there is none.

        ``sweep`` decodes the level once, for queries that go through all of it in order.
        """
        pointers, values = self.pointers[level], self.ids[level]
        known = context >= 0
        k = np.where(known, context, 0)
        if not values.n:
            return np.full(len(ids), -1)
        if sweep:
            first, all_values = pointers.all().astype(np.int64), values.all()
            begin, end = first[k], first[k + 1]
            base = np.where(begin > 0, all_values[np.maximum(begin - 1, 0)] + _ONE, np.uint64(0))
        else:
            begin, end = (pointers.access(x).astype(np.int64) for x in (k, k + 1))
            base = np.where(begin > 0, values.access(np.maximum(begin - 1, 0)) + _ONE, np.uint64(0))
            all_values = None
        return np.where(known, self._at(values, begin, end, base + ids.astype(np.uint64), sweep, all_values), -1)

    @staticmethod
    def _at(values: EliasFano, begin, end, x, sweep, decoded=None) -> np.ndarray:
        if not values.n:
            return np.full(len(x), -1)
        if sweep:
            decoded = values.all() if decoded is None else decoded
            at = np.searchsorted(decoded, x)
            found = decoded[np.minimum(at, values.n - 1)]
        else:
            at = values.successor(x)
            found = values.access(np.minimum(at, values.n - 1))
        return np.where((at >= begin) & (at < end) & (found == x), at, -1)


def build(words: np.ndarray, pairs_of: np.ndarray, second: np.ndarray, triples_of: np.ndarray, third: np.ndarray, count: np.ndarray, left1: np.ndarray, share2: np.ndarray, left2: np.ndarray, share3: np.ndarray) -> bytes:
    """The image of a trie: sorted hashes of first words, number of children of each, their ids in order, and so on; then counts of words, and codes of what is left and shared."""
    first2, first3 = (np.concatenate([[0], np.cumsum(n)]).astype(np.int64) for n in (pairs_of, triples_of))
    arrays = []
    for values in (words, first2.astype(np.uint64), first3.astype(np.uint64), _monotone(second, first2), _monotone(third, first3)):
        arrays += EliasFano.arrays(values)
    return packed([*arrays, count.astype(np.int64), left1, share2, left2, share3])

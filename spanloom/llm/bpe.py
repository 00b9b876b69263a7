"""Operator 7: byte-level BPE by overlapping chunks.

Texts of up to ``chunk`` characters are one chunk. A longer text is cut into
chunks that overlap; each is pre-tokenised on its own, in any task, from a place
that may lie inside a pre-token. Matching looks only forward, so once two
neighbours share a boundary they agree from there on: the stitch takes the first
boundary that both have in their overlap. A chunk whose end it can't agree on
(one pre-token may be longer than the overlap) is joined with its neighbour and
matched again, which is exact. The pieces between cuts are then encoded by
merging the pair of lowest rank, and decoding joins the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import column, record_batch, tidy

CHUNK, OVERLAP = 32_768, 1_024
#: Pieces whose ids a worker remembers.
CACHE = 100_000
#: Bytes up to which scanning a piece for its lowest pair is faster than a heap.
SCANNED = 48
#: A match that ends this near to a chunk's end may depend on what follows.
LOOKAHEAD = 3

# What the classes of the pattern are among the first 256 code points.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Splitter:
    """Matches of a pre-token pattern; texts of Latin-1 characters take an equal, faster pattern."""

    def __init__(self, source: str):
        self.any = regex.compile(source)
        other = f"[^{_SPACES}{_LETTERS}{_NUMBERS}]"
        for wide, narrow in ((r"[^\s\p{L}\p{N}]", other), (r"\p{L}", f"[{_LETTERS}]"), (r"\p{N}", f"[{_NUMBERS}]"), (r"\s", f"[{_SPACES}]"), (r"\S", f"[^{_SPACES}]")):
            source = source.replace(wide, narrow)
        self.latin = None if re.search(r"\\[pPwWdD]", source) else re.compile(source)

    def __call__(self, text: str) -> list[str]:
        if self.latin is not None:
            try:
                text.encode("latin-1")
                return self.latin.findall(text)
            except UnicodeEncodeError:
                pass
        return self.any.findall(text)

    def ends(self, text: str) -> list[int]:
        at, out = 0, []
        for piece in self(text):
            at += len(piece)
            out.append(at)
        return out


class Coder:
    """Encodes pieces by ranks and decodes ids; one for each worker."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.tokens}
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        raw = text.encode("utf-8")
        if (whole := self.ranks.get(raw)) is not None:
            return (whole,)
        return tuple(self._scanned(raw) if len(raw) <= SCANNED else self._merged(raw))

    def _scanned(self, raw: bytes) -> list[int]:
        """The merges of a short piece: the lowest rank is looked for again after each."""
        rank = self.ranks.get
        none = len(self.ranks)
        part = [raw[i : i + 1] for i in range(len(raw))]
        pair = [rank(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pair and (low := min(pair)) < none:
            i = pair.index(low)
            part[i] = both = part[i] + part[i + 1]
            del part[i + 1], pair[i]
            if i:
                pair[i - 1] = rank(part[i - 1] + both, none)
            if i < len(pair):
                pair[i] = rank(both + part[i + 1], none)
        return [self.ranks[p] for p in part]

    def _merged(self, raw: bytes) -> list[int]:
        """Merges the adjacent pair of lowest rank, the leftmost of equals, until none is left."""
        n, ranks = len(raw), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        part: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        heap = [(r, i, raw[i : i + 2]) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or part[i] + part[j] != pair:
                continue
            part[i], part[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(both := pair + part[k])) is not None:
                    heapq.heappush(heap, (r, i, both))
            if (h := before[i]) >= 0 and (r := ranks.get(both := part[h] + pair)) is not None:
                heapq.heappush(heap, (r, h, both))
        return [ranks[p] for p in part if p is not None]

    def encode(self, pieces: list[str]) -> list[int]:
        known = self.known
        for p in set(pieces):
            if p not in known:
                known[p] = self.piece(p)
        out = list(chain.from_iterable([known[p] for p in pieces]))
        if len(known) > CACHE:
            known.clear()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Digest:
    """Running digests of one document's ids and decoded bytes."""

    def __init__(self, coder: Coder):
        self.coder, self.n = coder, 0
        self.ids, self.raw = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: list[int]) -> None:
        if ids:
            self.ids.update((" " * bool(self.n) + " ".join(map(self.coder.decimal.__getitem__, ids))).encode())
            self.raw.update(self.coder.decode(ids))
            self.n += len(ids)

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.raw.hexdigest()


_READY: dict = {}


def _ready(path: str, source: str) -> tuple[Coder, Splitter]:
    if (path, source) not in _READY:
        _READY[path, source] = Coder(path), Splitter(source)
    return _READY[path, source]


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
SPARK_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def stitched(parts: Iterator[tuple[int, str, list[int], bool]], split: Splitter) -> Iterator[list[str]]:
    """Pieces, a list for each agreed stretch, of one document's chunks in order.

    Each chunk is (start, text, ends of its matches, is it the last). What is
    carried from one chunk to the next is the text since the last agreed place.
    """
    held, at, ends, matched = "", 0, [], 0  # unspent text, where it starts, absolute ends of matches in its first ``matched`` characters

    def pieces(until: list[int]) -> list[str]:
        places = [at, *until]
        return [held[a - at : b - at] for a, b in zip(places, places[1:], strict=False)]

    for start, text, own, last in parts:
        mine = [start + e for e in own]
        if not held:
            held, at, ends, matched = text, start, mine, len(text)
        else:
            both = {start, *mine}
            agreed = next((e for e in ends if start <= e <= at + matched - LOOKAHEAD and e in both), None)
            if agreed is not None:
                yield pieces([e for e in ends if e <= agreed])
                held, at, ends = text[agreed - start :], agreed, [e for e in mine if e > agreed]
                matched = len(held)
            else:
                held += text[at + len(held) - start :]
                if last or len(held) >= 2 * matched:  # at each doubling, so that one endless pre-token costs no square
                    ends = [at + e for e in split.ends(held)]
                    matched = len(held)
        if last:
            yield pieces(ends)
            held = ""


def short_documents(path: str, source: str):
    """(doc_id, its id lists) for each row of batches with doc_id and text."""

    def read(batches: Iterator[pa.RecordBatch]):
        coder, split = _ready(path, source)
        for batch in batches:
            for doc, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text"), strict=True):
                yield coder, doc, [coder.encode(split(text.as_py() or ""))]

    return read


def long_documents(path: str, source: str):
    """The same for batches of chunks, which come in order of (doc_row, part)."""

    def read(batches: Iterator[pa.RecordBatch]):
        coder, split = _ready(path, source)
        names = ("doc_id", "doc_row", "start", "text", "ends", "last")
        rows = (tuple(x.as_py() for x in row) for batch in batches for row in zip(*(column(batch, c) for c in names), strict=True))
        for (doc, _), own in groupby(rows, key=lambda r: r[:2]):
            yield coder, doc, (coder.encode(p) for p in stitched((r[2:] for r in own), split))

    return read


_CHUNK = "doc_id long, doc_row long, part long, start long, text string, last boolean"
_CHUNK_ARROW = pa.schema([("doc_id", pa.int64()), ("doc_row", pa.int64()), ("part", pa.int64()), ("start", pa.int64()), ("text", pa.string()), ("last", pa.bool_())])


def matched_chunks(long: DataFrame, source: str, chunk: int, overlap: int) -> DataFrame:
    """Chunks of long documents with the ends of their matches; each document's stand in order in one partition."""

    def cutter(batches):
        for batch in batches:
            for doc, row, text in zip(*(column(batch, c) for c in ("doc_id", "doc_row", "text")), strict=True):
                whole = text.as_py()
                for k, start in enumerate(range(0, len(whole), chunk)):
                    yield record_batch(_CHUNK_ARROW, [doc.as_py()], [row.as_py()], [k], [start], [whole[start : start + chunk + overlap]], [start + chunk >= len(whole)])

    def matcher(batches):
        split, schema = Splitter(source), _CHUNK_ARROW.append(pa.field("ends", pa.list_(pa.int32())))
        for batch in batches:
            yield record_batch(schema, *batch.columns, [split.ends(t.as_py()) for t in column(batch, "text")])

    rows = long.select("doc_id", F.monotonically_increasing_id().alias("doc_row"), "text")  # keeps repeated doc_ids apart
    spread = rows.mapInArrow(tidy(cutter), _CHUNK).repartition("doc_row", "part")
    return spread.mapInArrow(tidy(matcher), _CHUNK + ", ends array<int>").repartition("doc_row").sortWithinPartitions("doc_row", "part")


def _each(docs: DataFrame, make, schema: pa.Schema, spark_schema: str, path: str, source: str, chunk: int, overlap: int) -> DataFrame:
    """``make(coder, id lists)`` gives each document's columns after doc_id."""

    def task(reader):
        def run(batches):
            held: list[tuple] = []
            for coder, doc, lists in reader(batches):
                held.append((doc, *make(coder, lists)))
                if len(held) >= 500:
                    yield record_batch(schema, *map(list, zip(*held, strict=True)))
                    held = []
            if held:
                yield record_batch(schema, *map(list, zip(*held, strict=True)))

        return tidy(run)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = rows.where(~is_long).mapInArrow(task(short_documents(path, source)), spark_schema)
    return short.unionByName(matched_chunks(rows.where(is_long), source, chunk, overlap).mapInArrow(task(long_documents(path, source)), spark_schema))


def encode(docs: DataFrame, path: str | None = None, source: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids (array of int) of every document; null text gives no ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _each(docs, lambda coder, lists: (list(chain.from_iterable(lists)),), schema, "doc_id long, ids array<int>", path or vocabulary_path(), source or pattern(), chunk, overlap)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and raw (the bytes that the ids stand for, joined)."""
    path, source = path or vocabulary_path(), pattern()

    def run(batches):
        coder, _ = _ready(path, source)
        for batch in batches:
            yield record_batch(pa.schema([("doc_id", pa.int64()), ("raw", pa.binary())]), column(batch, "doc_id"), [coder.decode(x.as_py() or []) for x in column(batch, "ids")])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def digests(docs: DataFrame, path: str | None = None, source: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """n_tokens, the digest of the ids and that of the bytes decoded from them, of every document."""

    def make(coder, lists):
        out = Digest(coder)
        for ids in lists:
            out.add(ids)
        return out.row()

    return _each(docs, make, OUT, SPARK_OUT, path or vocabulary_path(), source or pattern(), chunk, overlap)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: encoded, digested, decoded and digested again."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_bpe": op7_bpe}
ORACLES: dict[str, str] = {}

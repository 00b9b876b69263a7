"""Operator 3: WARC archives with a two-level capture index.

Pages are ordered by their reversed-host URL key and written by range into
archives, a gzip member a record. Equal payloads are found by digest; the record
of the smallest page_id holds the payload, the others are revisits of it. The
index has two levels: sorted entries in compressed blocks, and a sparse directory
with each block's first key. It is written in parts, by range of keys, each a file
of blocks with their directory behind them; the list of parts is as long as the
number of partitions and goes to every task.

A look-up bisects the parts and the part's directory, reads one block by range,
bisects its entries and reads the record by range. Look-ups of a whole table are
sorted by key first, so a task reads each block and archive of its range once.

Archives and index parts are files in the shared folder, on any file system that
Arrow opens. Each task writes under a name of its own and the index lists only
what successful tasks wrote, so a task that is run again leaves one good copy.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .batches import column, record_batch

MIN_BYTES, BLOCK_ENTRIES, ARCHIVE_ROWS, LEVEL = 0, 512, 20_000, 1
#: A digest that more than 1 / HOT_SHARE of all rows have is looked up by broadcast (so at most HOT_SHARE of them are).
HOT_SHARE = 500
#: WARC 1.1 lines that hold for every record.
VERSION, DATE = "WARC/1.1", "1970-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """The host's labels reversed and comma-joined, then ``)`` and the rest, in lower case without scheme, user, ``www`` and default port."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/?#]*)", 1), r"^.*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\d*\.", "")
    rest = F.regexp_replace(F.regexp_replace(bare, r"^[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _records(pages: DataFrame, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """page_id, url, key, html, sha1 (hex) and refers_to (null for responses) of every page; and the written table of repeated digests that they are read from."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), url_key(F.col("url")).alias("key"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha1"))
    large = F.octet_length("html") >= min_bytes
    copies = rows.where(large).select("page_id", "sha1").groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    copies = store.written(copies, "copies")
    total = rows.select("page_id").count()
    hot = F.col("n") * HOT_SHARE > total
    first = rows.join(F.broadcast(copies.where(hot).select("sha1", F.col("first_id").alias("hot_id"))), "sha1", "left")
    # A hot digest's rows take no part in the shuffled look-up: their key is their own page_id.
    probe = F.when(F.col("hot_id").isNull() & large, F.col("sha1")).otherwise(F.concat(F.lit("-"), F.col("page_id").cast("string")))
    first = first.withColumn("probe", probe).join(copies.where(~hot).select(F.col("sha1").alias("probe"), "first_id"), "probe", "left")
    refers = F.when(large, F.coalesce("hot_id", "first_id"))
    return first.select("page_id", "url", "key", "html", "sha1", F.when(refers != F.col("page_id"), refers).alias("refers_to")), copies


def _head(kind: str, page_id: int, url: str, digest: str, refers_to: int | None, payload: int) -> list[str]:
    out = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {json.dumps(url)[1:-1]}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {payload}"]
    if refers_to is not None:
        out += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return out


def record(page_id: int, url: str, html: str, sha1: str, refers_to: int | None) -> bytes:
    """One WARC record: an HTTP response with the payload, or a revisit with its head alone."""
    payload = html.encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = _head("response" if refers_to is None else "revisit", page_id, url, base32(sha1), refers_to, len(payload))
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """What a record says, with its payload where it has one (a response's length and digest are taken from the payload itself)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    number = lambda k: int(re.fullmatch(r"<urn:page:(-?\d*)>", fields[k])[1] or 0) if fields[k] != "<urn:page:>" else None
    out = {"page_id": number("WARC-Record-ID"), "url": json.loads(f'"{fields["WARC-Target-URI"]}"'), "record_type": fields["WARC-Type"]}
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if out["record_type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest != said:
            raise ValueError(f"page {out['page_id']}: the payload isn't what its digest says")
        return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest, "refers_to": None}
    return out | {"payload": None, "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": said, "refers_to": number("WARC-Refers-To")}


class _Writer:
    """A new file of a name of its own in a folder, opened with the first write."""

    def __init__(self, folder: str, name: str):
        self.url, self.out, self.at = f"{folder}/{name}-{uuid.uuid4().hex}", None, 0

    def write(self, data: bytes) -> tuple[int, int]:
        """Offset and length of what was written."""
        if self.out is None:
            system, path = fs.FileSystem.from_uri(self.url)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self.out = system.open_output_stream(path, compression=None, buffer_size=1 << 20)
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return at, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


class _Reader:
    """Ranges of files; the file read last stays open."""

    def __init__(self):
        self.url, self.file = None, None

    def range(self, url: str, at: int, length: int) -> bytes:
        if url != self.url:
            self.close()
            system, path = fs.FileSystem.from_uri(url)
            self.url, self.file = url, system.open_input_file(path)
        self.file.seek(at)
        return self.file.read(length)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.url, self.file = None, None


_ENTRY = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_ENTRY_SQL = "key string, page_id long, archive string, offset long, length long"
_PART = pa.schema([("first_key", pa.string()), ("first_id", pa.int64()), ("last_key", pa.string()), ("last_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("blocks", pa.int64()), ("entries", pa.int64())])
_PART_SQL = "first_key string, first_id long, last_key string, last_id long, file string, offset long, length long, blocks long, entries long"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, archive_rows: int = ARCHIVE_ROWS) -> DataFrame:
    """Writes every page's record and gives the index entries (key, page_id, archive, offset, length).

    Null html is an empty payload, a null url an empty one; rows of one page_id are records of their own.
    """
    rows, copies = _records(pages, min_bytes)
    n = max(1, -(-pages.select("page_id").count() // archive_rows))
    ranged = rows.repartitionByRange(max(n, 2 * pages.sparkSession.sparkContext.defaultParallelism), "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]):
        out, found = _Writer(folder, "archive"), []
        for batch in batches:
            for key, *row in zip(*(column(batch, c).to_pylist() for c in ("key", "page_id", "url", "html", "sha1", "refers_to")), strict=True):
                found.append((key, row[0], *out.write(gzip.compress(record(*row), LEVEL, mtime=0))))
        out.close()
        if found:
            keys, ids, at, length = map(list, zip(*found, strict=True))
            yield record_batch(_ENTRY, keys, ids, [out.url] * len(keys), at, length)

    entries = store.written(ranged.mapInArrow(run, _ENTRY_SQL), "entries")
    store.drop(copies)
    return entries


def _place(key: str, page_id: int | None) -> tuple[str, bool, int]:
    """How the index orders captures: by key, then page_id, null first."""
    return key, page_id is not None, page_id or 0


def _packed(rows: list) -> bytes:
    return zlib.compress("\n".join(map(json.dumps, rows)).encode(), LEVEL)


def _unpacked(raw: bytes) -> list[list]:
    return [json.loads(line) for line in zlib.decompress(raw).decode().split("\n")]


def write_index(entries: DataFrame, folder: str, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Writes the sorted entries in compressed blocks with a sparse directory behind them and gives the list of parts, one row for each partition that has entries."""

    def run(batches: Iterator[pa.RecordBatch]):
        out, held, directory, n = _Writer(folder, "index"), [], [], 0
        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(entry)
                if len(held) >= block_entries:
                    directory.append([*held[0][:2], *out.write(_packed(held))])
                    n, last, held = n + len(held), held[-1], []
        if held:
            directory.append([*held[0][:2], *out.write(_packed(held))])
            n, last = n + len(held), held[-1]
        if directory:
            at, length = out.write(_packed(directory))
            yield record_batch(_PART, *([x] for x in (*directory[0][:2], *last[:2], out.url, at, length, len(directory), n)))
        out.close()

    ordered = entries.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return store.written(ordered.select("key", "page_id", "archive", "offset", "length").mapInArrow(run, _PART_SQL), "parts")


class Index:
    """Look-ups by bisection: of the parts, of a part's directory, of a block. The directory and block read last are kept."""

    def __init__(self, parts: list[tuple]):
        self.parts = sorted(parts, key=lambda p: _place(*p[:2]))
        self.last = [_place(*p[2:4]) for p in self.parts]
        self.reader, self.archives = _Reader(), _Reader()
        self._directory: tuple = (None, [], [])
        self._block: tuple = (None, [])

    def _blocks(self, part: tuple) -> tuple[list[tuple], list[list]]:
        if self._directory[0] != part[4]:
            rows = _unpacked(self.reader.range(*part[4:7]))
            self._directory = part[4], [_place(*r[:2]) for r in rows], rows
        return self._directory[1:]

    def _entries(self, file: str, at: int, length: int) -> list[list]:
        if self._block[0] != (file, at):
            self._block = (file, at), _unpacked(self.reader.range(file, at, length))
        return self._block[1]

    def between(self, low: tuple, high: tuple) -> Iterator[list]:
        """Entries (key, page_id, archive, offset, length) from place ``low`` to ``high``, both included."""
        p = bisect.bisect_left(self.last, low)
        while p < len(self.parts) and _place(*self.parts[p][:2]) <= high:
            first, rows = self._blocks(self.parts[p])
            b = max(0, bisect.bisect_left(first, low) - 1)
            while b < len(rows) and first[b] <= high:
                entries = self._entries(self.parts[p][4], *rows[b][2:4])
                i = bisect.bisect_left(entries, low, key=lambda e: _place(*e[:2]))
                while i < len(entries) and _place(*entries[i][:2]) <= high:
                    yield entries[i]
                    i += 1
                b += 1
            p += 1

    def read(self, entry: list) -> dict:
        """The record of an entry, by its range in its archive."""
        return parsed(gzip.decompress(self.archives.range(*entry[2:])))

    def find(self, key: str) -> list[dict]:
        """All records under one URL key, in order of page_id."""
        return [self.read(e) for e in self.between((key, False, 0), (key, True, 1 << 63))]

    def close(self) -> None:
        self.reader.close()
        self.archives.close()


def lookup(parts: DataFrame, key: str) -> list[dict]:
    """All records under one URL key."""
    index = Index([tuple(r) for r in parts.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).collect()])
    try:
        return index.find(key)
    finally:
        index.close()


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_READ_SQL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def fetch(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """The records of ``pages`` (page_id, url), each looked up in the index by its key and page_id.

    Requests are dealt out by range and sorted; equal ones are neighbours and
    asked once, and one that repeated pages share gives all their records. A page
    without a record is an error.
    """
    sent = pages.sparkSession.sparkContext.broadcast([tuple(r) for r in parts.collect()])  # a row for each partition of the index

    def run(batches: Iterator[pa.RecordBatch]):
        index, before = Index(sent.value), None
        for batch in batches:
            found = []
            for request in zip(column(batch, "key").to_pylist(), column(batch, "page_id").to_pylist(), strict=True):
                if request == before:
                    continue
                before, place, some = request, _place(*request), False
                for entry in index.between(place, place):
                    got, some = index.read(entry), True
                    if got["page_id"] != request[1]:
                        raise ValueError(f"{entry[2]}, {entry[3]}: page {got['page_id']} where the index has {request[1]}")
                    found.append([got[f.name] for f in _READ])
                if not some:
                    raise ValueError(f"page {request[1]}: no record under {request[0]}")
            if found:
                yield record_batch(_READ, *map(list, zip(*found, strict=True)))
        index.close()

    wanted = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"))
    return wanted.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, _READ_SQL)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages``: written as archives with their index, then every page looked up in it. The archives go when all are read."""
    folder = store.fresh(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    entries = write_archives(pages, folder)
    parts = write_index(entries, folder)
    found = store.written(fetch(pages, parts).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "found")
    store.drop(entries)
    store.drop(parts)
    store.remove(spark, folder)
    return found


#: The same from the table alone; each base-32 digit is five bits of the hexadecimal digest.
_SQL = """
WITH p AS (SELECT page_id::BIGINT AS page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, ''))::BIGINT AS first_id FROM pages), h AS (SELECT *, sha1(html) || '0' AS x FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (5 * i // 4 + 1)::INT, 3))::INT >> (7 - (5 * i) % 4)::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM h
"""

QUERIES = {"op3_warc": op3_warc}
ORACLES = {"op3_warc": _SQL}

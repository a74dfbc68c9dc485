"""Operator 1: WARC records and a two-level capture index.

Pages are written as WARC response records, each a gzip member of its own, so
that a record can be read by offset and length. A capture is indexed under a
key that begins with the reversed host (`com,example)/path?query`), so that one
host, and one domain, is one range of keys. Captures are sorted by key and cut
into compressed blocks; every index file ends with a sparse directory that holds
the first key, the offset and the length of its blocks. A lookup finds the file
by the first keys of the files, the block by binary search in the directory,
reads that block's bytes only, searches in it, and reads the record's bytes.

Defined results. The key drops scheme, user, fragment and the ports 80 and 443,
and lower-cases the host; an empty path is `/`; a text without `//` is taken
as it is, without fragment. A page without url has no capture. A null html is an
empty record. Rows that repeat a page or a url are captures each, in order of
key, page_id (nulls first) and place. An unknown key finds nothing. Other
columns are never read. An empty table gives an empty index and empty results.

Scale. Building is one range shuffle of short rows; html is compressed where it
is read and never shuffled. All captures of a key are in one file, and a key may
fill any number of blocks. Looking up shuffles the keys to the files that hold them,
so nothing that grows with the data is broadcast: tasks know only the first key of
each file. What is found are places of records, short rows; these are dealt out by
file and stretch of file, in as many tasks as the bytes of the records call for, and
there the records are read, so that a hot key's are not one task's. Files of failed attempts are never
referred to, since names and offsets come from the written table.
"""

from __future__ import annotations

import bisect
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _store

BLOCK = 256
#: Records go to a new file once this many bytes are reached.
FILE_BYTES = 256 << 20
#: Neighbouring records of so many bytes are read by one task, and a task reads about as many as TASK_BYTES.
STRETCH, TASK_BYTES = 4 << 20, 64 << 20
_CAPTURE = "_key binary, _id long, _file string, _offset long, _length long"
_PARTS = "_part int, _first binary, _index string"


def url_key(url: Column) -> Column:
    """The sort key of a url: reversed host, then path and query."""
    plain = F.regexp_replace(url, "#.*$", "")
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?@]*@)?([^/?:]*)(:[0-9]*)?(.*)$"
    part = lambda i: F.regexp_extract(plain, pattern, i)
    host = F.array_join(F.reverse(F.split(F.lower(part(1)), r"\.")), ",")
    port = F.when(part(2).isin(":", ":80", ":443"), "").otherwise(part(2))
    rest = F.when(part(3).startswith("/"), part(3)).otherwise(F.concat(F.lit("/"), part(3)))
    return F.when(plain.rlike(pattern), F.concat(host, port, F.lit(")"), rest)).otherwise(plain)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else f"file://{uri}")


class _Out:
    """A file in the shared folder that knows its length."""

    def __init__(self, folder: str, kind: str):
        self.name, self.at = f"{folder}/{kind}-{uuid.uuid4().hex}", 0
        fs, path = _open(self.name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.to = fs.open_output_stream(path)

    def put(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.to.write(data)
        self.at += len(data)
        return at, len(data)

    def close(self) -> None:
        self.to.close()


def record(url: str, page_id: int | None, html: str | None) -> bytes:
    """One gzip member with a WARC response record."""
    body = (html or "").encode("utf-8", "replace")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Target-URI: {url}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(http) + len(body)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode("utf-8", "replace") + http + body + b"\r\n\r\n") + pack.flush()


def payload(member: bytes) -> bytes:
    """The HTTP body of a record as record() wrote it, or of any WARC response record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    size = next(int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return rest[:size].partition(b"\r\n\r\n")[2]


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            rows = []
            for key, page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None or out.at >= FILE_BYTES:
                    if out:
                        out.close()
                    out = _Out(folder, "warc")
                offset, length = out.put(record(url, page_id, html))
                rows.append((key, page_id, out.name, offset, length))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["_key", "_id", "_file", "_offset", "_length"])
        if out:
            out.close()

    return run


def write(pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files; the captures (_key, _id, _file, _offset, _length)."""
    plain = _store.pick(pages, _id="page_id", _url="url", _html="html").where("_url is not null")
    plain = plain.select(url_key(F.col("_url")).cast("binary").alias("_key"), F.col("_id").cast("long").alias("_id"), "_url", "_html")
    return _store.keep(_store.arrow(plain, _write(_store.new_path(pages.sparkSession, "warc")), _CAPTURE), "captures")


def _blocks(folder: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, lines, keys = None, [], [], []

        def flush() -> None:
            directory.append([keys[0].hex(), *out.put(zlib.compress("\n".join(lines).encode()))])
            lines.clear()
            keys.clear()

        for batch in batches:
            for key, page_id, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                out = out or _Out(folder, "index")
                keys.append(key)
                lines.append(json.dumps([key.hex(), page_id, file, offset, length]))
                if len(lines) == block:
                    flush()
        if out:
            if lines:
                flush()
            at, n = out.put(zlib.compress(json.dumps(directory).encode()))
            out.put(at.to_bytes(8, "big") + n.to_bytes(8, "big"))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([bytes.fromhex(directory[0][0])], pa.binary()), pa.array([out.name])], names=["_first", "_index"])

    return run


class Index(NamedTuple):
    """First keys of the index files, ascending, and their names."""

    first: list[bytes]
    files: list[str]
    #: Bytes of the records.
    n_bytes: int = 0


def build(captures: DataFrame, block: int = BLOCK) -> Index:
    """Sort captures and write the index files."""
    spark = captures.sparkSession
    ordered = captures.repartitionByRange("_key").sortWithinPartitions("_key", F.col("_id").asc_nulls_first(), "_file", "_offset")
    parts = _store.keep(_store.arrow(ordered, _blocks(_store.new_path(spark, "index"), block), "_first binary, _index string"), "parts")
    rows = sorted((bytes(r[0]), r[1]) for r in parts.collect())  # one row an index file
    return Index([r[0] for r in rows], [r[1] for r in rows], captures.agg(F.sum("_length")).first()[0] or 0)


class Reader:
    """Lookups in one index file; the last block read is kept."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        at, n = int.from_bytes(tail[:8], "big"), int.from_bytes(tail[8:], "big")
        self.directory = json.loads(zlib.decompress(self.file.read_at(n, at)))
        self.first = [bytes.fromhex(x[0]) for x in self.directory]
        self.kept: tuple[int, list[bytes], list] = (-1, [], [])
        self.reads = 0

    def block(self, i: int) -> tuple[list[bytes], list]:
        if self.kept[0] != i:
            _, at, n = self.directory[i]
            rows = [json.loads(x) for x in zlib.decompress(self.file.read_at(n, at)).decode().split("\n")]
            self.kept = i, [bytes.fromhex(r[0]) for r in rows], rows
            self.reads += 1
        return self.kept[1:]

    def find(self, key: bytes) -> Iterator[list]:
        """[key, page_id, file, offset, length] of every capture of a key."""
        i = max(0, bisect.bisect_left(self.first, key) - 1)  # the block before may end with the key
        while i < len(self.first) and self.first[i] <= key:
            keys, rows = self.block(i)
            yield from rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
            i += 1


def _place(first: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [max(0, bisect.bisect_right(first, k) - 1) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part, pa.int32())], names=["_key", "_part"])

    return run


def _find(files: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, reader, rows = -1, None, []
        for batch in batches:
            for key, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part:
                    part, reader = p, Reader(files[p])
                for _, page_id, file, offset, length in reader.find(key):
                    rows.append((key, page_id, file, offset, length))
                    if len(rows) == 4096:
                        yield _rows(rows, 5)
                        rows = []
        yield _rows(rows, 5)

    return run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of places in order of file and offset; a batch holds no more than STRETCH bytes and a record."""
    name, source = None, io.BytesIO()
    for batch in batches:
        rows, size = [], 0
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if row[2] != name:
                fs, path = _open(row[2])
                name, source = row[2], fs.open_input_file(path)
            rows.append((*row, payload(source.read_at(row[4], row[3]))))
            size += len(rows[-1][5])
            if size >= STRETCH:
                yield _rows(rows, 6)
                rows, size = [], 0
        yield _rows(rows, 6)


def _rows(rows: list[tuple], n: int) -> pa.RecordBatch:
    kinds, names = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), ["_key", "_id", "_file", "_offset", "_length", "_body"]
    cols = list(zip(*rows, strict=True)) or [[]] * n
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds[:n], strict=True)], names=names[:n])


def places(keys: DataFrame, index: Index) -> DataFrame:
    """(url_key, page_id, file, offset, length): all captures of each distinct key of the column url_key."""
    spark: SparkSession = keys.sparkSession
    if not index.files:
        return spark.createDataFrame([], "url_key string, page_id long, file string, offset long, length long")
    wanted = keys.select(F.col("`url_key`").cast("binary").alias("_key")).where("_key is not null").distinct()
    placed = _store.arrow(wanted, _place(index.first), "_key binary, _part int")
    grouped = placed.repartition(len(index.files), "_part").sortWithinPartitions("_part", "_key")
    found = _store.arrow(grouped, _find(index.files), _CAPTURE)
    return found.select(F.col("_key").cast("string").alias("url_key"), F.col("_id").alias("page_id"), F.col("_file").alias("file"), F.col("_offset").alias("offset"), F.col("_length").alias("length"))


def fetch(found: DataFrame, index: Index) -> DataFrame:
    """The places of `places` with body, the record's payload."""
    parallel = 2 * found.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-index.n_bytes // TASK_BYTES), min(parallel, -(-index.n_bytes // STRETCH)))
    short = found.select(F.col("url_key").cast("binary").alias("_key"), F.col("page_id").alias("_id"), F.col("file").alias("_file"), F.col("offset").alias("_offset"), F.col("length").alias("_length"))
    dealt = short.repartition(n, "_file", F.floor(F.col("_offset") / STRETCH)).sortWithinPartitions("_file", "_offset")
    read = _store.arrow(dealt, _fetch, _CAPTURE + ", _body binary")
    return read.select(F.col("_key").cast("string").alias("url_key"), F.col("_id").alias("page_id"), F.col("_file").alias("file"), F.col("_offset").alias("offset"), F.col("_length").alias("length"), F.col("_body").alias("body"))


def lookup(keys: DataFrame, index: Index) -> DataFrame:
    """(url_key, page_id, file, offset, length, body): all captures of each distinct key of the column url_key with their records' payloads."""
    return fetch(places(keys, index), index)


#: DuckDB: what looking up every url must bring back.
ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, html, regexp_replace(url, '#.*$', '') AS u FROM pages WHERE url IS NOT NULL
), x AS (
  SELECT page_id, html, u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?@]*@)?([^/?:]*)(:[0-9]*)?(.*)$' AS re FROM p
), k AS (
  SELECT page_id, html, CASE WHEN regexp_matches(u, re) THEN
    array_to_string(list_reverse(string_split(lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?@]*@)?([^/?:]*)(:[0-9]*)?(.*)$', 1)), '.')), ',')
    || CASE WHEN regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?@]*@)?([^/?:]*)(:[0-9]*)?(.*)$', 2) IN ('', ':', ':80', ':443') THEN '' ELSE regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?@]*@)?([^/?:]*)(:[0-9]*)?(.*)$', 2) END
    || ')' || CASE WHEN starts_with(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?@]*@)?([^/?:]*)(:[0-9]*)?(.*)$', 3), '/') THEN '' ELSE '/' END || regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?@]*@)?([^/?:]*)(:[0-9]*)?(.*)$', 3)
    ELSE u END AS url_key FROM x
)
SELECT url_key, page_id, strlen(coalesce(html, ''))::BIGINT AS n_bytes, md5(coalesce(html, '')) AS body_md5, count(*) OVER (PARTITION BY url_key) AS n_captures FROM k
"""

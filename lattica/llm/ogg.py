"""Operator 7: Ogg media columns.

A binary column that holds Ogg files is taken apart: pages are found by their
capture pattern and checked by their CRC, packets are put together from the
lacing values across pages, the logical streams of a file are told apart by
serial number, and granule positions become times by the clock of the stream's
codec (Vorbis, Opus, Speex, FLAC, Theora; else `rate`).

Defined results. A page that fails its checksum, is cut off or lies outside the
framing is counted as bad and skipped; parsing goes on at the next capture
pattern. A packet that a missing or bad page interrupts is dropped and counted
as lost. Of several packets that end on a page the last has the page's granule
position, the ones before it are placed evenly between it and that of the page
before, or have no time if that page is missing; headers have time 0, a page without
position (-1) gives no times. A page that begins a stream, or follows the end of one,
begins a new one even if its serial number was seen before (chained files). After
missing pages, headers are what says so itself on a page of position 0; all else is
payload. A stream whose first packet is missing has no codec and no times. A gap counts
as one lost packet if it interrupts any. A null
or empty value, or one without a page, has no packets. Repeated rows are parsed
each, other columns are never read, an empty table gives an empty result.

Scale. One pass over a file in the task that reads it, without shuffle; the
checksum of a page is one call of zlib on the bit-reversed bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store

_REV = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
_HEADER = re.compile(rb"OpusHead|OpusTags|[\x01\x03\x05]vorbis|[\x80-\x82]theora")
CONTINUED, FIRST, LAST = 1, 2, 4
RATE, PACKET, SEGMENTS, PRESKIP, FRAME, FORMS = 1000, 3000, 32, 312, 960, 10
OPUS = (b"OpusHead\x01\x01" + struct.pack("<HIhB", PRESKIP, 48000, 0, 0), b"OpusTags" + bytes(8))
VORBIS = (b"\x01vorbis" + struct.pack("<IBIiiiBB", 0, 1, 44100, 0, 0, 0, 0xB8, 1), b"\x03vorbis", b"\x05vorbis")
#: Bytes of packets() that go out at once, about.
BATCH = 1 << 22


def crc(page: bytes) -> int:
    """The Ogg checksum (polynomial 04c11db7, not reflected, from 0) of a page whose checksum field is 0."""
    mirrored = zlib.crc32(page.translate(_REV), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REV), "big")


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    sum_ = crc(head + lacing + body)
    return head[:22] + sum_.to_bytes(4, "little") + head[26:] + lacing + body


def pages_of(serial: int, packets: Sequence[tuple[bytes, int]], headers: int = 1, segments: int = SEGMENTS) -> list[bytes]:
    """Pages of a logical stream. packets: bytes and granule position; each of the first `headers` has a page of its own, others share pages of at most `segments` lacing values."""
    out: list[bytes] = []
    lacing, body, granule, flags = bytearray(), bytearray(), -1, 0

    def flush(last: bool = False, open_: bool = False) -> None:
        nonlocal granule, flags
        out.append(page(serial, len(out), granule, flags | (0 if out else FIRST) | (LAST if last else 0), bytes(lacing), bytes(body)))
        lacing.clear()
        body.clear()
        granule, flags = -1, CONTINUED if open_ else 0

    for i, (data, at) in enumerate(packets):
        size = bytes([255]) * (len(data) // 255) + bytes([len(data) % 255])
        done = 0
        for j, s in enumerate(size):
            if len(lacing) == segments:
                flush(open_=j > 0)
            lacing.append(s)
            body += data[done : done + s]
            done += s
        granule = at
        if i < headers:
            flush(last=i == len(packets) - 1)
    if lacing:
        flush(last=True)
    return out


@dataclass
class Stream:
    serial: int
    codec: str = ""
    rate: float = 0.0
    skip: int = 0
    shift: int = -1
    headers: int = 1
    next_number: int = -1
    before: int | None = 0
    torn: bool = False
    ended: bool = False
    part: bytearray | None = None
    packets: list[tuple[bytes, int, float | None]] = field(default_factory=list)
    lost: int = 0
    n_pages: int = 0

    def open(self, head: bytes, rate: float) -> None:
        """Codec and clock from the first packet, if that is there."""
        self.rate, self.headers = (0, 3) if self.torn else (rate, 1)
        if head[:7] == b"\x01vorbis" and len(head) >= 16:
            self.codec, self.rate, self.headers = "vorbis", struct.unpack_from("<I", head, 12)[0], 3
        elif head[:8] == b"OpusHead" and len(head) >= 12:
            self.codec, self.rate, self.skip, self.headers = "opus", 48000, struct.unpack_from("<H", head, 10)[0], 2
        elif head[:8] == b"Speex   " and len(head) >= 40:
            self.codec, self.rate, self.headers = "speex", struct.unpack_from("<I", head, 36)[0], 2
        elif head[:5] == b"\x7fFLAC" and len(head) >= 30:
            self.codec, self.rate, self.headers = "flac", int.from_bytes(head[27:30], "big") >> 4, 1 + int.from_bytes(head[7:9], "big")
        elif head[:7] == b"\x80theora" and len(head) >= 42:
            up, down = struct.unpack_from(">II", head, 22)
            self.codec, self.rate, self.headers, self.shift = "theora", up / max(1, down), 3, (int.from_bytes(head[40:42], "big") >> 5) & 31
        self.torn = self.torn and not self.codec

    def is_header(self, packet: bytes, granule: int) -> bool:
        """Of a packet among the first ones; their number says nothing once pages are missing."""
        if not self.torn:
            return True
        return granule == 0 and (packet[:1] != b"\xff" if self.codec == "flac" else bool(_HEADER.match(packet)))

    def seconds(self, granule: float) -> float | None:
        if not self.rate:
            return None
        if self.shift >= 0:
            granule = (int(granule) >> self.shift) + (int(granule) & ((1 << self.shift) - 1))
        return max(0.0, (granule - self.skip) / self.rate)


def parse(data: bytes | None, rate: float = RATE) -> tuple[list[Stream], int]:
    """The logical streams of a file, in order of appearance, and the number of bad pages."""
    data = data or b""
    streams: dict[int, Stream] = {}
    found: list[Stream] = []
    bad, at, size = 0, 0, len(data)
    while at < size:
        start = data.find(b"OggS", at)
        if start != at:
            bad += 1  # bytes outside the framing
            if start < 0:
                break
            at = start
        end = -1
        if size - at >= 27:
            _, version, flags, granule, serial, number, sum_, n = _HEAD.unpack_from(data, at)
            lacing = data[at + 27 : at + 27 + n]
            end = at + 27 + n + sum(lacing)
            if version or len(lacing) < n or end > size or crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != sum_:
                end = -1
        if end < 0:
            after = data.find(b"OggS", at + 4)
            bad += 1
            at = size if after < 0 else after
            continue
        s = streams.get(serial)
        if s is None or s.ended or flags & FIRST:
            s = streams[serial] = Stream(serial)
            found.append(s)
        _take(s, number, flags, granule, lacing, data[at + 27 + n : end], rate)
        at = end
    for s in found:
        s.lost += s.part is not None
    return found, bad


def _take(s: Stream, number: int, flags: int, granule: int, lacing: bytes, body: bytes, rate: float) -> None:
    gap = number != s.next_number if s.n_pages else not flags & FIRST
    s.next_number, s.n_pages, s.ended = number + 1, s.n_pages + 1, bool(flags & LAST)
    if gap:
        s.torn, s.before = True, None
    broken = s.part is not None and (gap or not flags & CONTINUED)
    if broken:
        s.part = None
    skipping = bool(flags & CONTINUED) and s.part is None  # its beginning is missing
    s.lost += broken or skipping
    done, at = [], 0
    for size in lacing:
        piece = body[at : at + size]
        at += size
        if not skipping:
            if s.part is None:
                s.part = bytearray()
            s.part += piece
        if size < 255:
            if not skipping:
                done.append(bytes(s.part))
            s.part, skipping = None, False
    for i, packet in enumerate(done):
        first = len(s.packets)
        if not first:
            s.open(packet, rate)
        if first < s.headers and not s.is_header(packet, granule):
            s.headers = first
        when = None
        if first < s.headers:
            when = 0.0
        elif granule >= 0 and i == len(done) - 1:
            when = s.seconds(granule)
        elif granule >= 0 and s.before is not None:
            when = s.seconds(s.before + (granule - s.before) * (i + 1) / len(done))
        s.packets.append((packet, granule if i == len(done) - 1 else -1, when))
    if done and granule >= 0:
        s.before = granule


_PACKET = "id long, stream int, serial long, codec string, packet int, granule long, seconds double, data binary"


def packets(files: DataFrame, id_col: str, data_col: str, rate: float = RATE) -> DataFrame:
    """(id, stream, serial, codec, packet, granule, seconds, data): a row for every packet of every stream of every file."""

    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.binary())

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _PACKET.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, s in enumerate(parse(data.as_py(), rate)[0]):
                    rows += [(i, k, s.serial, s.codec or None, n, g if g >= 0 else None, t, p) for n, (p, g, t) in enumerate(s.packets)]
                    size += sum(len(p) for p, _, _ in s.packets)
                if size + 100 * len(rows) >= BATCH:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)

    return _store.arrow(_store.pick(files, _id=id_col, _data=data_col).withColumn("_id", F.col("_id").cast("long")), run, _PACKET)


_SUMMARY = "id long, n_streams int, n_pages long, n_bad int, n_lost int, n_packets long, n_bytes long, seconds double, md5 string"


def summary(files: DataFrame, id_col: str, data_col: str, rate: float = RATE) -> DataFrame:
    """A row for every file: streams, pages, bad pages, lost packets; packets, bytes, md5 and end of the payload of the first stream, without headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1):
                found, bad = parse(data.as_py(), rate)
                own = found[0].packets[found[0].headers :] if found else []
                sum_ = hashlib.md5(usedforsecurity=False)
                for p, _, _ in own:
                    sum_.update(p)
                rows.append((len(found), sum(s.n_pages for s in found), bad, sum(s.lost for s in found), len(own), sum(len(p) for p, _, _ in own), max((t for _, _, t in own if t is not None), default=0.0), sum_.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", "n_streams", "n_pages", "n_bad", "n_lost", "n_packets", "n_bytes", "seconds", "md5"])

    return _store.arrow(_store.pick(files, _id=id_col, _data=data_col).withColumn("_id", F.col("_id").cast("long")), run, _SUMMARY)


_STREAM = "id long, stream int, serial long, codec string, n_pages long, n_bad int, n_lost int, n_packets long, n_bytes long, seconds double, md5 string"


def streams(files: DataFrame, id_col: str, data_col: str, rate: float = RATE) -> DataFrame:
    """A row for every stream of every file: codec, pages, lost packets; packets, bytes, md5 and end of its payload, without headers; n_bad are the bad pages of the file. A file without stream has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, bad = parse(data.as_py(), rate)
                for k, s in enumerate(found):
                    own, sum_ = s.packets[s.headers :], hashlib.md5(usedforsecurity=False)
                    for p, _, _ in own:
                        sum_.update(p)
                    rows.append((id_, k, s.serial, s.codec or None, s.n_pages, bad, s.lost, len(own), sum(len(p) for p, _, _ in own), max((t for _, _, t in own if t is not None), default=0.0), sum_.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 11
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _STREAM.split(", ")])

    return _store.arrow(_store.pick(files, _id=id_col, _data=data_col).withColumn("_id", F.col("_id").cast("long")), run, _STREAM)


def from_text(text: str | None, note: str | None) -> bytes:
    """A file of two interleaved streams: the text's bytes as Opus packets of PACKET bytes and FRAME samples each, the note as a Vorbis packet."""
    raw = (text or "").encode("utf-8", "replace")
    own = [(raw[i : i + PACKET], PRESKIP + FRAME * (i // PACKET + 1)) for i in range(0, len(raw), PACKET)]
    a = pages_of(1, [*((p, 0) for p in OPUS), *own], 2)
    b = pages_of(2, [*((p, 0) for p in VORBIS), ((note or "").encode("utf-8", "replace"), 44100)], 3)
    out = []
    for i in range(max(len(a), len(b))):
        out += a[i : i + 1] + b[i : i + 1]
    return b"".join(out)


def damaged(data: bytes, form: int) -> bytes:
    """A file of from_text as it may come. 0: whole; 1: twice in a row; 2: amid other bytes; 9: cut off in its last page. With a wrong checksum in the page of: 3 OpusHead, 4 OpusTags, 5 the begin of the text, 7 either first packet, in the second of two copies, 8 the second Vorbis header. 6: without the second page of the text."""
    pages, at = [], 0
    while at < len(data):
        end = at + 27 + data[at + 26] + sum(data[at + 27 : at + 27 + data[at + 26]])
        pages.append((*struct.unpack_from("<II", data, at + 14), data[at:end]))
        at = end
    if form == 1:
        return data + data
    if form == 2:
        return b"before" + data + b"after"
    if form == 6:
        return b"".join(p for serial, number, p in pages if (serial, number) != (1, 3))
    if form == 9:
        return data[: len(data) - len(pages[-1][2]) + 20]
    bad = {3: [(1, 0)], 4: [(1, 1)], 5: [(1, 2)], 7: [(1, 0), (2, 0)], 8: [(2, 1)]}.get(form, [])
    spoiled = b"".join(p[:22] + bytes([p[22] ^ 1]) + p[23:] if (serial, number) in bad else p for serial, number, p in pages)
    return data + spoiled if form == 7 else spoiled


def text_files(docs: DataFrame, damage: bool = False) -> DataFrame:
    """(doc_id, media): the documents as Ogg files, since no table holds media; with damage, in the form that the rest of doc_id by FORMS says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [from_text(t.as_py(), n) for t, n in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            if damage:
                media = [damaged(m, (i or 0) % FORMS) for m, i in zip(media, batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    note: Column = F.concat_ws(" ", F.col("_source"), F.col("_lang"))
    return _store.arrow(_store.pick(docs, doc_id="doc_id", _text="text", _source="source", _lang="lang").select(F.col("doc_id").cast("long").alias("doc_id"), "_text", note.alias("_note")), run, "doc_id long, media binary")


#: DuckDB: what the round trip must bring back; pages follow from the lacing values.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n, md5(coalesce(text, '')) AS md5, concat_ws(' ', source, lang) AS note FROM documents
), s AS (
  SELECT *, (n + {PACKET} - 1) // {PACKET} AS packets, n % {PACKET} AS rest FROM d
)
SELECT doc_id, 0 AS stream, 1::BIGINT AS serial, 'opus' AS codec, (2 + ((n // {PACKET}) * {PACKET // 255 + 1} + CASE WHEN rest > 0 THEN rest // 255 + 1 ELSE 0 END + {SEGMENTS - 1}) // {SEGMENTS})::BIGINT AS n_pages,
  0 AS n_bad, 0 AS n_lost, packets::BIGINT AS n_packets, n::BIGINT AS n_bytes, packets * {FRAME} / 48000.0 AS seconds, md5 FROM s
UNION ALL
SELECT doc_id, 1, 2, 'vorbis', 3 + (strlen(note) // 255 + {SEGMENTS}) // {SEGMENTS}, 0, 0, 1, strlen(note), 1.0, md5(note) FROM s
"""

_HEADS = "\n".join(
    f"  UNION ALL SELECT doc_id, {k}, {k + 1}, '{codec}', {n}, 0, 0.0, {len(p)}, '{hashlib.md5(p, usedforsecurity=False).hexdigest()}' FROM d"
    for k, (codec, heads) in enumerate((("opus", OPUS), ("vorbis", VORBIS)))
    for n, p in enumerate(heads)
)

#: DuckDB: every packet. j: number of a packet of the text; page: the page it ends on; positions run evenly from the page before (0 before the first) to the page's.
PACKETS_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS raw, octet_length(raw) AS n, encode(concat_ws(' ', source, lang)) AS note FROM documents
), t AS (
  SELECT r, doc_id, j, raw[{PACKET} * j + 1 : {PACKET} * (j + 1)] AS data,
    ({PACKET // 255 + 1} * j + octet_length(data) // 255) // {SEGMENTS} AS page FROM d, unnest(range((n + {PACKET} - 1) // {PACKET})) AS u(j)
), p AS (
  SELECT *, min(j) OVER w AS low, max(j) OVER w AS top FROM t WINDOW w AS (PARTITION BY r, page)
), q AS (
  SELECT *, CASE WHEN low > 0 THEN {PRESKIP} + {FRAME} * low ELSE 0 END AS before, {PRESKIP} + {FRAME} * (top + 1) AS granule FROM p
), o AS (
  SELECT doc_id, 0 AS stream, 1::BIGINT AS serial, 'opus' AS codec, {len(OPUS)} + j AS packet, CASE WHEN j = top THEN granule END AS granule,
    greatest(0, (before + (granule - before) * (j - low + 1) / (top - low + 1) - {PRESKIP}) / 48000) AS seconds, octet_length(data) AS n_bytes, md5(data) AS md5 FROM q
  UNION ALL SELECT doc_id, 1, 2, 'vorbis', {len(VORBIS)}, 44100, 1.0, octet_length(note), md5(note) FROM d
{_HEADS}
)
SELECT doc_id, stream::INTEGER AS stream, serial, codec, packet::INTEGER AS packet, granule::BIGINT AS granule, seconds::DOUBLE AS seconds, n_bytes::INTEGER AS n_bytes, md5 FROM o
"""

#: DuckDB: the streams of damaged files. gone: the page of a stream that is not read; packets low to high touch it; each OggS in a page that fails is one more bad page.
DAMAGED_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce((doc_id % {FORMS} + {FORMS}) % {FORMS}, 0) AS form,
    encode(coalesce(text, '')) AS raw, octet_length(raw) AS n, encode(concat_ws(' ', source, lang)) AS note, octet_length(note) AS m,
    n // {PACKET} * {PACKET // 255 + 1} + CASE WHEN n % {PACKET} > 0 THEN n % {PACKET} // 255 + 1 ELSE 0 END AS raw_laced, m // 255 + 1 AS note_laced,
    {len(OPUS)} + (raw_laced + {SEGMENTS - 1}) // {SEGMENTS} AS raw_pages, {len(VORBIS)} + (note_laced + {SEGMENTS - 1}) // {SEGMENTS} AS note_pages FROM documents
), c AS (
  SELECT * FROM d, unnest(range(CASE WHEN form IN (1, 7) THEN 2 ELSE 1 END)) AS u(copy)
), s AS (
  SELECT r, doc_id, form, copy, 1 AS serial, 'opus' AS codec, {len(OPUS)} AS heads, raw AS body, {PACKET} AS size, (n + {PACKET} - 1) // {PACKET} AS packets,
    raw_laced AS laced, {PACKET // 255 + 1} AS step, raw_pages AS pages, raw_pages > note_pages AS ends, {FRAME} AS frame, 48000 AS rate FROM c
  UNION ALL
  SELECT r, doc_id, form, copy, 2, 'vorbis', {len(VORBIS)}, note, m, 1, note_laced, note_laced, note_pages, raw_pages <= note_pages, 44100, 44100 FROM c
), a AS (
  SELECT *, CASE WHEN form = 3 AND serial = 1 OR form = 7 AND copy = 1 THEN 0 WHEN form = 4 AND serial = 1 OR form = 8 AND serial = 2 THEN 1
    WHEN form = 5 AND serial = 1 AND pages > 2 THEN 2 WHEN form = 6 AND serial = 1 AND pages > 3 THEN 3 WHEN form = 9 AND ends THEN pages - 1 END AS gone FROM s
), b AS (
  SELECT *, CASE WHEN gone >= heads THEN (gone - heads) * {SEGMENTS} END AS first, CASE WHEN first >= 0 THEN least(first + {SEGMENTS}, laced) END AS past,
    first // step AS low, (past - 1) // step AS high FROM a
), k AS (
  SELECT *, CASE WHEN low IS NULL THEN body ELSE body[1 : low * size] || body[(high + 1) * size + 1 : octet_length(body)] END AS kept,
    CASE WHEN gone = 0 THEN 0 WHEN high = packets - 1 THEN low ELSE packets END AS until, hex(body[1 : {SEGMENTS // (PACKET // 255 + 1) * PACKET + SEGMENTS % (PACKET // 255 + 1) * 255}]) AS page FROM b
)
SELECT doc_id, (row_number() OVER (PARTITION BY r ORDER BY copy, CASE WHEN gone = 0 THEN 2 ELSE 0 END + serial) - 1)::INTEGER AS stream, serial::BIGINT AS serial, CASE WHEN gone = 0 THEN NULL ELSE codec END AS codec,
  (pages - CASE WHEN gone IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_pages,
  (CASE form WHEN 2 THEN 2 WHEN 6 THEN 0 ELSE count(gone) OVER w END + max(CASE WHEN form = 5 AND gone = 2 THEN (length(page) - length(replace(page, hex('OggS'), ''))) // 8 ELSE 0 END) OVER w)::INTEGER AS n_bad,
  CASE WHEN low * step < first OR least((high + 1) * step, laced) > past THEN 1 ELSE 0 END AS n_lost,
  (packets - coalesce(high - low + 1, 0))::BIGINT AS n_packets, octet_length(kept)::BIGINT AS n_bytes, (until * frame / rate)::DOUBLE AS seconds, md5(kept) AS md5 FROM k WINDOW w AS (PARTITION BY r)
"""

"""Vectorised word splitting and hashing shared by the text operators.

Texts are lower-cased sign by sign (a final sigma is a sigma). A *word* is a
maximal run of ASCII letters, digits and underscores and of other letters and
marks; a sign of a script that is written without blanks (Han, kana, Thai, Lao,
Khmer, Myanmar) is a word of its own; punctuation, blanks and symbols, beyond
ASCII too, separate words. `word_sql` says the same to DuckDB.

Whole batches of texts are handled as one byte array, so the cost per word is a
few numpy operations and no Python object is made per word. A text of `LONG`
bytes or more is handled block by block: no array grows with it but the one that
the caller keeps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; keeps the working arrays in cache.
CHUNK = 1 << 20
#: Texts of at least so many bytes go through `long_words`.
LONG = 4 << 20

#: Code points beyond ASCII that separate words, and those that are words of their own.
SEPARATORS = ((0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x37E, 0x37E), (0x387, 0x387), (0x55A, 0x55F), (0x589, 0x58A), (0x5BE, 0x5BE), (0x5C0, 0x5C0), (0x5C3, 0x5C3), (0x5F3, 0x5F4), (0x60C, 0x60D), (0x61B, 0x61B), (0x61E, 0x61F), (0x66A, 0x66D), (0x6D4, 0x6D4), (0x964, 0x965), (0x10FB, 0x10FB), (0x1361, 0x1368), (0x1680, 0x1680), (0x2000, 0x200B), (0x200E, 0x2BFF), (0x2E00, 0x2E7F), (0x3000, 0x3004), (0x3008, 0x303F), (0xE000, 0xF8FF), (0xFD3E, 0xFD3F), (0xFE00, 0xFE1F), (0xFE30, 0xFE6F), (0xFEFF, 0xFEFF), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0xFFE0, 0xFFFF), (0x1F000, 0x1FAFF), (0xE0000, 0x10FFFF))
SINGLES = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))

_KIND = np.ones(0x110000, np.uint8)  # 0 separator, 1 part of a word, 2 a word of its own
for _low, _high in SEPARATORS:
    _KIND[_low : _high + 1] = 0
for _low, _high in SINGLES:
    _KIND[_low : _high + 1] = 2

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), 95]] = True
_IS_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WRAP = (1 << 64) - 1


def _pattern(sign) -> str:
    """The word as a regular expression; sign writes a code point."""
    apart = sorted((*SEPARATORS, *SINGLES))
    runs_ = [(a, b) for (_, end), (start, _) in zip(((0, 0x7F), *apart), apart, strict=False) for a, b in ((end + 1, start - 1),) if a <= b]
    ranges = lambda rs: "".join(f"{sign(a)}-{sign(b)}" for a, b in rs if not 0xD800 <= a <= 0xDFFF)
    # surrogates are no signs of a text
    runs_ = [r for a, b in runs_ for r in (((a, min(b, 0xD7FF)), (0xE000, b)) if a < 0xD800 <= b else ((a, b),)) if r[0] <= r[1]]
    return f"[0-9a-z_{ranges(runs_)}]+|[{ranges(SINGLES)}]"


_WORD = re.compile(_pattern(lambda c: f"\\U{c:08x}"))
_WORD_SQL = _pattern(lambda c: f"\\x{{{c:X}}}")


def word_sql(column: str) -> str:
    """DuckDB's list of the words of a text column."""
    return f"regexp_extract_all(replace(lower(replace({column}, 'İ', 'i')), 'ς', 'σ'), '{_WORD_SQL}')"


class Words(NamedTuple):
    hash: np.ndarray  # uint64, one per word
    doc: np.ndarray  # int64, index of the text that holds the word
    first: np.ndarray  # int64, n_texts + 1 word offsets


def lower(text: str) -> str:
    """Lower case, sign by sign."""
    if text.isascii():
        return text.lower()
    return text.replace("İ", "i").lower().replace("ς", "σ")


def split_words(text: str | None) -> list[str]:
    """The same words as strings; slow, for single texts and tests."""
    return _WORD.findall(lower((text or "").replace("\0", " ")))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; more than a few blocks of them are not kept."""
    if _powers and len(_powers["up"]) >= n:
        return _powers["up"], _powers["down"]
    size, made = max(n, 2 * CHUNK), {}
    for key, base in (("up", _BASE), ("down", _INVERSE)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        made[key] = np.multiply.accumulate(p)
    if size <= 8 * CHUNK:
        _powers.update(made)
    return made["up"], made["down"]


def _edges(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte behind it."""
    mask = _IS_WORD[buf]
    lead = np.flatnonzero(buf >= 0xC2)
    alone = None
    if len(lead):
        b0 = buf[lead].astype(np.int32)
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        at = lambda i: buf[np.minimum(lead + i, len(buf) - 1)].astype(np.int32) & 0x3F
        code = np.where(size == 2, (b0 & 0x1F) << 6 | at(1), np.where(size == 3, (b0 & 0xF) << 12 | at(1) << 6 | at(2), (b0 & 7) << 18 | at(1) << 12 | at(2) << 6 | at(3)))
        kind = _KIND[code]
        gone = kind == 0
        if gone.any():
            for i in range(4):
                mask[lead[gone & (size > i)] + i] = False
        single = kind == 2
        if single.any():
            alone = np.zeros(len(buf) + 1, bool)
            alone[lead[single]] = True
            alone[lead[single] + size[single]] = True
    begins, ends = mask.copy(), mask.copy()
    if alone is None:
        begins[1:] &= ~mask[:-1]
        ends[:-1] &= ~mask[1:]
    else:
        begins[1:] &= ~mask[:-1] | alone[1:-1]
        ends[:-1] &= ~mask[1:] | alone[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _values(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial of each word's bytes, before mixing."""
    up, down = _power(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return (total[end] - total[start]) * down[start]


def words(texts: Sequence[str | None]) -> Words:
    """Word hashes of a run of texts; None counts as an empty text."""
    joined = "\0".join([t.replace("\0", " ") if t and "\0" in t else t or "" for t in texts]) + "\0"
    buf = np.frombuffer(lower(joined).encode("utf-8", "replace"), np.uint8)
    start, end = _edges(buf)
    first = np.concatenate(([0], np.searchsorted(start, np.flatnonzero(buf == 0)))).astype(np.int64)
    return Words(mix(_values(buf, start, end)), np.repeat(np.arange(len(texts)), np.diff(first)), first)


def long_words(raw: bytes | memoryview, block: int = CHUNK) -> Iterator[np.ndarray]:
    """The word hashes of one UTF-8 text in consecutive arrays, reading `block` bytes at a time; a word may be longer than a block."""
    value = length = 0  # of the word that the last block left open
    low, n = 0, len(raw)
    view = memoryview(raw)
    while low < n:
        high = min(n, low + block)
        while high < n and high > low and view[high] & 0xC0 == 0x80:
            high -= 1
        buf = np.frombuffer(lower(bytes(view[low:high]).decode("utf-8", "replace")).encode("utf-8", "replace"), np.uint8)
        low = high
        start, end = _edges(buf)
        own = _values(buf, start, end)
        single = len(buf) and buf[0] >= 0xC2 and _KIND[ord(bytes(buf[: 2 + (buf[0] >= 0xE0) + (buf[0] >= 0xF0)]).decode("utf-8"))] == 2
        if length:
            if len(start) and start[0] == 0 and not single:  # the open word goes on
                own[0] = (value + int(own[0]) * pow(int(_BASE), length, 1 << 64)) & _WRAP
                before = length
            else:
                yield mix(np.array([value], np.uint64))
                before = 0
            value = length = 0
        else:
            before = 0
        if high < n and len(end) and end[-1] == len(buf) and not _closed(buf):
            value, length = int(own[-1]), int(end[-1] - start[-1]) + (before if len(own) == 1 else 0)
            own = own[:-1]
        if len(own):
            yield mix(own)
    if length:
        yield mix(np.array([value], np.uint64))


def _closed(buf: np.ndarray) -> bool:
    """Whether the last sign is a word of its own."""
    tail = bytes(buf[-4:])
    while tail and tail[0] & 0xC0 == 0x80:
        tail = tail[1:]
    return _KIND[ord(tail.decode("utf-8")[-1])] == 2


def long_grams(raw: bytes | memoryview, k: int, more: int = 0, block: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-gram hashes of one text and the places of their first words, in blocks that repeat the last `more` k-grams of the block before."""
    kept, at = np.empty(0, np.uint64), 0
    for own in long_words(raw, block):
        w = np.concatenate((kept, own))
        if len(w) >= k:
            h = _rolled(w, k)
            yield h, np.arange(at, at + len(h))
        stay = min(len(w), k - 1 + more)
        at += len(w) - stay
        kept = w[len(w) - stay :]


def at_places(raw: bytes | memoryview, ranges: Sequence[tuple[int, int]], block: int = CHUNK) -> dict[int, int]:
    """Hashes of the words of one text at the places of the ranges [low, high), ascending and apart, by place."""
    out: dict[int, int] = {}
    at = i = 0
    for own in long_words(raw, block):
        while i < len(ranges) and ranges[i][0] < at + len(own):
            low, high = max(ranges[i][0], at), min(ranges[i][1], at + len(own))
            if low < high:
                out.update(zip(range(low, high), own[low - at : high - at].tolist(), strict=True))
            if ranges[i][1] > at + len(own):
                break
            i += 1
        at += len(own)
        if i == len(ranges):
            break
    return out


def runs_of(sizes: Sequence[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Index ranges of about `limit` in all each; what has LONG or more is alone."""
    low, size = 0, 0
    for i, n in enumerate(sizes):
        if n >= LONG and low < i:
            yield low, i
            low, size = i, 0
        size += n + 1
        if size >= limit or n >= LONG:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(sizes):
        yield low, len(sizes)


def runs(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Index ranges of whole texts that hold about `limit` bytes each; a text of LONG bytes is alone."""
    return runs_of(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), limit)


def long_text(texts: pa.Array, low: int, high: int) -> memoryview | None:
    """The bytes, in place, of a run that is one text of LONG bytes or more."""
    if high - low != 1 or not texts[low].is_valid:
        return None
    raw = texts[low].as_buffer()
    return memoryview(raw) if raw.size >= LONG else None


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[j : n + j]
    return mix(out)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text index and word position of every run of k words inside one text."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    doc = w.doc[at]
    return _rolled(w.hash, k)[at], doc, at - w.first[doc]


def gram_blocks(texts: pa.Array, k: int, more: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, index, place) of the k-grams of a column of texts, run by run; a long text comes in several parts that share `more` k-grams."""
    for low, high in runs(texts):
        raw = long_text(texts, low, high)
        if raw is None:
            h, doc, pos = grams(words(texts.slice(low, high - low).to_pylist()), k)
            yield h, doc + low, pos
        else:
            for h, pos in long_grams(raw, k, more):
                yield h, np.full(len(h), low), pos


def gram_hashes_of_words(hashes: Sequence[int], k: int) -> list[int]:
    """k-gram hashes of one list of word hashes, one by one; for tests."""
    out = []
    for i in range(len(hashes) - k + 1):
        h = 0
        for x in hashes[i : i + k]:
            h = (h * 0xD6E8FEB86659FD93 + int(x)) % (1 << 64)
        out.append(int(mix(np.array([h], np.uint64))[0]))
    return out

"""Operator 3: benchmark decontamination by winnowing.

Of every window of `window` consecutive word k-gram hashes the smallest (the
rightmost of equals) is kept as a fingerprint, in training texts and benchmark
texts alike. Fingerprints are joined by hash; each hit is extended to both sides
while the words agree. Every span of at least k + window - 1 common words holds
a window whose fingerprint both sides keep, so every such span is found; shorter
ones are not reported.

Defined results. Words are those of `_text`; those around a hit are compared by
their 64-bit hashes. A null text has no words. Spans are those of the smallest
text of rows that repeat a doc_id or item_id, and rows without id are never
reported. Filtering judges each row by its own text, whatever its doc_id, against
every distinct benchmark text, whatever its item_id. A passage that occurs more
than once is reported at each pair of places. An empty table gives an empty
result.

Scale. Fingerprints are made and joined inside the scan: the benchmark side is
broadcast after its rows were counted, and if there are more than
`broadcast_rows` the join shuffles instead. Texts are read again only for
documents with a hit, and of their words only those near hits are kept. A very
long text is fingerprinted block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._text import at_places, grams, long_grams, long_text, runs, word_sql, words

K, WINDOW = 5, 4
#: Fingerprints of 16 bytes; 2 M of them are some 32 MB.
BROADCAST_ROWS = 2_000_000


def winnow(h: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Indices of the fingerprints in the k-gram hashes h of consecutive texts; a text with fewer k-grams than a window is one window."""
    if not len(h):
        return np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    size = np.diff(np.concatenate((first, [len(h)])))
    n = len(h) - window + 1
    picked = []
    if n > 0:
        low, at = h[:n].copy(), np.arange(n)
        for j in range(1, window):
            better = h[j : n + j] <= low
            low[better] = h[j : n + j][better]
            at[better] = np.flatnonzero(better) + j
        picked.append(at[doc[:n] == doc[window - 1 :]])
    for f, s in zip(first[size < window], size[size < window], strict=True):
        picked.append(np.array([f + s - 1 - int(np.argmin(h[f : f + s][::-1]))]))
    return np.unique(np.concatenate(picked)) if picked else np.empty(0, np.int64)


def _prints(k: int, window: int):
    def lists(ids: pa.Array, h: np.ndarray, pos: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        pair = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(pos.astype(np.int32))], names=["h", "p"])
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets.astype(np.int32), pair)], names=["_id", "_f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low, high in runs(texts):
                raw = long_text(texts, low, high)
                if raw is None:
                    h, doc, pos = grams(words(texts.slice(low, high - low).to_pylist()), k)
                    at = winnow(h, doc, window)
                    yield lists(ids.slice(low, high - low), h[at], pos[at], np.searchsorted(doc[at], np.arange(high - low + 1)))
                    continue
                for h, pos in long_grams(raw, k, window - 1):
                    at = winnow(h, np.zeros(len(h), np.int8), window)
                    yield lists(ids.slice(low, 1), h[at], pos[at], np.array([0, len(at)]))

    return run


def fingerprints(texts: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(_id, _h, _p) of a table (_id, _text): hash and first word of each fingerprint. _id is a long or a struct of longs."""
    kind = texts.schema["_id"].dataType.simpleString()
    f = _store.arrow(texts.select("_id", "_text"), _prints(k, window), f"_id {kind}, _f array<struct<h:long,p:int>>")
    return f.select("_id", F.explode("_f").alias("_f")).select("_id", F.col("_f.h").alias("_h"), F.col("_f.p").alias("_p"))


def extend(a: dict[int, int], b: list[int], hits: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Maximal runs of equal words (start in a, start in b, length) around the hits, of at least `least` words. a: words by place, those that b may reach from a hit."""
    found, out = {}, []
    for p, q in sorted(hits):
        end = found.get(p - q)
        if end is not None and p < end:
            continue
        i, j = p, q
        while j and a.get(i - 1) == b[j - 1]:
            i, j = i - 1, j - 1
        e, f = p, q
        while f < len(b) and a.get(e) == b[f]:
            e, f = e + 1, f + 1
        found[p - q] = max(e, p + 1)
        if e - i >= least:
            out.append((i, j, e - i))
    return out


def near(hits: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Ranges of places, ascending and apart, that texts of n words may cover from hits (p, q, n)."""
    out: list[list[int]] = []
    for low, high in sorted((max(0, p - q), p - q + n) for p, q, n in hits):
        if out and low <= out[-1][1]:
            out[-1][1] = max(high, out[-1][1])
        else:
            out.append([low, high])
    return [(low, high) for low, high in out]


def _spans(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}  # words of the items of a batch
        for batch in batches:
            rows = []
            known.clear()
            for i in range(batch.num_rows):
                doc, row, items = (batch.column(c)[i].as_py() for c in (0, 1, 3))
                for item in items:
                    if item["i"] not in known:
                        known[item["i"]] = words([item["t"]]).hash.tolist()
                a = at_places(batch.column(2)[i].as_buffer(), near([(h["p"], h["q"], len(known[x["i"]])) for x in items for h in x["hits"]]))
                for item in items:
                    for start, at, n in extend(a, known[item["i"]], [(h["p"], h["q"]) for h in item["hits"]], least):
                        rows.append((doc, row, item["i"], start, at, n))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "_row", "item_id", "doc_start", "item_start", "n_words"])

    return run


def _one(df: DataFrame, id_col: str) -> DataFrame:
    return _store.pick(df, _id=id_col, _text="text").where("_id is not null and _text is not null").withColumn("_id", F.col("_id").cast("long"))


def _found(docs: DataFrame, benchmark: DataFrame, k: int, window: int, broadcast_rows: int, every: bool) -> DataFrame:
    """The spans of `spans`, with _row; with `every` those of each distinct text, known by its hash as doc_id and its length as _row, with every distinct benchmark text under a number instead of item_id."""
    if every:
        items = _store.pick(benchmark, _text="text").where("_text is not null").distinct().select(F.monotonically_increasing_id().alias("_id"), "_text")
    else:
        items = _one(benchmark, "item_id").groupBy("_id").agg(F.min("_text").alias("_text"))
    items = _store.keep(items, "items")
    tests = _store.keep(fingerprints(items, k, window).select(F.col("_id").alias("_item"), "_h", F.col("_p").alias("_q")), "fingerprints")
    small = tests.count() <= broadcast_rows
    if every:
        train = _store.pick(docs, _text="text").where("_text is not null").select(F.xxhash64("_text").alias("_id"), F.octet_length("_text").cast("long").alias("_row"), "_text")
    else:  # rows that repeat a doc_id may differ: a hit holds for the text it was found in only
        train = _one(docs, "doc_id").withColumn("_row", F.xxhash64("_text"))
    prints = fingerprints(train.select(F.struct("_id", "_row").alias("_id"), "_text"), k, window).select("_id._id", "_id._row", "_h", "_p")
    hits = prints.join(F.broadcast(tests) if small else tests, "_h").groupBy("_id", "_row", "_item").agg(F.collect_set(F.struct(F.col("_p").alias("p"), F.col("_q").alias("q"))).alias("hits"))
    hits = _store.keep(hits, "hits")
    by_item = hits.join(items.select(F.col("_id").alias("_item"), F.col("_text").alias("t")), "_item")
    found = by_item.groupBy("_id", "_row").agg(F.collect_list(F.struct(F.col("_item").alias("i"), "t", "hits")).alias("_items"))
    if every:
        texts = train.join(hits.select("_id", "_row").distinct(), ["_id", "_row"], "left_semi").groupBy("_id", "_row").agg(F.min("_text").alias("_text"))
    else:
        texts = train.join(hits.select("_id").distinct(), "_id", "left_semi").groupBy("_id").agg(F.min("_text").alias("_text")).withColumn("_row", F.xxhash64("_text"))
    both = texts.join(found, ["_id", "_row"]).select("_id", "_row", "_text", "_items")
    return _store.arrow(both, _spans(k + window - 1), "doc_id long, _row long, item_id long, doc_start int, item_start int, n_words int")


def spans(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words): every maximal run of at least k + window - 1 common words of a document and a benchmark item."""
    return _found(docs, benchmark, k, window, broadcast_rows, False).drop("_row")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = K + WINDOW - 1, k: int = K, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs, columns as they came, whose own text shares no span of min_words or more words with a benchmark item."""
    name, row = _store.free(docs, "_bad"), _store.free(docs, "_row")
    found = _found(docs, benchmark, k, window, broadcast_rows, True).where(F.col("n_words") >= min_words)
    bad = _store.keep(found.select(F.col("doc_id").alias(name), F.col("_row").alias(row)).distinct(), "contaminated")
    return docs.join(bad, (F.xxhash64("text") == F.col(name)) & (F.octet_length("text") == F.col(row)), "left_anti")


#: DuckDB: the k-grams of every text, joined as strings and merged along diagonals.
ORACLE_SQL = f"""
WITH toks AS (
  SELECT 'd' AS kind, doc_id AS id, {word_sql("text")} AS w FROM (SELECT doc_id, min(text) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id)
  UNION ALL
  SELECT 'b', item_id, {word_sql("text")} FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY item_id)
), g AS (
  SELECT kind, id, p - 1 AS p, array_to_string(w[p:p + 7], ' ') AS gram FROM (SELECT kind, id, w, unnest(range(1, len(w) - 6)) AS p FROM toks)
), hits AS (
  SELECT d.id AS doc_id, b.id AS item_id, d.p AS dp, b.p AS bp FROM g d JOIN g b ON d.gram = b.gram WHERE d.kind = 'd' AND b.kind = 'b'
), islands AS (
  SELECT *, dp - row_number() OVER (PARTITION BY doc_id, item_id, dp - bp ORDER BY dp) AS island FROM hits
)
SELECT doc_id, item_id, CAST(min(dp) AS INTEGER) AS doc_start, CAST(min(bp) AS INTEGER) AS item_start, CAST(max(dp) - min(dp) + 8 AS INTEGER) AS n_words
FROM islands GROUP BY doc_id, item_id, dp - bp, island
"""

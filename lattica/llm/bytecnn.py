"""Operator 2: quality classifier, a byte-level convolutional network in numpy.

The UTF-8 bytes of the whole text are laid out in overlapping chunks. Learned
filters slide over every byte position of a chunk, the strongest answer of each
filter is kept, a dense layer turns these into chunk features, and the maximum
and the mean over all chunks are combined into one probability that the text is
acceptable: of good quality and not toxic.

Training reads a bounded sample of labelled rows (`max_rows`, `max_chars`, taken
in hash order of doc_id, so at random) and runs a fixed number of steps on the
driver. Scoring reads every text whole, in blocks of `MEMORY` bytes of which only
the running maximum and sum are kept, has no shuffle, and carries a model of some
40 kB to the tasks.

Defined results. A null or empty text has probability 0. A label row without
doc_id or quality is ignored, a null toxic counts as 0; of labels that repeat a
doc_id the lowest quality and the highest toxic hold. With no label at all, or
labels of one kind only, the probability is the share of acceptable labels (1
without any). Repeated rows are scored each. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store

MAX_ROWS, MAX_CHARS, STEPS, RATE, MARGIN = 8192, 48_000_000, 1000, 0.015, 4 / 3
CHUNK, STRIDE, WIDTH, BLOCK = 512, 480, 8, 4
EMBED, FILTERS, HIDDEN = 8, 32, 16
#: Bytes seen by one block of BLOCK neighbouring filter positions.
SPAN = 12
PAD = 256
_SLICE = 8
#: Bytes of texts that are laid out in chunks at once.
MEMORY = 1 << 18


def n_chunks(size: np.ndarray) -> np.ndarray:
    """How many chunks texts of so many bytes have."""
    return np.where(size > 0, np.maximum(0, -((CHUNK - SPAN - size) // STRIDE)) + 1, 0)


def chunked(texts: Sequence[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks (uint16, PAD beyond a text's end) and the offset of each text's first."""
    raw = [t.encode("utf-8", "replace") if isinstance(t, str) else t or b"" for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    buf = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
    begin = np.concatenate(([0], np.cumsum(size)))
    count = n_chunks(size)
    first = np.concatenate(([0], np.cumsum(count)))
    doc = np.repeat(np.arange(len(raw)), count)
    at = begin[doc] + (np.arange(first[-1]) - first[doc]) * STRIDE
    return _laid_out(buf, at, begin[doc + 1]), first


def _laid_out(buf: np.ndarray, at: np.ndarray, end: np.ndarray | int) -> np.ndarray:
    index = at[:, None] + np.arange(CHUNK)
    out = buf[np.minimum(index, len(buf) - 1)].astype(np.uint16)
    out[index >= (end[:, None] if isinstance(end, np.ndarray) else end)] = PAD
    return out


@dataclass
class Model:
    embed: np.ndarray
    filters: np.ndarray  # WIDTH, EMBED, FILTERS
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    top: np.ndarray  # weights of the maximum, then of the mean
    top_bias: np.ndarray
    constant: float | None = None
    #: Least probability of a text to be kept: odds MARGIN times those of the labels.
    threshold: float = 0.5
    _wide: np.ndarray | None = field(default=None, repr=False)

    @staticmethod
    def fresh(seed: int) -> Model:
        r = np.random.default_rng(seed)
        n = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        embed = n(PAD + 1, EMBED, scale=0.5)
        embed[PAD] = 0
        return Model(embed, n(WIDTH, EMBED, FILTERS, scale=(2 / WIDTH / EMBED) ** 0.5), np.zeros(FILTERS, np.float32), n(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5), np.full(HIDDEN, 0.1, np.float32), n(2 * HIDDEN, scale=0.3), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.dense_bias, self.top, self.top_bias]

    def wide(self) -> np.ndarray:
        """One matrix that applies the filters at BLOCK neighbouring positions."""
        w = np.zeros((SPAN, EMBED, BLOCK, FILTERS), np.float32)
        for o in range(BLOCK):
            w[o : o + WIDTH, :, o] = self.filters
        return w.reshape(SPAN * EMBED, BLOCK * FILTERS)

    def pool(self, chunks: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The strongest answer of each filter in each chunk and, if asked, its position."""
        n, wide = len(chunks), self.wide() if where or self._wide is None else self._wide
        blocks = (CHUNK - SPAN) // BLOCK + 1
        best, at = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if where else None
        for low in range(0, n, _SLICE):
            part = chunks[low : low + _SLICE]
            seen = np.lib.stride_tricks.sliding_window_view(part, SPAN, axis=1)[:, ::BLOCK]
            x = np.take(self.embed, seen.reshape(-1), axis=0).reshape(len(part) * blocks, SPAN * EMBED)
            y = (x @ wide).reshape(len(part), blocks * BLOCK, FILTERS)
            if where:
                at[low : low + _SLICE] = i = y.argmax(axis=1)
                best[low : low + _SLICE] = np.take_along_axis(y, i[:, None], 1)[:, 0]
            else:
                best[low : low + _SLICE] = y.max(axis=1)
        return best, at

    def hidden(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter answers and features of chunks."""
        p = np.maximum(pooled + self.bias, 0)
        return p, np.maximum(p @ self.dense + self.dense_bias, 0)

    def answer(self, most: np.ndarray, mean: np.ndarray) -> np.ndarray:
        z = most @ self.top[:HIDDEN] + mean @ self.top[HIDDEN:] + self.top_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def combine(self, pooled: np.ndarray, first: np.ndarray) -> tuple:
        """Probabilities of the texts and what the backward pass needs."""
        p, h = self.hidden(pooled)
        size = np.maximum(np.diff(first), 1)[:, None]
        most, mean = np.zeros((len(first) - 1, HIDDEN), np.float32), np.zeros((len(first) - 1, HIDDEN), np.float32)
        some = np.flatnonzero(np.diff(first))
        if len(some):
            most[some] = np.maximum.reduceat(h, first[some])
            mean[some] = np.add.reduceat(h, first[some]) / size[some]
        return self.answer(most, mean), p, h, most, mean, size

    def _long(self, raw: bytes | memoryview) -> float:
        """The probability of one text, some chunks at a time."""
        buf, n = np.frombuffer(raw, np.uint8), int(n_chunks(np.array([len(raw)]))[0])
        most, total = np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float64)
        for low in range(0, n, MEMORY // STRIDE):
            at = np.arange(low, min(n, low + MEMORY // STRIDE)) * STRIDE
            h = self.hidden(self.pool(_laid_out(buf, at, len(buf)))[0])[1]
            most, total = np.maximum(most, h.max(axis=0)), total + h.sum(axis=0, dtype=np.float64)
        return float(self.answer(most[None], (total / n).astype(np.float32)[None])[0])

    def score(self, texts: Sequence[str | None] | pa.Array) -> np.ndarray:
        """Probabilities of the texts; a text of more than MEMORY bytes is not laid out at once."""
        if not isinstance(texts, pa.Array):
            texts = pa.array([None if t is None else t.encode("utf-8", "replace") for t in texts], pa.binary())
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros(len(texts))
        if self.constant is not None:
            out[size > 0] = self.constant
            return out
        raw = lambda i: memoryview(texts[i].as_buffer()) if size[i] else b""
        low = 0
        while low < len(texts):
            if size[low] > MEMORY:
                out[low] = self._long(raw(low))
                low += 1
                continue
            high = low + 1
            while high < len(texts) and size[low : high + 1].sum() <= MEMORY:
                high += 1
            chunks, first = chunked([raw(i) for i in range(low, high)])
            if len(chunks):
                found = self.combine(self.pool(chunks)[0], first)[0]
                found[np.diff(first) == 0] = 0
                out[low:high] = found
            low = high
        return out


def _gradients(m: Model, chunks: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
    pooled, at = m.pool(chunks, where=True)
    prob, p, h, most, mean, size = m.combine(pooled, first)
    loss = float(-np.mean(np.log(np.where(y > 0, prob, 1 - prob) + 1e-9)))
    dz = ((prob - y) / len(y)).astype(np.float32)
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    tied = (h == most[doc]) & (h > 0)
    share = np.add.reduceat(tied.astype(np.float32), first[:-1])
    dh = dz[doc][:, None] * (m.top[:HIDDEN] * tied / np.maximum(share, 1)[doc] + m.top[HIDDEN:] / size[doc])
    dh *= h > 0
    dp = (dh @ m.dense.T) * (p > 0)
    row, f = np.nonzero(dp)
    g = dp[row, f]
    window = chunks[row[:, None], at[row, f][:, None] + np.arange(WIDTH)].astype(np.int64)
    filters, embed = np.zeros_like(m.filters), np.zeros_like(m.embed)
    seen = m.embed[window] * g[:, None, None]
    order = np.argsort(f, kind="stable")
    some, begin = np.unique(f[order], return_index=True)
    if len(some):
        filters[:, :, some] = np.add.reduceat(seen[order], begin, axis=0).transpose(1, 2, 0)
        back = (m.filters.transpose(2, 0, 1)[f] * g[:, None, None]).reshape(-1, EMBED)
        flat = window.reshape(-1)
        for e in range(EMBED):
            embed[:, e] = np.bincount(flat, back[:, e], PAD + 1)
        embed[PAD] = 0
    return [embed, filters, dp.sum(0), p.T @ dh, dh.sum(0), np.concatenate((dz @ most, dz @ mean)), np.array([dz.sum()], np.float32)], loss


def train(texts: Sequence[str], labels: Sequence[int], steps: int = STEPS, batch: int = 32, rate: float = RATE, seed: int = 7) -> Model:
    """Fit a model with Adam. Texts without bytes are left out."""
    use = [i for i, t in enumerate(texts) if t]
    texts, y = [texts[i] for i in use], np.array([labels[i] for i in use], np.float32)
    model = Model.fresh(seed)
    if not len(y) or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 1.0
        return model
    r, parts = np.random.default_rng(seed), model.parts()
    # half of a batch is of either kind; afterwards the constant is set back to the true odds
    kinds = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
    m1, m2 = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    order: list[list[int]] = [[], []]
    for step in range(1, steps + 1):
        pick = []
        for k in (0, 1):
            while len(order[k]) < batch // 2:
                order[k] += r.permutation(kinds[k]).tolist()
            pick += order[k][: batch // 2]
            del order[k][: batch // 2]
        grads, _ = _gradients(model, *chunked([texts[i] for i in pick]), y[pick])
        now = rate * min(1, step / 30, 1.02 - step / steps)
        for p, g, a, b in zip(parts, grads, m1, m2, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    odds = len(kinds[1]) / len(kinds[0])
    model.top_bias += np.float32(np.log(odds))
    model.threshold = MARGIN * odds / (1 + MARGIN * odds)
    model._wide = model.wide()
    return model


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> tuple[list[str], list[int]]:
    """At most max_rows labelled texts, and no more than max_chars characters, in hash order of doc_id."""
    lab = _store.pick(labels, _id="doc_id", _q="quality", _t="toxic").where("_id is not null and _q is not null")
    lab = lab.groupBy("_id").agg((F.min("_q") * (1 - F.max(F.coalesce("_t", F.lit(0))))).alias("_y"))
    few = lab.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    # at most max_rows short rows: the bound is a parameter, so this side may be broadcast
    rows = _store.pick(docs, _id="doc_id", _text="text").join(F.broadcast(few), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    rows = rows.withColumn("_h", F.xxhash64("_id")).withColumn("_n", F.length("_text"))
    rows = rows.where("_n > 0").select("_text", "_y", "_h", "_id").orderBy("_h", "_id")
    texts, y, size = [], [], 0
    for row in rows.toLocalIterator():
        size += len(row[0])
        if size > max_chars and texts:
            break
        texts.append(row[0])
        y.append(int(row[1] > 0))
    return texts, y


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, p_accept) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)))], names=["doc_id", "p_accept"])

    return _store.arrow(_store.pick(docs, doc_id="doc_id", _text="text").withColumn("doc_id", F.col("doc_id").cast("long")), run, "doc_id long, p_accept double")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, columns as they came, whose probability reaches the model's threshold."""
    names, schema = docs.columns, docs.schema
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.score(batch.column(text)) >= model.threshold
            yield batch.filter(pa.array(good))

    return _store.arrow(docs, run, schema)

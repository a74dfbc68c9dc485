"""Operator 9: near-duplicate groups by circulant MinHash.

Two permutations of one universe, the 32-bit numbers, give the whole signature: the
first scatters the shingles, the second, shifted circularly by k, ranks them for
coordinate k. Both are computed, not looked up, so that the universe is far larger
than any text's set of shingles. Signatures are cut into bands; documents that agree in a band
become candidates; candidates are verified by the exact Jaccard similarity of
their word shingle sets; verified pairs are joined into groups.

Defined results. A null text is an empty one. Texts of fewer words than a
shingle have one shingle, all their words. Texts with no word at all have equal
(empty) sets and form one group. Rows that repeat a doc_id are one document,
whose text is the smallest of theirs; a row with that text stays. Rows without doc_id are in no group and
always stay. A group is named by its smallest doc_id. Other columns are never
read, whatever their names. An empty table gives an empty result.

Scale. A document costs one short row per band in a single shuffle. Equal sets
collapse before banding, so exact copies cost nothing there. Inside a bucket
not all pairs are verified: first each document with one partner, then only
pairs that are still in different groups, a few a document in the first rounds
and finally every one that is left, so the groups are those that all pairs would
give. Pairs whose sets differ too much in size to be alike are never verified, and
texts travel only for pairs that are (compressed they are smaller than the hashes
of their shingles). Of a very long text no array but its distinct shingles is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _store
from ._text import LONG, Words, grams, long_grams, long_text, long_words, mix, runs, runs_of, words

SHINGLE, BANDS, ROWS, THRESHOLD = 3, 32, 4, 0.5
SEED = 20240229
#: Pairs verified per document in each round; after the last, all that are left.
ROUNDS = (1, 4, 32)
_SIGNED = "_id long, _k1 long, _k2 long, _n long, _bands array<long>"


def shingles(w: Words, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and the offset of each text's first one; short texts have one shingle."""
    h, doc, _ = grams(w, k)
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        whole = []
        for d in short:
            x = np.uint64(size[d])
            for y in w.hash[w.first[d] : w.first[d + 1]]:
                x = mix(np.array([x ^ y]))[0]
            whole.append(x)
        h, doc = np.concatenate((h, np.array(whole, np.uint64))), np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, np.searchsorted(doc, np.arange(n_texts + 1))


def distinct(raw: memoryview, k: int) -> np.ndarray:
    """The distinct shingle hashes of one long text, ascending."""
    parts = [np.unique(h) for h, _ in long_grams(raw, k)]
    if not parts:
        own = [w for part in long_words(raw) for w in part.tolist()]
        return shingles(Words(np.array(own, np.uint64), np.zeros(len(own), np.int64), np.array([0, len(own)])), 1, k)[0]
    h = np.empty(sum(map(len, parts)), np.uint64)
    at = len(h)
    while parts:  # each part goes when it is copied
        p = parts.pop()
        at -= len(p)
        h[at : at + len(p)] = p
    h.sort()
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h if new.all() else h[new]


class Circulant:
    """sig[k] = min over the set of second(first(x) + k mod 2^32), for permutations first and second of the 32-bit numbers."""

    def __init__(self, size: int, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.size, self.shift = size, np.arange(size, dtype=np.uint32)
        self.keys = r.integers(0, 1 << 32, 2, np.uint32)

    @staticmethod
    def permute(x: np.ndarray, key: np.uint32, spare: np.ndarray) -> np.ndarray:
        """A bijection of 32-bit numbers, in place: every step can be undone."""
        for rotate, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            np.bitwise_xor(x, key, out=x)
            np.right_shift(x, np.uint32(rotate), out=spare)
            np.bitwise_xor(x, spare, out=x)
            np.multiply(x, np.uint32(factor), out=x)
        np.right_shift(x, np.uint32(16), out=spare)
        return np.bitwise_xor(x, spare, out=x)

    def _ranks(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(32)).astype(np.uint32)
        x = self.permute(at, self.keys[0], np.empty_like(at))[:, None] + self.shift
        return self.permute(x, self.keys[1], np.empty_like(x))

    def __call__(self, h: np.ndarray, offsets: np.ndarray, block: int = 2048) -> np.ndarray:
        """Signatures of the sets h[offsets[i]:offsets[i+1]]; all ones for an empty set."""
        out = np.full((len(offsets) - 1, self.size), 0xFFFFFFFF, np.uint32)
        full = np.flatnonzero(np.diff(offsets))
        low = 0
        while low < len(full):
            begin = offsets[full[low]]
            high = max(low + 1, int(np.searchsorted(offsets[full + 1], begin + block, "right")))
            rows = full[low:high]
            if high == low + 1:  # one set, perhaps very long: block by block
                d = rows[0]
                for b in range(begin, offsets[d + 1], block):
                    np.minimum(out[d], self._ranks(h[b : min(b + block, offsets[d + 1])]).min(axis=0), out=out[d])
            else:
                out[rows] = np.minimum.reduceat(self._ranks(h[begin : offsets[rows[-1] + 1]]), offsets[rows] - begin, axis=0)
            low = high
        return out


def set_keys(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set that depend neither on order nor on repetition, and its size."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((h, doc))
    s, d = h[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[new], d[new]
    out = np.zeros((n, 2), np.uint64)
    begin = np.searchsorted(d, np.arange(n + 1))
    some = np.flatnonzero(np.diff(begin))
    if len(some):
        out[some, 0] = np.add.reduceat(mix(s), begin[some])
        out[some, 1] = np.bitwise_xor.reduceat(mix(s + _OTHER), begin[some])
    return out, np.diff(begin)


_OTHER = np.uint64(0x51ED27)


def _long_keys(s: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """set_keys of one set of distinct hashes, block by block."""
    out = np.zeros((1, 2), np.uint64)
    for i in range(0, len(s), block):
        out[:, 0] += np.add.reduce(mix(s[i : i + block]))
        out[:, 1] ^= np.bitwise_xor.reduce(mix(s[i : i + block] + _OTHER))
    return out


def _sign(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circulant = Circulant(bands * rows)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0)
            for low, high in runs(texts):
                raw = long_text(texts, low, high)
                if raw is None:
                    h, offsets = shingles(words(texts.slice(low, high - low).to_pylist()), high - low, shingle)
                    keys, n = set_keys(h, offsets)
                else:
                    h = distinct(raw, shingle)
                    offsets, keys, n = np.array([0, len(h)]), _long_keys(h), np.array([len(h)])
                sig = circulant(h, offsets)
                key = np.tile(salt, (high - low, 1))
                for r in range(rows):
                    key = mix(key ^ sig[:, r::rows].astype(np.uint64))
                size = np.where(n > 0, bands, 0)
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), key[size > 0].ravel().view(np.int64))
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), pa.array(n.astype(np.int64)), lists], names=["_id", "_k1", "_k2", "_n", "_bands"])

    return run


def jaccard(a: str | None, b: str | None, k: int = SHINGLE) -> float:
    """Exact Jaccard similarity of two texts' shingle sets; two empty sets are equal."""
    return float(_jaccards([a], [b], k)[0])


def _jaccards(a: list, b: list, k: int) -> np.ndarray:
    n = len(a)
    ha, oa = shingles(words(a), n, k)
    hb, ob = shingles(words(b), n, k)
    out = np.ones(n)
    for i in range(n):
        x, y = np.unique(ha[oa[i] : oa[i + 1]]), np.unique(hb[ob[i] : ob[i + 1]])
        if len(x) or len(y):
            both = np.sort(np.concatenate((x, y)))
            same = int((both[1:] == both[:-1]).sum())
            out[i] = same / (len(both) - same)
    return out


def _long_jaccard(a: pa.Scalar, b: pa.Scalar, k: int, block: int = 1 << 20) -> float:
    x, y = (distinct(memoryview(t.as_buffer()) if t.is_valid else memoryview(b""), k) for t in (a, b))
    same = 0
    for i in range(0, len(y), block) if len(x) else ():
        part = y[i : i + block]
        same += int((x[np.minimum(np.searchsorted(x, part), len(x) - 1)] == part).sum())
    return same / (len(x) + len(y) - same) if len(x) or len(y) else 1.0


def _verify(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            sizes = np.maximum(*(pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False) for x in (a, b)))
            for low, high in runs_of(sizes):
                if sizes[low] >= LONG:
                    found = [_long_jaccard(a[low], b[low], k)]
                else:
                    found = _jaccards(a.slice(low, high - low).to_pylist(), b.slice(low, high - low).to_pylist(), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(found)], names=["_a", "_b", "_j"])

    return run


def components(edges: DataFrame, a: str = "_a", b: str = "_b") -> DataFrame:
    """(_id, _root): every node of an undirected graph with the smallest id of its component.

    Alternates the two star steps of Kiveris et al. (2014) until nothing changes; each round is written to the shared folder."""
    now = _store.keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("_u"), F.least(a, b).alias("_v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        large = _with_least(both).where("_v > _u").select(F.col("_v").alias("_u"), F.least("_u", "_m").alias("_v")).where("_u <> _v").distinct()
        small = _with_least(large).select(F.explode(F.array(F.struct(F.col("_v").alias("_u"), F.col("_m").alias("_v")), F.struct("_u", F.col("_m").alias("_v")))).alias("_e")).select("_e.*").where("_u <> _v").distinct()
        then = _store.keep(small, "edges")
        seen = then.agg(F.count("*"), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).first()
        _store.drop(now)
        now = then
        if seen == mark:
            break
        mark = seen
    roots = now.select("_v").distinct()
    return now.select(F.col("_u").alias("_id"), F.col("_v").alias("_root")).unionByName(roots.select(F.col("_v").alias("_id"), F.col("_v").alias("_root")))


def _with_least(pairs: DataFrame) -> DataFrame:
    """Pairs (_u, _v) with _m, the least _v of their _u. An aggregate and a join: a window would put all pairs of a hot _u in one task, a join's skewed side is split."""
    return pairs.join(pairs.groupBy("_u").agg(F.min("_v").alias("_m")), "_u")


def _repeated(docs: DataFrame, id_col: str, name: str) -> DataFrame:
    """The ids that more than one row has."""
    key = F.col(f"`{id_col}`")
    return _store.keep(docs.where(key.isNotNull()).groupBy(key.cast("long").alias(name)).count().where("count > 1").select(name), "repeated")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, repeated: DataFrame | None = None) -> DataFrame:
    """(doc_id, group_id) for every document: the smallest doc_id of its near-duplicate group, its own if it has no near duplicate. repeated: the ids of several rows, where they are known."""
    plain = _store.pick(docs, _id=id_col, _text=text_col).where("_id is not null").withColumn("_id", F.col("_id").cast("long"))
    many = _repeated(docs, id_col, "_id") if repeated is None else repeated.toDF("_id")
    if not many.isEmpty():  # the smallest text stands for a repeated doc_id; only those texts are shuffled for it
        smallest = plain.join(many, "_id", "left_semi").groupBy("_id").agg(F.min("_text").alias("_text"))
        plain = plain.join(many, "_id", "left_anti").unionByName(smallest)
    one = _store.keep(_store.arrow(plain, _sign(shingle, bands, rows), _SIGNED), "signed")
    sets = one.groupBy("_k1", "_k2").agg(F.min("_id").alias("_rep"), F.min_by("_bands", "_id").alias("_bands"), F.max("_n").alias("_n"))
    keys = sets.select(F.col("_rep").alias("_id"), "_n", F.explode("_bands").alias("_key"))
    # the bands that more than one set has; joined, not windowed, so that a hot one is no single task's
    shared = _store.keep(keys.groupBy("_key").agg(F.min(F.struct("_id", "_n")).alias("_lead"), F.max("_id").alias("_last")).where("_lead._id < _last").drop("_last"), "shared")
    buckets = _store.keep(keys.join(shared, "_key").select("_key", "_id", "_n", "_lead"), "buckets")
    # sets of sizes m <= n have a similarity of m / n at most
    alike = lambda m, n: F.least(m, n) >= F.greatest(m, n) * F.lit(threshold) - 1e-6
    wanted = buckets.select("_id").distinct()
    texts = _store.keep(plain.join(wanted, "_id", "left_semi"), "texts")
    done = roots = None
    for most in (*ROUNDS, None):
        if done is None:
            pairs = buckets.where((F.col("_id") != F.col("_lead._id")) & alike(F.col("_n"), F.col("_lead._n"))).groupBy("_id").agg(F.min("_lead._id").alias("_a")).select("_a", F.col("_id").alias("_b"))
        else:
            placed = buckets.select("_key", "_id", "_n").join(roots, "_id", "left").withColumn("_root", F.coalesce("_root", "_id"))
            several = placed.groupBy("_key").agg(F.min("_root").alias("_r1"), F.max("_root").alias("_r2")).where("_r1 < _r2").select("_key")
            mixed = placed.join(several, "_key", "left_semi")
            x, y = (mixed.select("_key", F.col("_id").alias(i), F.col("_root").alias(r), F.col("_n").alias(n)) for i, r, n in (("_a", "_ra", "_na"), ("_b", "_rb", "_nb")))
            pairs = x.join(y, "_key").where(F.expr("_a < _b and _ra <> _rb") & alike(F.col("_na"), F.col("_nb"))).select("_a", "_b").distinct().join(done.select("_a", "_b"), ["_a", "_b"], "left_anti")
            if most:
                pairs = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64("_a", "_b"), "_a"))).where(F.col("_n") <= most).drop("_n")
        both = pairs.join(texts.withColumnsRenamed({"_id": "_b", "_text": "_tb"}), "_b").join(texts.withColumnsRenamed({"_id": "_a", "_text": "_ta"}), "_a").select("_a", "_b", "_ta", "_tb")
        found = _store.keep(_store.arrow(both, _verify(shingle), "_a long, _b long, _j double"), "verified")
        if done is not None and found.isEmpty():
            break
        done = found if done is None else done.unionByName(found)
        roots = components(done.where(F.col("_j") >= threshold))
    rep = one.select("_id", "_k1", "_k2").join(sets.select("_k1", "_k2", "_rep"), ["_k1", "_k2"])
    if roots is not None:
        rep = rep.join(roots.select(F.col("_id").alias("_rep"), "_root"), "_rep", "left")
    else:
        rep = rep.withColumn("_root", F.lit(None).cast("long"))
    return rep.select(F.col("_id").alias("doc_id"), F.coalesce("_root", "_rep").alias("group_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with one document of each group, the smallest doc_id; of rows that repeat a doc_id one with the smallest text stays. Columns as they came."""
    name, place = _store.free(docs, "_go"), _store.free(docs, "_place")
    many = _repeated(docs, id_col, name)
    found = _store.keep(groups(docs, id_col, text_col, repeated=many, **options), "groups")
    key = F.col(f"`{id_col}`")
    go = found.where("doc_id <> group_id").select(F.col("doc_id").alias(name))
    on = key == F.col(name)
    if many.isEmpty():  # then documents are joined, and shuffled, once
        return docs.join(go, on, "left_anti")
    single = docs.join(go.unionByName(many), on, "left_anti")
    w = Window.partitionBy(key).orderBy(F.col(f"`{text_col}`").asc_nulls_last())
    repeated = docs.join(many, on, "left_semi").join(go, on, "left_anti").withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)
    return single.unionByName(repeated)

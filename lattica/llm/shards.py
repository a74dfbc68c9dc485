"""Operator 5: minimax sharding.

Documents in the order of their key are cut into at most `shards` contiguous
shards so that the largest one is as small as can be. Rows of one key are an
atomic group. The capacity is found by binary search: a capacity is feasible if
filling shards greedily, each up to the capacity, takes no more than `shards`
of them; the smallest feasible capacity is the optimum and the greedy cuts at it
are taken.

Defined results. The size of a row is the number of UTF-8 bytes of its text,
null and empty ones have none. Rows without key come first, as one group. Rows
that repeat a key stay together. There may be fewer shards than asked for. Other
columns pass through untouched. An empty table gives an empty result.

Scale. Sizes are aggregated by key and summed up range by range, so no task sees
all of them. The driver knows the running sums through `Ladder`: at first the first
and last sum of `GRAINS` equal stretches of the whole, which bound every greedy cut
from below and above. A capacity that is feasible by the lower bounds, or not even
by the upper ones, is decided; only where the bounds disagree are the stretches that
its cuts fall into cut into `FINER` parts each, on the executors. What the driver
holds and fetches depends on `shards` and these numbers, not on the table or on the
largest group. The cuts are keys, so the shard of a row is a comparison with a
sorted list of at most `shards` keys: texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _store

SHARDS, GRAINS, FINER = 64, 65_536, 16


class Ladder:
    """Bounds of the largest running sum up to a value. ask(windows, width): first and last sum of each stretch of `width` in the closed windows, ascending."""

    def __init__(self, ask: Callable[[list[tuple[int, int]] | None, int], np.ndarray], total: int, grains: int = GRAINS, finer: int = FINER):
        self.ask, self.total, self.finer = ask, total, finer
        self._set(ask(None, -(-total // grains)))

    def _set(self, pairs: np.ndarray) -> None:
        self.low, self.high = pairs[:, 0].copy(), pairs[:, 1].copy()

    def bounds(self, below: int, above: int) -> tuple[int, int]:
        """Bounds of the largest sum up to a value that itself lies in [below, above]; 0 if there is none."""
        i, j = (int(np.searchsorted(self.low, x, "right")) - 1 for x in (below, above))
        least = 0 if i < 0 else int(self.high[i]) if self.high[i] <= below else int(self.low[i])
        return least, 0 if j < 0 else min(above, int(self.high[j]))

    def refine(self, windows: list[tuple[int, int]], most: int = 128) -> bool:
        """Cut the widest of the stretches that the windows touch, in the first `most` runs of them; False if all of them are single sums."""
        pick = np.zeros(len(self.low), bool)
        for a, b in windows:
            pick[max(0, int(np.searchsorted(self.low, a, "right")) - 1) : int(np.searchsorted(self.low, b, "right"))] = True
        wide = np.where(pick, self.high - self.low, 0)
        if not wide.any():
            return False
        # what is narrower than the new width would grow by it
        width = int(wide.max()) // self.finer + 1
        at = np.flatnonzero(wide >= width)
        parts = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)[:most]
        fresh = self.ask([(int(self.low[p[0]]), int(self.high[p[-1]])) for p in parts], width)
        left = np.ones(len(self.low), bool)
        left[np.concatenate(parts)] = False
        pairs = np.concatenate((np.stack([self.low, self.high], 1)[left], fresh))
        self._set(pairs[np.argsort(pairs[:, 0])])
        return True

    def greedy(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Bounds of the running sums at which greedy filling ends a shard, until even the lower one has all, or shards + 1 of them."""
        out, low, high = [], 0, 0
        while low < self.total and len(out) <= shards:
            below, above = self.bounds(low + capacity, min(self.total, high + capacity))
            if below <= low:  # not known to get on
                below = low
            low, high = below, above
            out.append((low, high))
        return out


def feasible(sums: Ladder, capacity: int, shards: int) -> bool:
    """Whether greedy filling to the capacity takes at most `shards` shards."""
    while True:
        cuts_ = sums.greedy(capacity, shards)
        if len(cuts_) <= shards:
            return True
        if cuts_[shards - 1][1] < sums.total:
            return False
        # the first cut that is not known was looked for up to a capacity behind the one before
        if not sums.refine([(a + capacity, b + capacity) for a, b in [(0, 0), *cuts_[:shards]]]):
            raise AssertionError("bounds of single sums disagree")


def smallest(sums: Ladder, shards: int, largest: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and its cuts."""
    low = max(largest, -(-sums.total // shards))
    high = low + largest
    while low < high:
        mid = (low + high) // 2
        if feasible(sums, mid, shards):
            high = mid
        else:
            low = mid + 1
    while True:
        cuts_ = sums.greedy(low, shards)
        if all(a == b for a, b in cuts_):
            return low, [a for a, _ in cuts_]
        sums.refine([(a + low, b + low) for a, b in [(0, 0), *cuts_]])


def running(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(_key, _size, _sum): size and running sum of every group in key order; nulls first. Written to the shared folder."""
    sizes = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.octet_length(F.col("`text`")), F.lit(0)).cast("long").alias("_size")).groupBy("_key").agg(F.sum("_size").alias("_size"))
    ranged = _store.keep(sizes.repartitionByRange(F.col("_key").asc_nulls_first()).withColumn("_part", F.spark_partition_id()), "sizes")
    # one row a task: small however large the table is
    parts = ranged.groupBy("_part").agg(F.sum("_size").alias("_all"))
    parts = parts.select("_part", F.coalesce(F.sum("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(F.col("_key").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return _store.keep(ranged.withColumn("_in", F.sum("_size").over(inside)).join(F.broadcast(parts), "_part").select("_key", "_size", (F.col("_before") + F.col("_in")).alias("_sum")), "sums")


def cuts(sums: DataFrame, shards: int = SHARDS, grains: int = GRAINS, finer: int = FINER) -> tuple[int, list[int]]:
    """Capacity and running sums at the ends of the shards."""
    row = sums.agg(F.max("_sum"), F.max("_size")).first()
    total, largest = row[0] or 0, row[1] or 0
    if not total:
        return 0, []

    def ask(windows: list[tuple[int, int]] | None, width: int) -> np.ndarray:
        own = sums.where("_sum > 0") if windows is None else sums.where(_any(windows))
        # at most `grains` rows, or `finer` + 1 for each stretch that a cut may fall into
        found = own.groupBy(F.floor(F.col("_sum") / F.lit(width)).alias("_g")).agg(F.min("_sum"), F.max("_sum")).drop("_g").collect()
        return np.array(sorted((r[0], r[1]) for r in found), np.int64).reshape(-1, 2)

    return smallest(Ladder(ask, total, grains, finer), shards, largest)


def _any(windows: list[tuple[int, int]]) -> Column:
    """_sum lies in one of the closed windows; neighbouring ones are merged, so that Parquet skips what lies outside."""
    merged: list[list[int]] = []
    for a, b in sorted(windows):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out = F.lit(False)
    for a, b in merged:
        out = out | F.col("_sum").between(a, b)
    return out


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", name: str = "shard_id", grains: int = GRAINS, finer: int = FINER) -> DataFrame:
    """docs with the column shard_id, counted from 0 (in place of a column of that name)."""
    sums = running(docs, key)
    _, ends = cuts(sums, shards, grains, finer)
    # the last key of each shard but the last one; groups of no size belong with the group before them
    found = sums.where(F.col("_sum").isin(ends[:-1]) & F.col("_key").isNotNull()).groupBy("_sum").agg(F.max("_key").alias("_last")).collect() if len(ends) > 1 else []
    last = {r["_sum"]: r["_last"] for r in found}
    rest = docs.drop(name)
    if len(ends) < 2:
        return rest.withColumn(name, F.lit(0))
    k = F.col(f"`{key}`")
    keys = F.array(*[F.lit(last[e]) for e in ends[:-1] if e in last])
    skipped = sum(e not in last for e in ends[:-1])  # a shard that holds nothing but rows without key
    # binary search in a sorted list of `shards` keys
    return rest.withColumn(name, F.when(k.isNull(), 0).otherwise(F.lit(skipped) + _rank(keys, k, len(ends) - 1 - skipped)).cast("int"))


def _rank(keys: Column, k: Column, n: int) -> Column:
    """How many of the n sorted keys are less than k, by a balanced tree of comparisons."""
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(k > keys[mid], tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, n)


#: DuckDB: greedy filling folds over the list of sizes, binary search is a recursive query.
ORACLE_SQL = r"""
WITH RECURSIVE g AS (
  SELECT doc_id, sum(coalesce(strlen(text), 0))::BIGINT AS size FROM documents GROUP BY doc_id
), l AS (
  SELECT list(size ORDER BY doc_id NULLS FIRST) AS sizes, list(doc_id ORDER BY doc_id NULLS FIRST) AS ids, greatest(max(size), CAST(ceil(sum(size) / @N@) AS BIGINT)) AS lo, max(size) AS largest FROM g
), b(lo, hi) AS (
  SELECT lo, lo + largest FROM l
  UNION ALL
  SELECT CASE WHEN ok THEN lo ELSE mid + 1 END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT b.lo, b.hi, (b.lo + b.hi) // 2 AS mid,
      list_reduce(list_transform(l.sizes, lambda x: {'n': x, 'fill': 0::BIGINT}), lambda acc, x: CASE WHEN acc.fill + x.n > (b.lo + b.hi) // 2 THEN {'n': acc.n + 1, 'fill': x.n} ELSE {'n': acc.n, 'fill': acc.fill + x.n} END, {'n': 1::BIGINT, 'fill': 0::BIGINT}).n <= @N@ AS ok
    FROM b, l WHERE b.lo < b.hi)
), best AS (
  SELECT min(hi) AS cap FROM b WHERE lo = hi
), folded AS (
  SELECT ids, list_reduce(list_transform(sizes, lambda x: {'n': x, 'fill': 0::BIGINT, 'all': [0::BIGINT]}), lambda acc, x: CASE WHEN acc.fill + x.n > cap THEN {'n': acc.n + 1, 'fill': x.n, 'all': list_append(acc.all, acc.n + 1)} ELSE {'n': acc.n, 'fill': acc.fill + x.n, 'all': list_append(acc.all, acc.n)} END, {'n': 0::BIGINT, 'fill': 0::BIGINT, 'all': []::BIGINT[]}).all AS shards FROM l, best
), placed AS (
  SELECT unnest(ids) AS doc_id, unnest(shards)::INTEGER AS shard_id FROM folded
)
SELECT d.doc_id, coalesce(strlen(d.text), 0)::BIGINT AS n_bytes, p.shard_id FROM documents d JOIN placed p ON d.doc_id IS NOT DISTINCT FROM p.doc_id
""".replace("@N@", str(SHARDS))

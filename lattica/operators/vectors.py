"""Exact nearest neighbours of many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship

BLOCK = 2048
_SCHEMA = "query_id long, id long, score double"


def _blocks(df: DataFrame, tag: str, block: int) -> DataFrame:
    """(_tag, ids, vectors): the rows in about n / block blocks."""
    n = max(1, -(-df.count() // block))
    key = F.pmod(F.xxhash64("id"), F.lit(n)).alias("_block")
    return df.select(F.col("id").cast("long").alias("id"), "vector", key).where("id is not null and vector is not null").groupBy("_block").agg(F.collect_list("id").alias(f"_{tag}_ids"), F.collect_list("vector").alias(f"_{tag}_vectors")).drop("_block")


def _unit(vectors: pa.ListScalar) -> np.ndarray | None:
    rows = vectors.values
    flat, size = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64), rows.value_lengths().to_numpy(zero_copy_only=False)
    if len(set(size.tolist())) != 1:
        raise ValueError("vectors of unequal length")
    m = flat.reshape(len(size), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, np.nan)


def _best(s: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k highest of each row once rounded, ties to the smaller column. Only what can be among them is rounded and sorted: what is less than a rounding step below the k-th."""
    s = np.where(np.isnan(s), -np.inf, s)
    least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
    row, col = np.nonzero((s >= (least - 1.01 * 10.0**-digits)[:, None]) & (s > -np.inf))
    score = np.round(s[row, col], digits)
    order = np.lexsort((col, -score, row))
    row, col, score = row[order], col[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], score[keep]


def _top(k: int, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                qi, pi = (np.asarray(batch.column(c)[row].values.to_numpy(zero_copy_only=False)) for c in (0, 2))
                by_id = np.argsort(pi, kind="stable")
                pi = pi[by_id]
                row_, col, score = _best(_unit(batch.column(1)[row]) @ _unit(batch.column(3)[row])[by_id].T, k, digits)
                yield pa.RecordBatch.from_arrays([pa.array(qi[row_]), pa.array(pi[col]), pa.array(score)], names=["query_id", "id", "score"])

    return run


def knn_join(queries: DataFrame, points: DataFrame, k: int, block: int = BLOCK, digits: int = 6) -> DataFrame:
    """(query_id, id, score): of every query (id, vector) the k points (id, vector) of highest cosine, rounded; ties to the smaller id. Null and zero vectors have no neighbours.

    Queries and points are cut into blocks; each pair of blocks is one matrix product, wherever it runs, and gives at most k rows a query; these are merged by query."""
    spark = ship(queries.sparkSession)
    # every pair of partitions is a task that reads both from shuffle files; pairs themselves are never shuffled
    tasks = 2 * spark.sparkContext.defaultParallelism
    pairs = _blocks(queries, "q", block).repartition(tasks).crossJoin(_blocks(points, "p", block))
    found = pairs.select("_q_ids", "_q_vectors", "_p_ids", "_p_vectors").mapInArrow(_top(k, digits), _SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")

"""Snapshots, their differences, and tables kept current by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, op): added, modified or deleted paths between two snapshots (path, sha256)."""
    a = old.select("path", F.col("sha256").alias("_old"))
    b = new.select("path", F.col("sha256").alias("_new"))
    op = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    return a.join(b, "path", "full_outer").select("path", op.alias("op")).where("op is not null")


def to_process(changes: DataFrame) -> DataFrame:
    return changes.where("op in ('added', 'modified')").select("path")


def to_delete(changes: DataFrame) -> DataFrame:
    return changes.where("op in ('deleted', 'modified')").select("path")


def totals(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("op") == o).alias(f"n_{o}") for o in ("added", "modified", "deleted")], F.count("*").alias("n_total"))


def snapshot_of(nodes: DataFrame) -> DataFrame:
    """(path, sha256) of the file nodes."""
    return nodes.where("kind = 'file' and hash is not null").select(F.col("file").alias("path"), F.col("hash").alias("sha256"))


def version(files: DataFrame) -> DataFrame:
    """(version): a hash of all paths and hashes. Sums of row hashes are added up, so that nothing is gathered in one place."""
    h = F.sha2(F.concat_ws("\0", "path", "sha256"), 256)
    word = lambda i: F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(word(i)), F.lit(0)).cast("string") for i in range(8)]
    return files.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *sums), 256).alias("version"))


def replace(table: DataFrame, changes: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """table without the rows of deleted and modified paths (column key), with fresh rows."""
    gone = to_delete(changes).select(F.col("path").alias("_gone"))
    return table.join(gone, F.col(key) == F.col("_gone"), "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert(table: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """table with fresh rows in place of those of the same key."""
    return table.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)

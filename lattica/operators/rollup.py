"""Counts over graphs, files and modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..sources.shared import cut


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, name, n): nodes by type, edges by type, files, components; types that do not occur are left out."""
    n = nodes.groupBy(F.lit("nodes").alias("metric"), F.col("node_type").alias("name")).agg(F.count("*").alias("n"))
    k = nodes.where(F.col("kind").isin("file", "component")).groupBy(F.lit("kind").alias("metric"), F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    e = edges.groupBy(F.lit("edges").alias("metric"), F.col("edge_type").alias("name")).agg(F.count("*").alias("n"))
    return n.unionByName(k).unionByName(e)


def breakdown(nodes: DataFrame) -> DataFrame:
    """(node_type, kind, n) with a total for each type and one for all, in one pass."""
    return nodes.rollup("node_type", "kind").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def top_files(nodes: DataFrame, k: int = 10) -> DataFrame:
    """The k files with the most entities, files themselves not counted."""
    own = nodes.where("kind is null or kind <> 'file'").groupBy("file").agg(F.count("*").alias("n"))
    return own.orderBy(F.desc("n"), "file").limit(k)


def partition_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(partition_id, n_nodes, n_edges, n_cross): edges belong to the partition of their source. edges: src_partition, dst_partition."""
    n = nodes.groupBy("partition_id").agg(F.count("*").alias("n_nodes"))
    e = edges.groupBy(F.col("src_partition").alias("partition_id")).agg(F.count("*").alias("n_edges"), F.count_if(F.col("src_partition") != F.col("dst_partition")).alias("n_cross"))
    return n.join(e, "partition_id", "full_outer").na.fill(0, ["n_nodes", "n_edges", "n_cross"])


def module_structure(nodes: DataFrame, base: str, depth: int = 2, node_types: list[str] | None = None) -> DataFrame:
    """(path, depth, node_type, n_nodes, n_files) for every directory or file at most `depth` (1 to 3) levels under base; node_type null is the sum."""
    depth = min(3, max(1, depth))
    base = base if base.endswith("/") or not base else f"{base}/"
    own = nodes.where(F.col("file").startswith(base)) if base else nodes
    if node_types:
        own = own.where(F.col("node_type").isin(*node_types))
    parts = F.split(F.substring(F.col("file"), len(base) + 1, 1 << 30), "/")
    level = F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.size("_parts")))).alias("depth")
    flat = own.select("file", "node_type", parts.alias("_parts")).select("file", "node_type", "_parts", level)
    flat = flat.select("file", "node_type", "depth", F.array_join(F.slice("_parts", 1, F.col("depth")), "/").alias("path"))
    return flat.groupingSets([["path", "depth"], ["path", "depth", "node_type"]], "path", "depth", "node_type").agg(F.count("*").alias("n_nodes"), F.countDistinct("file").alias("n_files"))


def tree_stats(paths: DataFrame, path: str = "path") -> DataFrame:
    """(n_files, n_dirs, avg_depth): files, distinct directories above them, mean number of parts of a path."""
    parts = F.split(F.col(path), "/")
    p = paths.select(parts.alias("_p"))
    files = p.agg(F.count("*").alias("n_files"), F.avg(F.size("_p")).alias("avg_depth"))
    dirs = p.where(F.size("_p") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda i: F.array_join(F.slice("_p", F.lit(1), i), "/"))).alias("_d")).agg(F.countDistinct("_d").alias("n_dirs"))
    return files.crossJoin(dirs)  # one row each


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_partitions, n_files, n_nodes, n_edges, n_cross, n_bytes) of a stored graph, in one row; n_bytes is what it takes in memory."""
    n = nodes.agg(F.countDistinct("partition_id").alias("n_partitions"), F.countDistinct("file").alias("n_files"), F.count("*").alias("n_nodes"))
    e = edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("src_partition") != F.col("dst_partition")).alias("n_cross"))
    return n.crossJoin(e).withColumn("n_bytes", paths.memory_estimate(F.col("n_nodes"), F.col("n_edges")))  # one row each


def hit_rate(accesses: DataFrame) -> DataFrame:
    """(hits, misses, rate) of a table with a boolean `hit`; the rate of no accesses is 0."""
    h, m = F.count_if("hit"), F.count_if(~F.col("hit"))
    return accesses.agg(h.alias("hits"), m.alias("misses"), F.coalesce(F.try_divide(h, h + m), F.lit(0.0)).alias("rate"))


def evictions(entries: DataFrame, needed: int, keep: int = 2) -> DataFrame:
    """(id, n_bytes): the least recently used entries (id, last_access, n_bytes) until `needed` bytes are free; the `keep` most recent always stay."""
    recent = entries.select("id", "last_access").orderBy(F.desc("last_access"), F.desc("id")).limit(keep).select("id")
    ranked = running_sums(entries, ["last_access", "id"], "n_bytes", "_freed")
    return ranked.where(F.col("_freed") < needed).join(recent, "id", "left_anti").select("id", "n_bytes")


def worst_status(checks: DataFrame) -> DataFrame:
    """(n_pass, n_warn, n_fail, n_skip, overall) of a table with a column status."""
    count = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "warn", "fail", "skip")]
    worst = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    return checks.agg(*count, F.coalesce(F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), worst + 1), F.lit("pass")).alias("overall"))


def stale(nodes: Column, points: Column) -> Column:
    """is_stale of two columns."""
    return F.abs(nodes - points) > F.floor(nodes / 10)


def merged_stats(*stats: DataFrame) -> DataFrame:
    """Counts (metric, name, n) of several graphs, summed."""
    return reduce(DataFrame.unionByName, stats).groupBy("metric", "name").agg(F.sum("n").alias("n"))


def running_sums(rows: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over the rows before, in order, range by range: no task orders all of them. rows must be a stored table."""
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged)
    # one row a range
    parts = ranged.groupBy("_part").agg(F.sum(value).alias("_all"))
    before = parts.select("_part", F.coalesce(F.expr("sum(_all) over (order by _part rows between unbounded preceding and 1 preceding)"), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("_in", F.coalesce(F.sum(value).over(w), F.lit(0))).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def is_stale(n_nodes: int, n_points: int) -> bool:
    """Whether an index is off by more than a tenth."""
    return abs(n_nodes - n_points) > n_nodes // 10

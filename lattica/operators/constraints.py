"""Rules that every graph keeps; each gives rows (rule, id) for what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .traverse import on_cycles


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def structural(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids, names, files, lines and kinds are there, spans are not upside down, edges have ends."""
    own = ~F.coalesce(F.col("kind").isin("repository", "workspace", "component"), F.lit(False))
    rules = {"node id": _blank("id"), "node name": _blank("name"), "file": own & _blank("file"), "line": own & (F.coalesce(F.col("line"), F.lit(0)) < 1), "span": F.col("end_line") < F.col("line"), "kind": F.col("kind").isNull()}
    n = nodes.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))).alias("rule"))
    e = edges.where(_blank("source") | _blank("target")).select(F.concat_ws("->", "source", "target").alias("id"), F.lit("edge ends").alias("rule"))
    return n.unionByName(e).select("rule", "id")


def semantic(nodes: DataFrame) -> DataFrame:
    """The kind is one of its type."""
    return nodes.where(~paths.is_valid_kind(F.col("node_type"), F.col("kind"))).select(F.lit("kind of type").alias("rule"), "id")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Both ends of an edge exist."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").select(F.lit("dangling").alias("rule"), "id")


def containment(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Containment has no cycle, and what contains a file is a repository, component or workspace."""
    cycles = on_cycles(edges).select(F.lit("cycle").alias("rule"), "id")
    files = nodes.where("kind = 'file'").select(F.col("id").alias("_file"))
    above = edges.where("edge_type = 'CONTAINS'").join(files, F.col("target") == F.col("_file")).join(nodes.select(F.col("id").alias("_up"), F.col("kind").alias("_kind")), F.col("source") == F.col("_up"))
    bad = above.where(~F.col("_kind").isin("repository", "component", "workspace")).select(F.lit("file parent").alias("rule"), F.col("_file").alias("id"))
    return cycles.unionByName(bad)


def duplicates(edges: DataFrame) -> DataFrame:
    """No two edges have the same ends and type."""
    return edges.groupBy("source", "target", "edge_type").count().where("count > 1").select(F.lit("duplicate edge").alias("rule"), F.concat_ws("->", "source", "target").alias("id"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node but repositories and workspaces has an edge to it."""
    own = nodes.where("kind is null or kind not in ('repository', 'workspace')")
    return own.join(edges.select(F.col("target").alias("id")).distinct(), "id", "left_anti").select(F.lit("orphan").alias("rule"), "id")


def minimum_counts(counts: DataFrame, least: dict[str, int], tolerance: float = 0.1) -> DataFrame:
    """(name, n, least, ok): whether counts (name, n) reach their minimum less the tolerance; a missing count is 0."""
    want = counts.sparkSession.createDataFrame([(k, v) for k, v in least.items()], "name string, least long")
    out = want.join(counts.select("name", "n"), "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("ok", F.col("n") >= F.floor(F.col("least") * (1 - tolerance)))

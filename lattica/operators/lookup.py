"""Point lookups and edges of one or more nodes.

All of them are filters and joins on the full graph: an equality on id, file or
partition_id reaches the Parquet scan, so a table clustered by those columns is
read in part only. Limits come after a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

OUTGOING, INCOMING, BOTH = "outgoing", "incoming", "both"


def node(nodes: DataFrame, id_: str) -> DataFrame:
    """The node of an id. The file part of the id is a filter as well, so that files can be skipped by it."""
    file = id_.split(":", 1)[0]
    return nodes.where((F.col("id") == id_) & ((F.col("file") == file) | F.col("kind").isin("workspace", "repository", "component")))


def by_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.where(F.col("node_type") == node_type)


def by_file(nodes: DataFrame, file: str) -> DataFrame:
    return nodes.where(F.col("file") == file)


def by_partition(nodes: DataFrame, partition: str) -> DataFrame:
    return nodes.where(F.col("partition_id") == partition)


def edges_by(edges: DataFrame, edge_type: str | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
    for name, value in (("edge_type", edge_type), ("source", source), ("target", target)):
        if value is not None:
            edges = edges.where(F.col(name) == value)
    return edges


def type_filter(types: list[str] | None, node_type: str = "node_type", kind: str = "kind") -> Column:
    """Nodes of any of the types; `Type` and `Type:kind` are both understood, no types mean no filter."""
    if not types:
        return F.lit(True)
    out = F.lit(False)
    for t in types:
        a, _, b = t.partition(":")
        one = F.lower(F.col(node_type)) == a.lower()
        out = out | (one & (F.lower(F.col(kind)) == b.lower()) if b else one)
    return out


def find_nodes(nodes: DataFrame, pattern: str, node_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Nodes whose whole name matches a pattern where `*` is any text; other signs are those of regular expressions. Smallest ids first; an unknown type is no filter."""
    out = nodes.where(F.col("name").rlike(f"^{pattern.replace('*', '.*')}$"))
    if node_type and node_type.capitalize() in paths.KINDS:
        out = out.where(F.col("node_type") == node_type.capitalize())
    return out.orderBy("id").limit(limit) if limit else out


def _ends(edges: DataFrame, nodes: DataFrame, at: str) -> DataFrame:
    n = nodes.select(F.col("id").alias("node_id"), F.col("name").alias("node_name"), "node_type", "kind", "file", "line")
    return edges.join(n, F.col(at) == F.col("node_id"))


def outgoing(edges: DataFrame, nodes: DataFrame, id_: str | None = None, edge_type: str | None = None) -> DataFrame:
    """Edges with their target nodes, of one source or of all."""
    return _ends(edges_by(edges, edge_type, source=id_), nodes, "target")


def incoming(edges: DataFrame, nodes: DataFrame, id_: str | None = None, edge_type: str | None = None) -> DataFrame:
    """Edges with their source nodes, of one target or of all."""
    return _ends(edges_by(edges, edge_type, target=id_), nodes, "source")


def children(edges: DataFrame, nodes: DataFrame, id_: str | None = None) -> DataFrame:
    return outgoing(edges, nodes, id_, "CONTAINS")


def parent(edges: DataFrame) -> DataFrame:
    """(id, parent): the container of each node, the smallest id if there are several."""
    return edges.where("edge_type = 'CONTAINS'").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("parent"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other, edge_type, direction): every edge seen from each of its ends."""
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "edge_type", F.lit(OUTGOING).alias("direction"))
    back = edges.select(F.col("target").alias("id"), F.col("source").alias("other"), "edge_type", F.lit(INCOMING).alias("direction"))
    return out.unionByName(back)


def connected(edges: DataFrame, nodes: DataFrame, id_: str, edge_type: str | None = None, direction: str = BOTH) -> DataFrame:
    """Neighbours of a node, one row an edge; a loop gives two. An unknown edge type is no filter."""
    known = edge_type and {"contains": "CONTAINS", "uses": "USES", "defines": "DEFINES", "dependson": "DEPENDS_ON", "depends_on": "DEPENDS_ON"}.get(edge_type.lower())
    out = []
    if direction in (OUTGOING, BOTH):
        out.append(outgoing(edges, nodes, id_, known))
    if direction in (INCOMING, BOTH):
        out.append(incoming(edges, nodes, id_, known))
    if not out:
        raise ValueError(f"direction {direction!r}")
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def edges_of(edges: DataFrame, id_: str, edge_type: str | None = None, direction: str = BOTH) -> DataFrame:
    """Edges of a node, each once, with a map of what else they carry."""
    ends = {OUTGOING: F.col("source") == id_, INCOMING: F.col("target") == id_, BOTH: (F.col("source") == id_) | (F.col("target") == id_)}[direction]
    extra = F.map_filter(F.create_map(F.lit("ident"), F.col("ident"), F.lit("version_spec"), F.col("version_spec"), F.lit("is_dev_dependency"), F.col("is_dev_dependency").cast("string")), lambda k, v: v.isNotNull())
    return edges_by(edges, edge_type).where(ends).select("source", "target", "edge_type", "ref_line", extra.alias("metadata"))


def references(edges: DataFrame, nodes: DataFrame, id_: str, edge_types: list[str] | None = None, limit: int = 50, out: bool = False) -> DataFrame:
    """The first `limit` references to a node, or from it, by the other node and the line; `truncated` if the limit was reached."""
    e = edges if not edge_types else edges.where(F.col("edge_type").isin(*edge_types))
    found = (outgoing if out else incoming)(e, nodes, id_).select("node_id", "node_name", "node_type", "kind", "file", "line", "edge_type", "ref_line", "ident")
    found = found.orderBy("node_id", "edge_type", F.col("ref_line").asc_nulls_first(), "ident").limit(limit)
    return found.withColumn("truncated", F.expr("count(*) over ()") == limit)


def definitions(edges: DataFrame, nodes: DataFrame, id_: str, limit: int = 50) -> DataFrame:
    return references(edges, nodes, id_, ["DEFINES"], limit, out=True)


def guarded(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    ids = nodes.select("id")
    return edges.join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi")


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of `gone` (id) and their edges."""
    g = gone.select(F.col("id").alias("_gone")).distinct()
    rest = nodes.join(g, F.col("id") == F.col("_gone"), "left_anti")
    left = edges.join(g, F.col("source") == F.col("_gone"), "left_anti").join(g, F.col("target") == F.col("_gone"), "left_anti")
    return rest, left


def remove_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without all nodes of the files of `files` (path), and their edges."""
    gone = nodes.join(files.select(F.col("path").alias("_path")).distinct(), F.col("file") == F.col("_path"), "left_semi").select("id")
    return remove_nodes(nodes, edges, gone)


def node_info(nodes: DataFrame) -> DataFrame:
    """(id, info): JSON of a node; what is null is left out."""
    return nodes.select("id", F.to_json(F.struct("id", "name", F.col("node_type").alias("type"), "kind", "subtype", "file", "line", "end_line")).alias("info"))


def classify_edges(edges: DataFrame, node_partitions: DataFrame) -> DataFrame:
    """Edges with the partitions of both ends and whether they cross; edges without both are left out. node_partitions: id, partition_id."""
    a = node_partitions.select(F.col("id").alias("_a"), F.col("partition_id").alias("src_partition"))
    b = node_partitions.select(F.col("id").alias("_b"), F.col("partition_id").alias("dst_partition"))
    bare = edges.drop("src_partition", "dst_partition")
    out = bare.join(a, F.col("source") == F.col("_a")).join(b, F.col("target") == F.col("_b")).drop("_a", "_b")
    return out.withColumn("is_cross", F.col("src_partition") != F.col("dst_partition"))

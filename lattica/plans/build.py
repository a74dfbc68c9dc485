"""From files to graph: one pass over the files, then joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import resolve
from ..session import ship
from ..sources import extract, tree
from ..sources.shared import cut
from . import tables

#: Extracted rows, as they are kept for updates.
ROWS = "row string, id string, name string, node_type string, kind string, subtype string, file string, line int, end_line int, span_start int, span_end int, seq int, meta string, other string, hash string, text string"

#: Extracted rows are handed on when there are so many, whatever number of files Spark sends at once; of these so many are unpacked at a time.
GIVEN, PIECE = 2_000, 100


def _extract(batches: Iterator[pa.RecordBatch], rules: dict | None = None) -> Iterator[pa.RecordBatch]:
    import json

    kinds = [pa.int32() if t == "int" else pa.string() for t in (c.split()[1] for c in ROWS.split(", "))]
    names = [c.split()[0] for c in ROWS.split(", ")]
    rows: list[tuple] = []

    def give() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            for path, text, language, hash_ in zip(*(batch.column(i).slice(at, PIECE).to_pylist() for i in range(4)), strict=True):
                nodes, edges, refs = extract.build_file(path, text or "", language, (rules or {}).get(language, ()))
                for n in nodes:
                    rows.append(("node", n["id"], n["name"], n["node_type"], n["kind"], n["subtype"], path, n["line"], n["end_line"], *n["span"], n.get("seq", -1), json.dumps(n["metadata"]), None, hash_ if n["kind"] == "file" else None, n.get("text")))
                for a, b, kind in edges:
                    rows.append(("edge", a, None, None, kind, None, path, None, None, None, None, None, None, b, None, None))
                for name, source, line in refs:
                    rows.append(("ref", source, name, None, None, None, path, line, None, None, None, None, None, None, None, None))
                if len(rows) >= GIVEN:
                    yield give()
        if rows:
            yield give()


def extract_files(files: DataFrame, rules: dict | None = None) -> DataFrame:
    """Tagged rows (row: node, edge or ref) of all source files (path, content). rules: more declarations, by language."""
    own = tree.sources(files).select("path", "text", "language", F.sha2("content", 256).alias("hash"))
    ship(files.sparkSession)
    return own.mapInArrow(partial(_extract, rules=rules), ROWS)


def _node(df: DataFrame, root: str) -> DataFrame:
    file = F.coalesce("file", F.lit(""))
    return df.select(
        "id", "name", "node_type", "kind", "subtype", "file", "line", "end_line", "text", "hash",
        F.from_json(F.coalesce("meta", F.lit("{}")), tables.METADATA).alias("metadata"), "span_start", "span_end", F.lit(root).alias("root"), paths.partition_id(F.lit(root), file).alias("partition_id"),
    )


def _edge(df: DataFrame) -> DataFrame:
    """Edges with what changes of them are made by: `_file`, empty if they come from no source file, and `_name`, the name that was resolved."""
    have = dict(df.dtypes)
    types = {c.split()[0]: c.split()[1] for c in tables.EDGES.split(", ")[:7]}
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()], (F.col("file") if "file" in have else F.lit("")).alias("_file"), (F.when(F.col("edge_type") == "USES", F.col("ident")) if "ident" in have else F.lit(None)).cast("string").alias("_name"))


def build(files: DataFrame, repo: str, root: str | None = None, with_components: bool = True, include_data: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a repository. The extraction is written once to the shared folder, since several plans read it."""
    found = cut(tree.components(files, repo)) if with_components else None
    nodes, edges = graph(cut(extract_files(files)), repo, root, found, include_data)
    return nodes, edges.drop("_file", "_name")


def entities(rows: DataFrame, root: str) -> DataFrame:
    """Nodes of files and what is in them."""
    return _node(rows.where("row = 'node'"), root)


def structure(rows: DataFrame, repo: str) -> DataFrame:
    """CONTAINS and DEFINES edges of files and what is in them."""
    inner = rows.where("row = 'edge'").select(F.col("id").alias("source"), F.col("other").alias("target"), F.col("kind").alias("edge_type"), "file")
    files_of = rows.where("row = 'node' and kind = 'file'").select(F.lit(repo).alias("source"), F.col("id").alias("target"), F.lit("CONTAINS").alias("edge_type"), "file")
    return _edge(inner).unionByName(_edge(files_of))


def definitions(rows: DataFrame) -> DataFrame:
    """What names are resolved to."""
    return rows.where("row = 'node' and kind <> 'file'").select("name", "id", "file", F.col("span_start").alias("start_line"), F.col("span_end").alias("end_line"), "seq")


def references(rows: DataFrame) -> DataFrame:
    return rows.where("row = 'ref'").select("name", F.col("id").alias("source_id"), "line", "file")


def uses(refs: DataFrame, defs: DataFrame, nodes: DataFrame) -> DataFrame:
    return _edge(resolve.resolve_references(refs, defs, nodes))


def graph(rows: DataFrame, repo: str, root: str | None = None, components: DataFrame | None = None, include_data: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from extracted rows: the repository's node, files, entities, CONTAINS, DEFINES, USES, and components with DEPENDS_ON."""
    root = root or repo
    spark = rows.sparkSession
    if not include_data:
        data = rows.where("row = 'node' and node_type = 'Data'").select("id")
        rows = rows.where("node_type is null or node_type <> 'Data'").join(data.select(F.col("id").alias("other")), "other", "left_anti")
    top = spark.createDataFrame([(repo, repo, "Container", "repository")], "id string, name string, node_type string, kind string").selectExpr("id", "name", "node_type", "kind", "cast(null as string) subtype", "cast(null as string) file", "1 line", "1 end_line", "cast(null as int) span_start", "cast(null as int) span_end", "cast(null as string) meta", "cast(null as string) hash", "cast(null as string) text")
    nodes = entities(rows, root).unionByName(_node(top, root))
    edges = structure(rows, repo).unionByName(uses(references(rows), definitions(rows), nodes))
    if components is not None:
        n, e = component_graph(components, repo, root)
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    return nodes, edges


def affected_names(old: DataFrame, new: DataFrame, names: DataFrame) -> DataFrame:
    """(name): of the names those that are resolved otherwise by the definitions `new` than by `old`."""
    a, b = (resolve.last_definitions(d.join(names, "name", "left_semi")).withColumnRenamed("id", i) for d, i in ((old, "_a"), (new, "_b")))
    return a.join(b, "name", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("name")


def component_graph(components: DataFrame, repo: str, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes, CONTAINS and DEPENDS_ON of components."""
    meta = F.to_json(F.struct("is_workspace_root", "manifest_path", F.lit(True).alias("is_publishable")))
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    rows = components.select(F.col("node_id").alias("id"), "name", F.lit("Container").alias("node_type"), F.lit("component").alias("kind"), F.col("ecosystem").alias("subtype"), F.col("manifest_path").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("end_line"), none("int", "span_start"), none("int", "span_end"), meta.alias("meta"), none("string", "hash"), none("string", "text"))
    rows = resolve.last_wins(rows, ["id"], ["file"])
    above = resolve.component_parents(components, repo).select(F.col("parent").alias("source"), F.col("node_id").alias("target"), F.lit("CONTAINS").alias("edge_type")).distinct()
    return _node(rows, root or repo), _edge(above).unionByName(_edge(resolve.dependency_edges(components)))


def build_workspace(spark, path: str, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All roots of a workspace as one graph. With several roots the ids of each are prefixed by its path, so that equal paths in two roots stay apart, and a workspace node contains them."""
    import os
    from functools import reduce

    roots = tree.discover_roots(path)
    name = name or os.path.basename(os.path.abspath(path))
    if len(roots) == 1 and roots[0]["path"] == ".":
        return build(tree.scan(spark, path), name)
    parts = []
    for r in roots:
        files = tree.scan(spark, os.path.join(path, r["path"])).withColumn("path", F.concat(F.lit(f"{r['path']}/"), "path"))
        parts.append(build(files, r["path"], r["name"]))
    first = parts[0][0].limit(0)
    top = first.unionByName(spark.createDataFrame([(f"workspace:{name}", name, "Container", "workspace", name, f"{name}_root")], "id string, name string, node_type string, kind string, root string, partition_id string"), allowMissingColumns=True)
    links = _edge(spark.createDataFrame([(f"workspace:{name}", r["path"], "CONTAINS") for r in roots], "source string, target string, edge_type string")).drop("_file", "_name")
    nodes = reduce(DataFrame.unionByName, [p[0] for p in parts] + [top])
    return nodes, reduce(DataFrame.unionByName, [p[1] for p in parts] + [links])

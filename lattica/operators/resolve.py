"""Joins that turn names, spans and paths into edges."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths


def last_definitions(definitions: DataFrame) -> DataFrame:
    """(name, id): of each name the definition that comes last in order of file, start, end and seq. definitions: name, id, file, start_line, end_line, seq."""
    return definitions.groupBy("name").agg(F.max_by("id", F.struct("file", "start_line", "end_line", "seq", "id")).alias("id"))


def resolve_references(references: DataFrame, definitions: DataFrame, nodes: DataFrame) -> DataFrame:
    """USES edges (source, target, edge_type, ref_line, ident) of references (name, source_id, line) to the last definition of their name; none to itself or from a source that does not exist. Where references have a column file, so has the result.

    The side of the definitions has one row a name, so a popular name is skewed on one side only, which AQE splits."""
    names = last_definitions(definitions).withColumnRenamed("id", "target")
    hit = references.join(names, "name").where(F.col("source_id") != F.col("target"))
    hit = hit.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return hit.select(F.col("source_id").alias("source"), "target", F.lit("USES").alias("edge_type"), F.col("line").alias("ref_line"), F.col("name").alias("ident"), *(["file"] if "file" in references.columns else [])).distinct()


#: Lines of a file that one group of `enclosing` covers.
STRIP = 4096


def _sweep(points: list[int], spans: list[tuple[int, int, object]]) -> list[object]:
    """For each of the points, ascending, the id of the narrowest of the spans (start, end, id), ascending, that cover it; of equal ones that of the later start, then the smaller id."""
    out, live, i = [], [], 0
    for p in points:
        while i < len(spans) and spans[i][0] <= p:
            start, end, id_ = spans[i]
            heapq.heappush(live, (end - start, -start, id_, end))
            i += 1
        while live and live[0][3] < p:  # it covers no later point either
            heapq.heappop(live)
        out.append(live[0][2] if live else None)
    return out


def enclosing(points: DataFrame, spans: DataFrame, strip: int = STRIP) -> DataFrame:
    """Points (point_id, file, line) with the narrowest span (span_id, file, start_line, end_line) of their file that covers them; null if none does. Ties go to the later start, then to the smaller id. Points without file or line, and spans without file or an end, match nothing.

    Equal lines and equal spans are first made one, so that what is compared does not depend on how many rows a place has. A span that reaches over whole strips of lines is put in each of them only if no narrower one does as well, the others where they begin and end; a strip of a file is swept once, in order of lines."""
    kind = spans.schema["span_id"].dataType.simpleString()
    low, high = F.floor(F.col("start_line") / strip), F.floor(F.col("end_line") / strip)
    own = spans.where("file is not null and start_line <= end_line").groupBy("file", "start_line", "end_line").agg(F.min("span_id").alias("span_id"))
    own = own.select("*", F.explode(F.sequence(low, high)).alias("_b"))
    # of the spans over all of a strip only the best can be an answer there
    inside = (F.col("start_line") > F.col("_b") * strip) | (F.col("end_line") < (F.col("_b") + 1) * strip - 1)
    best = F.min_by(F.struct("start_line", "end_line", "span_id"), F.struct(F.col("end_line") - F.col("start_line"), -F.col("start_line"), "span_id"))
    over = own.where(~inside).groupBy("file", "_b").agg(best.alias("_s")).select("file", "_b", "_s.*")
    s = own.where(inside).select("file", "_b", "start_line", "end_line", "span_id").unionByName(over)
    p = points.where("file is not null and line is not null").select("file", F.col("line").cast("long").alias("line")).distinct()
    rows = s.select("file", "_b", F.col("start_line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end"), "span_id", F.lit(False).alias("_p"))
    rows = rows.unionByName(p.select("file", F.floor(F.col("line") / strip).alias("_b"), "line", F.lit(0).cast("long").alias("end"), F.lit(0).cast(kind).alias("span_id"), F.lit(True).alias("_p")))

    def run(key, rows):
        at = rows.loc[rows["_p"], "line"].sort_values()
        ordered = rows[~rows["_p"]].sort_values(["line", "end"])
        found = _sweep([int(x) for x in at], [(int(a), int(b), c) for a, b, c in zip(ordered["line"], ordered["end"], ordered["span_id"], strict=True)])
        return pd.DataFrame({"file": key[0], "line": at.to_numpy(), "span_id": pd.Series(found, dtype=object)})

    hit = rows.groupBy("file", "_b").applyInPandas(run, f"file string, line long, span_id {kind}").where("span_id is not null")
    found = hit.select(F.col("file").alias("_f"), F.col("line").alias("_l"), "span_id")
    return points.join(found, (F.col("file") == F.col("_f")) & (F.col("line") == F.col("_l")), "left").select("point_id", "file", "line", "span_id")


def matches_pattern(directory: str, pattern: str, base: str):
    """Whether a directory matches a workspace member pattern seen from base: `x/*` is all below x, any other `*` what begins like it, else the same directory."""
    d, p = F.col(directory), F.col(pattern)
    full = F.when(F.col(base) == "", p).otherwise(F.concat_ws("/", base, p))
    head = F.substring_index(full, "*", 1)
    stem = F.regexp_replace(full, r"/\*$", "")
    return F.when(full.endswith("/*"), d.startswith(stem) & (d != stem)).when(full.contains("*"), d.startswith(head)).otherwise(d == full)


def members(directories: DataFrame, patterns: DataFrame) -> DataFrame:
    """(directory, pattern): pairs that match. patterns: pattern, base. The patterns of manifests are few, yet their side is broadcast only if Spark finds it small."""
    return directories.join(patterns, matches_pattern("directory", "pattern", "base")).select("directory", "pattern")


def component_parents(components: DataFrame, repo_id: str) -> DataFrame:
    """(node_id, parent): the first workspace root, by directory, one of whose members a component is; else the repository."""
    roots = components.where("is_workspace_root").select(F.col("node_id").alias("_root"), F.col("directory").alias("_base"), F.explode("workspace_members").alias("_pattern"))
    own = components.select("node_id", "directory")
    hit = own.join(roots, matches_pattern("directory", "_pattern", "_base") & (F.col("node_id") != F.col("_root")), "left")
    return hit.groupBy("node_id").agg(F.min(F.struct("_base", "_root")).alias("_m")).select("node_id", F.coalesce("_m._root", F.lit(repo_id)).alias("parent"))


def dependency_edges(components: DataFrame) -> DataFrame:
    """DEPENDS_ON edges of the local dependencies: to the component in the directory their path leads to, or that is their path; workspace dependencies without either to the smallest id whose directory is named like them or whose own name is, scope aside."""
    # a dependency is known by what it says: its rows may come in another order each time they are read
    said = F.to_json(F.struct("node_id", "directory", "_d")).alias("_n")
    deps = components.select("node_id", "directory", F.explode("local_dependencies").alias("_d")).select("*", paths.normal_path(F.col("directory"), F.coalesce("_d.path", F.lit(""))).alias("_path"), said).dropDuplicates(["_n"])
    at = components.groupBy(F.col("directory").alias("_dir")).agg(F.max("node_id").alias("_to"))
    # a project reference leads to a file: its directory counts
    dirs = F.array_distinct(F.array("_path", F.col("_d.path"), F.regexp_replace("_path", "/[^/]*$", "")))
    by_path = deps.where("_d.path is not null").select("*", F.posexplode(dirs).alias("_i", "_try")).join(at, F.col("_try") == F.col("_dir")).groupBy("_n").agg(F.min_by("_to", "_i").alias("_to"))
    rest = deps.where("_d.dep_type = 'workspace'").join(by_path, "_n", "left_anti")
    named = components.select(F.col("node_id").alias("_id"), F.explode(F.array_distinct(F.array(F.col("name"), F.regexp_extract("name", "([^/]*)$", 1), F.regexp_extract("directory", "([^/]*)$", 1)))).alias("_name"))
    by_name = rest.select("_n", F.explode(F.array_distinct(F.array(F.col("_d.name"), F.regexp_extract("_d.name", "([^/]*)$", 1)))).alias("_want")).join(named, F.col("_want") == F.col("_name")).groupBy("_n").agg(F.min("_id").alias("_to"))
    found = deps.join(by_path.unionByName(by_name), "_n").where("_to <> node_id")
    spec = paths.version_spec(F.col("_d.dep_type"), F.col("_d.path"), F.col("_d.version_spec"))
    return found.select(F.col("node_id").alias("source"), F.col("_to").alias("target"), F.lit("DEPENDS_ON").alias("edge_type"), F.col("_d.name").alias("ident"), spec.alias("version_spec"), F.col("_d.is_dev").alias("is_dev_dependency")).distinct()


def affected(files: DataFrame, components: DataFrame, by_directory: bool = True) -> DataFrame:
    """(path, node_id): components that a changed file (path) belongs to: those whose directory is above it, or, not by directory, whose manifest it is."""
    at = components.select("node_id", "directory", "manifest_path")
    if not by_directory:
        return files.join(at, F.col("path") == F.col("manifest_path")).select("path", "node_id")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    # equality with each directory above, not a prefix join
    return files.select("path", F.explode(above).alias("_dir")).join(at, F.col("_dir") == F.col("directory")).select("path", "node_id")


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """left with `value` of the last row of right, with the same `by`, at or before its time; null if there is none. Of several at that time the largest value counts. Rows are merged in one ordered pass of each group of `by`."""
    both = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).unionByName(right.select(*by, time, F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(time, "_side", F.col("_v")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*left.columns, value)


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last in the given order."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """Edges without repetition of (source, target, edge_type, ref_line); those without line are never repetitions."""
    lined = edges.where("ref_line is not null").dropDuplicates(["source", "target", "edge_type", "ref_line"])
    return lined.unionByName(edges.where("ref_line is null"))

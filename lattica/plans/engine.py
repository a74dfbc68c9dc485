"""The engine: one workspace's graph, vectors, queries and updates."""

from __future__ import annotations

import json
import os
import re
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embed, paths, text
from ..operators import changes, lookup, resolve, rollup, search, traverse
from ..sources import extract, tree, walk
from ..sources.shared import cut, scope
from ..sources.store import Store, gone_by
from . import build, describe

POINTS = ("points_semantic", "points_code")


class NotFound(KeyError):
    pass


class Engine:
    """A workspace at `path`, whose tables are in `store`. `name` is its repo_id, `rules` a folder of rules for more declarations (`extract.load_rules`)."""

    def __init__(self, spark: SparkSession, path: str, store: str | None = None, name: str | None = None, provider: embed.Provider | None = None, exclude: tuple[str, ...] = (), rules: str | None = None):
        self.spark, self.path, self.exclude = spark, path, exclude
        self.rules = extract.load_rules(rules) if rules else {}
        self.name = name or re.split(r"[/\\]", path.rstrip("/\\"))[-1]
        self.store = Store(spark, store or f"{path.rstrip('/')}/.lattica")
        self.provider = provider or embed.Hashing()

    # Tables

    @property
    def nodes(self) -> DataFrame:
        return self.store.read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.store.read("edges")

    def files(self) -> DataFrame:
        return tree.scan(self.spark, self.path, exclude=self.exclude)

    def views(self) -> None:
        """nodes, edges, files and points as temporary views for spark.sql."""
        for t in ("nodes", "edges", "files", *POINTS):
            self.store.read(t).createOrReplaceTempView(t)

    # Building

    def rebuild(self) -> dict:
        """The whole graph and snapshot anew."""
        with scope():
            files = self.files()
            snap = cut(tree.snapshot(files, self.name))
            if snap.limit(1).isEmpty():
                raise NotFound(f"no files below {self.path}")
            rows = cut(build.extract_files(files, self.rules))
            return self.store.save_graph(*build.graph(rows, self.name, components=self._components(snap)), snap, {"version": changes.version(snap).first()[0]}, rows=rows)

    def _components(self, snap: DataFrame) -> DataFrame:
        manifests = snap.where(paths.manifest_language(F.col("path")).isNotNull())
        return cut(tree.components(tree.read(manifests, self.path), self.name))

    def graph_version(self) -> str:
        return changes.version(self.store.read("files")).first()[0]

    def changes(self) -> DataFrame:
        """(path, op) of the tree against the last snapshot."""
        return changes.diff(self.store.read("files"), tree.snapshot(self.files(), self.name))

    def update(self, force: bool = False) -> dict:
        """Bring the graph up to date: only changed files are parsed again, only names that now mean something else are resolved again, and only that is written; the result is that of rebuild()."""
        if force or not self.store.exists("nodes"):
            return {"full": True, **self.rebuild()}
        with scope():
            snap = cut(tree.snapshot(self.files(), self.name))
            found = cut(changes.diff(self.store.read("files"), snap))
            n = changes.totals(found).first().asDict()
            if not n["n_total"]:
                return {"full": False, **n}
            self._patch(snap, found, min(4 * self.spark.sparkContext.defaultParallelism, 1 + n["n_total"] // 100))
            if self.store.exists(POINTS[0]):
                self.index(found)
            return {"full": False, **n}

    def _patch(self, snap: DataFrame, found: DataFrame, tasks: int) -> None:
        """Write what a change set (path, op) changes in the tables; `tasks` read its files."""
        spark, touched = self.spark, found.select("path")
        gone = lambda *keys: reduce(DataFrame.unionByName, keys)
        by_file = lambda key: touched.select(F.lit(key).alias("key"), F.col("path").alias("value"))
        fresh = cut(build.extract_files(tree.read(changes.to_process(found), self.path, tasks), self.rules))
        old = self.store.read("rows")
        kept = old.join(touched, F.col("file") == F.col("path"), "left_anti")
        now = kept.unionByName(fresh)
        before = old.join(touched, F.col("file") == F.col("path"), "left_semi")
        names = before.unionByName(fresh).where("row = 'node'").select("name").distinct()
        names = cut(build.affected_names(build.definitions(old), build.definitions(now), names))
        refs = build.references(fresh).unionByName(build.references(kept).join(names, "name", "left_semi"))
        edges = build.structure(fresh, self.name).unionByName(build.uses(refs, build.definitions(now), now.where("row = 'node'")))
        nodes = build.entities(fresh, self.name)
        gone_nodes, gone_edges = [by_file("file")], [by_file("_file"), names.select(F.lit("_name").alias("key"), F.col("name").alias("value"))]
        if not found.where(paths.manifest_language(F.col("path")).isNotNull()).isEmpty():
            n, e = build.component_graph(self._components(snap), self.name)
            nodes, edges = nodes.unionByName(n), edges.unionByName(e)
            gone_nodes.append(gone_by(spark, "kind", ["component"]))
            gone_edges.append(gone_by(spark, "_file", [""]))
            kept_nodes = self.nodes.where("kind <> 'component'")
        else:
            kept_nodes = self.nodes
        nodes = cut(nodes)
        ends = kept_nodes.join(touched, F.col("file") == F.col("path"), "left_anti").unionByName(nodes)
        self.store.commit(
            changes={
                "rows": (fresh, by_file("file")),
                "nodes": (nodes, gone(*gone_nodes)),
                "edges": (lookup.classify_edges(edges, ends), gone(*gone_edges)),
                "files": (snap.join(changes.to_process(found), "path", "left_semi"), by_file("path")),
            },
            meta={"version": changes.version(snap).first()[0]},
        )

    # Vectors

    def _points(self, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The rows of both tables of points, without their vectors."""
        nodes = self.nodes.withColumn("content", F.coalesce("text", F.lit("")))
        own = nodes.where("kind is null or kind not in ('file', 'repository')").where("trim(content) <> ''")
        if only is not None:
            own = own.join(only, F.col("file") == F.col("path"), "left_semi")
        full = describe.describe(nodes, self.edges, own)
        base = full.select(F.lit(self.name).alias("repo_id"), F.xxhash64("id", F.lit(self.name)).alias("point_id"), F.col("id").alias("entity_id"), "name", F.col("node_type").alias("type"), "kind", "subtype", F.col("file").alias("file_path"), F.col("line").alias("start_line"), F.col("end_line"), "content", "semantic_text")
        base = cut(base)
        return base, base.drop("semantic_text")

    def index(self, found: DataFrame | None = None, force: bool = True) -> dict:
        """Vectors of all entities, or of the files of a change set, whose old ones go. Returns how many entities there are to index, how many have vectors of either kind, and how many were left without (their batch failed)."""
        if not force and self.store.exists(POINTS[0]):
            return {"indexed": 0}
        with scope():
            meta = {"indexed_version": self.store.meta("version"), "indexed_at": str(int(time.time()))}
            only = changes.to_process(found) if found is not None else None
            fresh = dict(zip(POINTS, self._points(only), strict=True))
            # vectors are made of rows in order, once: finding out that order reads the rows a first time
            vectors = (embed.embed(F.col("semantic_text"), self.provider), embed.embed(F.col("content"), self.provider, code=True))
            late = {n: {"vector": v} for n, v in zip(POINTS, vectors, strict=True)}
            if found is None:
                self.store.commit(fresh, meta=meta, late=late)
            else:
                gone = found.select(F.lit("file_path").alias("key"), F.col("path").alias("value"))
                self.store.commit(changes={n: (df, gone) for n, df in fresh.items()}, meta=meta, late=late)
        counts = {n: self.store.read(n).agg(F.count("*"), F.count("vector")).first() for n in POINTS}
        return {"indexed": min(c[1] for c in counts.values()), "total": counts[POINTS[0]][0], "failed": max(c[0] - c[1] for c in counts.values())}

    def index_status(self) -> dict:
        counts = {n: self.store.read(n).count() if self.store.exists(n) else 0 for n in POINTS}
        return counts | {"version": self.store.meta("version"), "indexed_version": self.store.meta("indexed_version"), "needs_reindex": self.needs_reindex()}

    def needs_reindex(self) -> bool:
        return self.store.meta("version") != self.store.meta("indexed_version")

    def delete_points(self) -> None:
        for n in POINTS:
            self.store.drop(n)

    # Queries

    def search(self, query: str, limit: int = 10, mode: str | None = None, types: list[str] | None = None, min_score: float = 0.0, file_patterns: tuple[str, ...] = ()) -> DataFrame:
        s, c = (self.store.read(n) for n in POINTS)
        for p in file_patterns:
            s, c = (x.where(F.col("file_path").rlike(paths.glob_regex(p))) for x in (s, c))
        a, b = self.provider.encode([query])[0].tolist(), self.provider.encode([query], code=True)[0].tolist()
        return search.by_mode(mode, s, c, query, a, b, limit, types).where(F.col("score") >= min_score)

    def node(self, id_: str) -> dict:
        row = lookup.node(self.nodes, id_).first()
        if row is None:
            raise NotFound(id_)
        return row.asDict(recursive=True)

    def find_nodes(self, pattern: str, node_type: str | None = None, limit: int = 100) -> DataFrame:
        return lookup.find_nodes(self.nodes, pattern, node_type, limit)

    def connected(self, id_: str, edge_type: str | None = None, direction: str = "both") -> DataFrame:
        return lookup.connected(self.edges, self.nodes, id_, edge_type, direction)

    def edges_of(self, id_: str, edge_type: str | None = None, direction: str = "both") -> DataFrame:
        return lookup.edges_of(self.edges, id_, edge_type, direction)

    def find_references(self, id_: str, edge_types: list[str] | None = None, limit: int = 50) -> DataFrame:
        return lookup.references(self.edges, self.nodes, id_, edge_types, limit)

    def find_outgoing_references(self, id_: str, edge_types: list[str] | None = None, limit: int = 50) -> DataFrame:
        return lookup.references(self.edges, self.nodes, id_, edge_types, limit, out=True)

    def find_definitions(self, id_: str, limit: int = 50) -> DataFrame:
        return lookup.definitions(self.edges, self.nodes, id_, limit)

    def call_chain(self, id_: str, direction: str = "upstream", depth: int = 3, chains: int = 5, edge_types: list[str] | None = None) -> DataFrame:
        if direction not in ("upstream", "downstream", "both"):
            raise ValueError(f"direction {direction!r}")
        start = self.nodes.where(F.col("id") == id_).select("id")
        ways = [w for w in ("upstream", "downstream") if direction in (w, "both")]
        found = [traverse.chains(self.edges, start, depth, edge_types, w == "upstream", chains).withColumn("direction", F.lit(w)) for w in ways]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def module_structure(self, base: str, depth: int = 2, node_types: list[str] | None = None) -> DataFrame:
        return rollup.module_structure(self.nodes, base, depth, node_types).orderBy("path", F.col("node_type").asc_nulls_first())

    def read_code(self, id_: str, context: int = 0, span: bool = False, most: int = 100) -> str:
        n = self.node(id_)
        first, last = (n["span_start"] or n["line"], n["span_end"] or n["end_line"]) if span else (n["line"], n["end_line"])
        return self.read_file(n["file"], first, last, context, most)

    def read_file(self, path: str, first: int, last: int, context: int = 0, most: int | None = None) -> str:
        content = walk.Disk(self.path).read(path)  # one file
        if content is None:
            raise NotFound(path)
        one = self.spark.createDataFrame([(content.decode("utf-8", "replace"),)], "content string")
        return one.select(text.lines(F.col("content"), F.lit(first), F.lit(last), context, most).alias("t")).first()["t"]

    def graph_stats(self) -> DataFrame:
        return rollup.graph_stats(self.nodes, self.edges)

    # Components

    def components(self, roots_only: bool = False, ecosystem: str | None = None) -> DataFrame:
        c = self.nodes.where("kind = 'component'")
        c = c.where("metadata.is_workspace_root") if roots_only else c
        return c.where(F.col("file").contains(ecosystem) | (F.col("subtype") == ecosystem)) if ecosystem else c

    def dependencies(self, id_: str, transitive: bool = False, reverse: bool = False) -> DataFrame:
        start = self.nodes.where(F.col("id") == id_).select("id")
        return traverse.dependencies(self.edges, start, 10 if transitive else 1, reverse)

    def affected(self, changed: list[str], by_directory: bool = True) -> DataFrame:
        """(id): components of changed paths, and all that depend on them."""
        c = self.components().select(F.col("id").alias("node_id"), F.col("file").alias("manifest_path"), paths.directory(F.col("file")).alias("directory"))
        hit = resolve.affected(self.spark.createDataFrame([(p,) for p in changed], "path string"), c, by_directory)
        return traverse.reachable(self.edges, hit.select(F.col("node_id").alias("id")).distinct(), ["DEPENDS_ON"], upstream=True).select("id").distinct()

    def component_graph(self, form: str = "dot", include: list[str] | None = None, exclude: list[str] | None = None) -> str:
        """Components and their dependencies, drawn; there is a row for every manifest of the workspace. Only between components of the names in include, if given, and not of those in exclude."""
        names = self.components().select("id", "name")
        e = self.edges.where("edge_type = 'DEPENDS_ON'").join(names.toDF("source", "a"), "source").join(names.toDF("target", "b"), "target")
        keep = lambda a, b: (not include or (a in include and b in include)) and not (exclude and (a in exclude or b in exclude))
        return traverse.draw([(r.a, r.b) for r in e.select("a", "b").distinct().collect() if keep(r.a, r.b)], form)

    # Health

    def doctor(self) -> list[tuple[str, str, str]]:
        """(check, status, message); what depends on a failed check is skipped."""
        out = [("workspace", "pass" if os.path.isdir(self.path.removeprefix("file://")) else "fail", self.path)]
        ok, said = self.provider.status()
        out.append(("provider", "pass" if ok else "warn", said))
        try:
            graph = self.store.exists("nodes")
            out.append(("schema", "pass", ""))
        except ValueError as e:
            return [*out, ("schema", "fail", str(e)), ("graph", "skip", ""), ("index", "skip", "")]
        if not graph:
            return [*out, ("graph", "fail", "not built"), ("index", "skip", "")]
        n = self.nodes.where("kind not in ('file', 'repository')").count()
        out.append(("graph", "pass" if n else "warn", f"{n} entities"))
        if not self.store.exists(POINTS[0]):
            return [*out, ("index", "warn", "not indexed")]
        m = self.store.read(POINTS[0]).count()
        out.append(("index", "warn" if rollup.is_stale(n, m) or self.needs_reindex() else "pass", f"{m} points"))
        return out


class Workspaces:
    """Several engines by name, kept in a JSON file, and asked as one."""

    def __init__(self, spark: SparkSession, registry: str):
        self.spark, self.at = spark, registry
        self.engines: dict[str, Engine] = {}
        self.kept = {"workspaces": {}, "active": None}
        if os.path.exists(registry):
            with open(registry) as f:
                self.kept = json.load(f)

    def _save(self) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.at)), exist_ok=True)
        with open(self.at, "w") as f:
            json.dump(self.kept, f, indent=1, sort_keys=True)

    def register(self, name: str, path: str) -> str:
        full = os.path.realpath(path)
        if not os.path.isdir(full):
            raise NotFound(path)
        self.kept["workspaces"][name] = full
        self.engines.pop(name, None)
        self._save()
        return full

    def unregister(self, name: str) -> bool:
        gone = self.kept["workspaces"].pop(name, None) is not None
        self.engines.pop(name, None)
        if self.kept["active"] == name:
            self.kept["active"] = None
        self._save()
        return gone

    def set_active(self, name: str) -> None:
        if name not in self.kept["workspaces"]:
            raise NotFound(name)
        self.kept["active"] = name
        self._save()

    @property
    def active(self) -> str | None:
        return self.kept["active"]

    def engine(self, name: str) -> Engine:
        if name not in self.kept["workspaces"]:
            raise NotFound(name)
        if name not in self.engines:
            self.engines[name] = Engine(self.spark, self.kept["workspaces"][name], name=name)
        return self.engines[name]

    def list(self) -> list[dict]:
        return [{"name": n, "path": p, "active": n == self.active, "has_graph": self.engine(n).store.exists("nodes"), "has_index": self.engine(n).store.exists(POINTS[0])} for n, p in sorted(self.kept["workspaces"].items())]

    @staticmethod
    def discover(root: str, depth: int = 3) -> list[str]:
        """Directories, down to depth, that hold a graph or a git repository."""
        out = []
        for at, dirs, _ in os.walk(root):
            level = 0 if at == root else os.path.relpath(at, root).count(os.sep) + 1
            if ".git" in dirs or ".lattica" in dirs:
                out.append(at)
            dirs[:] = sorted(d for d in dirs if not d.startswith(".")) if level < depth else []
        return sorted(out)

    def register_discovered(self, found: list[str], prefix: str | None = None) -> int:
        for p in found:
            name = os.path.basename(p.rstrip("/"))
            self.register(f"{prefix}/{name}" if prefix else name, p)
        return len(found)

    def _ready(self, table: str) -> list[tuple[str, Engine]]:
        return [(n, self.engine(n)) for n in sorted(self.kept["workspaces"]) if self.engine(n).store.exists(table)]

    def search(self, query: str, limit: int = 10, **options) -> DataFrame:
        """The best of all indexed workspaces; each is asked for twice the limit."""
        hits = None
        for name, e in self._ready(POINTS[0]):
            h = e.search(query, 2 * limit, **options).select(F.lit(name).alias("workspace"), F.col("entity_id").alias("id"), "score")
            hits = h if hits is None else hits.unionByName(h)
        if hits is None:
            return self.spark.createDataFrame([], "id string, workspace string, score double")
        return search.merge_workspaces(hits, limit)

    def find_nodes(self, pattern: str, node_type: str | None = None, limit: int = 100) -> DataFrame:
        out = None
        for name, e in self._ready("nodes"):
            n = e.find_nodes(pattern, node_type, limit).withColumn("id", paths.prefixed(F.lit(name), F.col("id")))
            out = n if out is None else out.unionByName(n)
        return out.orderBy("id").limit(limit) if out is not None else self.spark.createDataFrame([], "id string, name string")

    def graph_stats(self) -> DataFrame:
        """Counts summed over the workspaces."""
        out = None
        for _, e in self._ready("nodes"):
            out = e.graph_stats() if out is None else out.unionByName(e.graph_stats())
        if out is None:
            return self.spark.createDataFrame([], "metric string, name string, n long")
        return rollup.merged_stats(out)

    def index_status(self) -> dict:
        """Counts of vectors summed over the workspaces, and which of them must be indexed again."""
        found = {n: e.index_status() for n, e in self._ready("nodes")}
        return {**{p: sum(s[p] for s in found.values()) for p in POINTS}, "workspaces": len(found), "needs_reindex": sorted(n for n, s in found.items() if s["needs_reindex"])}

    def node(self, id_: str) -> dict:
        """By a prefixed id, or in the active workspace."""
        name, sep, rest = id_.partition("::")
        return self.engine(name).node(rest) if sep else self.engine(self.active or "").node(id_)

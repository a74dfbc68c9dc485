"""Queries over a source tree that is written from the driver's tables, each with the SQL that says what must come out.

A supplier is a Python file with a class in the directory of its nation (every tenth
begins with an underscore), a nation is a package with one function and a manifest that
depends on the next nation. Beside them lie files that must not be found: built, hidden
and ignored ones. The tree, and the store of the engine that read it, are made once a
session and table folder; they lie in the shared folder.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, text
from .operators import lookup, resolve, rollup, traverse
from .plans import describe
from .plans.engine import Engine
from .queries import _query, _read
from .session import ship
from .sources import tree
from .sources.shared import cut, place
from .sources.store import Store

SUPPLIER = "class S{k}(Base):\n    def total(self, amount):\n        return nation{n}(amount)\n\n    def _low{k}(self):\n        return self.total({k})\n\n\nLIMIT{k} = {k}\n"
NATION = "def nation{n}(x):\n    return x\n"
MANIFEST = '{"name":"@t/n{n}","version":"1.{n}.0","dependencies":{"@t/n{m}":"workspace:*"}}'
BASE, TOP, IGNORE = "class Base:\n    pass\n", '{"name":"top","workspaces":["n*"]}', "*.gen.py\n!keep*.gen.py\n"
OLD = "class Old{k}:\n    pass\n"


def _sql(template: str) -> str:
    """A template as an SQL expression over k and n."""
    out = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, value in (("{k}", "k"), ("{n}", "n"), ("{m}", "(n + 1) % 25")):
        if name in template:
            out = f"replace({out}, '{name}', ({value})::VARCHAR)"
    return out


FILES = f"""sup AS (SELECT s_suppkey AS k, s_nationkey AS n, 'n' || s_nationkey || '/' || CASE WHEN s_suppkey % 10 = 9 THEN '_' ELSE '' END || 's' || s_suppkey || '.py' AS path FROM supplier),
nat AS (SELECT n_nationkey AS n, 0 AS k, 'n' || n_nationkey AS dir FROM nation),
files AS (
  SELECT 's' AS what, path, k, n, {_sql(SUPPLIER)} AS text FROM sup
  UNION ALL SELECT 'n', dir || '/__init__.py', k, n, {_sql(NATION)} FROM nat
  UNION ALL SELECT 'm', dir || '/package.json', k, n, {_sql(MANIFEST)} FROM nat
  UNION ALL SELECT 'k', 'n' || n || '/keep' || k || '.gen.py', k, n, '' FROM sup WHERE k % 6 = 0
  UNION ALL SELECT 'b', 'base.py', 0, 0, {_sql(BASE)}
  UNION ALL SELECT 't', 'package.json', 0, 0, {_sql(TOP)}
)"""
#: The entities of a file: what it is, its own id, the id it is in, name, type, kind, subtype, line, its text.
NODES = FILES + """,
inner_ AS (
  SELECT path, path || ':S' || k AS id, path AS up, 'S' || k AS name, 'Container' AS node_type, 'type' AS kind, 'class' AS subtype, 1 AS line, 'class S' || k || '(Base):' AS text FROM files WHERE what = 's'
  UNION ALL SELECT path, path || ':S' || k || ':total', path || ':S' || k, 'total', 'Callable', 'method', NULL, 2, '    def total(self, amount):' FROM files WHERE what = 's'
  UNION ALL SELECT path, path || ':S' || k || ':total:amount', path || ':S' || k || ':total', 'amount', 'Data', 'parameter', NULL, 2, '    def total(self, amount):' FROM files WHERE what = 's'
  UNION ALL SELECT path, path || ':S' || k || ':_low' || k, path || ':S' || k, '_low' || k, 'Callable', 'method', NULL, 5, '    def _low' || k || '(self):' FROM files WHERE what = 's'
  UNION ALL SELECT path, path || ':LIMIT' || k, path, 'LIMIT' || k, 'Data', 'constant', NULL, 9, 'LIMIT' || k || ' = ' || k FROM files WHERE what = 's'
  UNION ALL SELECT path, path || ':nation' || n, path, 'nation' || n, 'Callable', 'function', NULL, 1, 'def nation' || n || '(x):' FROM files WHERE what = 'n'
  UNION ALL SELECT path, path || ':nation' || n || ':x', path || ':nation' || n, 'x', 'Data', 'parameter', NULL, 1, 'def nation' || n || '(x):' FROM files WHERE what = 'n'
  UNION ALL SELECT path, 'base.py:Base', path, 'Base', 'Container', 'type', 'class', 1, 'class Base:' FROM files WHERE what = 'b'
),
comps AS (
  SELECT 'component:tree' || CASE WHEN what = 't' THEN '' ELSE ':n' || n END AS id, CASE WHEN what = 't' THEN 'top' ELSE '@t/n' || n END AS name, path, CASE WHEN what = 't' THEN '' ELSE 'n' || n END AS directory, CASE WHEN what = 'm' THEN '1.' || n || '.0' END AS version, what = 't' AS is_root, n, what FROM files WHERE what IN ('m', 't')
),
nodes AS (
  SELECT 'tree' AS id, 'tree' AS name, 'Container' AS node_type, 'repository' AS kind, NULL AS subtype, NULL AS file, 1 AS line, 1 AS end_line
  UNION ALL SELECT path, string_split(path, '/')[-1], 'Container', 'file', NULL, path, 1, (len(text) - len(replace(text, chr(10), '')) + 1)::INTEGER FROM files WHERE path LIKE '%.py'
  UNION ALL SELECT id, name, node_type, kind, subtype, path, line, line FROM inner_
  UNION ALL SELECT id, name, 'Container', 'component', 'npm', path, 1, 1 FROM comps
),
last_total AS (SELECT max(path || ':S' || k || ':total') AS id FROM files WHERE what = 's' AND path = (SELECT max(path) FROM sup)),
edges AS (
  SELECT 'tree' AS source, path AS target, 'CONTAINS' AS edge_type, NULL::INTEGER AS ref_line, NULL AS ident, NULL AS version_spec FROM files WHERE path LIKE '%.py'
  UNION ALL SELECT up, id, 'CONTAINS', NULL, NULL, NULL FROM inner_
  UNION ALL SELECT up, id, 'DEFINES', NULL, NULL, NULL FROM inner_ WHERE node_type = 'Data' AND up <> path
  UNION ALL SELECT path || ':S' || k, 'base.py:Base', 'USES', 1, 'Base', NULL FROM files WHERE what = 's'
  UNION ALL SELECT path || ':S' || k || ':total', 'n' || n || '/__init__.py:nation' || n, 'USES', 3, 'nation' || n, NULL FROM files WHERE what = 's'
  UNION ALL SELECT path || ':S' || k || ':_low' || k, (SELECT id FROM last_total), 'USES', 6, 'total', NULL FROM files WHERE what = 's'
  UNION ALL SELECT CASE WHEN what = 't' THEN 'tree' ELSE 'component:tree' END, id, 'CONTAINS', NULL, NULL, NULL FROM comps
  UNION ALL SELECT id, 'component:tree:n' || (n + 1) % 25, 'DEPENDS_ON', NULL, '@t/n' || (n + 1) % 25, 'workspace:*' FROM comps WHERE what = 'm'
),
parts AS (SELECT id, 'tree_' || coalesce(nullif(regexp_extract(coalesce(file, ''), '^(.*)/', 1), ''), 'root') AS partition_id FROM nodes)"""


def _filled(template: str, k: Column, n: Column) -> Column:
    out = F.lit(template)
    for name, value in (("{k}", k), ("{n}", n), ("{m}", (n + 1) % 25)):
        out = F.replace(out, F.lit(name), value.cast("string"))
    return out


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (directory := os.path.dirname(path)) not in made:
                    fs.create_dir(f"{top}/{directory}", recursive=True)
                    made.add(directory)
                with fs.open_output_stream(f"{top}/{path}") as f:
                    f.write(content.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    return run


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, k, what) of all files, those that must be found and those that must not."""
    s = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    n = _read(spark, sf_dir, "nation").select(F.lit(0).cast("long").alias("k"), F.col("n_nationkey").alias("n"))
    k, at = F.col("k"), F.concat(F.lit("n"), F.col("n").cast("string"), F.lit("/"))
    some = lambda df, path, content, what="": df.select(path.alias("path"), content.alias("text"), "k", F.lit(what).alias("what"))
    own = some(s, F.concat(at, F.when(k % 10 == 9, "_").otherwise(""), F.lit("s"), k.cast("string"), F.lit(".py")), _filled(SUPPLIER, k, F.col("n")), "s")
    parts = [
        some(n, F.concat(at, F.lit("__init__.py")), _filled(NATION, k, F.col("n"))),
        some(n, F.concat(at, F.lit("package.json")), _filled(MANIFEST, k, F.col("n"))),
        some(s.where("k % 6 = 0"), F.concat(at, F.lit("keep"), k.cast("string"), F.lit(".gen.py")), F.lit("")),
        some(s.where("k % 5 = 0"), F.concat(at, F.lit("drop"), k.cast("string"), F.lit(".gen.py")), F.lit("def no(): pass\n")),
        some(s.where("k % 7 = 0"), F.concat(at, F.lit("build/s"), k.cast("string"), F.lit(".py")), F.lit("def no(): pass\n")),
        some(s.where("k % 11 = 0"), F.concat(F.lit(".hidden/s"), k.cast("string"), F.lit(".py")), F.lit("def no(): pass\n")),
        spark.createDataFrame([("base.py", BASE, 0, ""), ("package.json", TOP, 0, ""), (".gitignore", IGNORE, 0, "")], "path string, text string, k long, what string"),
    ]
    for p in parts:
        own = own.unionByName(p)
    return own


def _put(files: DataFrame, root: str) -> None:
    tasks = 4 * ship(files.sparkSession).sparkContext.defaultParallelism
    # to Spark these rows are one task's, but a file takes time
    files.select("path", "text").repartition(tasks, "path").mapInArrow(_write(root), "path string").count()


_made: dict[tuple[str, str, str], Engine] = {}


def _engine(spark: SparkSession, sf_dir: str, updated: bool = False) -> Engine:
    """The engine that has read the tree; with `updated` one that read an older tree first: without every third supplier, with other texts for every fourth, and with files that are gone."""
    key = (spark.sparkContext.applicationId, sf_dir, str(updated))
    if key not in _made:
        at = place(spark, "tree")
        root = f"{at}/tree"
        e = Engine(spark, root, f"{at}/store", "tree")
        files = cut(_table(spark, sf_dir))
        k = F.col("k")
        if updated:
            old = files.where("what <> 's' or k % 3 <> 0").withColumn("text", F.when((F.col("what") == "s") & (k % 4 == 1), F.replace(F.lit(OLD), F.lit("{k}"), k.cast("string"))).otherwise(F.col("text")))
            gone = spark.createDataFrame([("n0/gone.py", "def total(): pass\n"), ("zz/package.json", '{"name":"gone"}')], "path string, text string")
            _put(old.select("path", "text").unionByName(gone), root)
            e.rebuild()
            fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
            for p in ("n0/gone.py", "zz/package.json"):
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{p}"), True)
        _put(files, root)
        e.update()
        _made[key] = e
    return _made[key]


def _tree(sql: str):
    return _query(f"WITH {NODES} {sql}")


_NODE = ("id", "name", "node_type", "kind", "subtype", "file", "line", "end_line")
_EDGE = ("source", "target", "edge_type", "ref_line", "ident", "version_spec")


# Reading


@_tree("SELECT path, sha256(text) AS sha256, strlen(text) AS n_bytes, CASE WHEN path LIKE '%.py' THEN 'python' END AS language FROM files")
def tree_files(spark, sf_dir):
    return _engine(spark, sf_dir).store.read("files").select("path", "sha256", "n_bytes", "language")


@_tree("SELECT id AS node_id, name, path AS manifest_path, directory, 'npm' AS ecosystem, version, is_root AS is_workspace_root, CASE WHEN is_root THEN 'n*' ELSE '' END AS members, CASE WHEN is_root THEN '' ELSE '@t/n' || (n + 1) % 25 END AS needs FROM comps")
def tree_components(spark, sf_dir):
    c = tree.components(_engine(spark, sf_dir).files(), "tree")
    return c.select("node_id", "name", "manifest_path", "directory", "ecosystem", "version", "is_workspace_root", F.array_join("workspace_members", ",").alias("members"), F.array_join(F.transform("local_dependencies", lambda d: d["name"]), ",").alias("needs"))


@_tree(f"SELECT {', '.join(_NODE)} FROM nodes")
def tree_nodes(spark, sf_dir):
    return _engine(spark, sf_dir).nodes.select(*_NODE)


@_tree(f"SELECT {', '.join(_EDGE)} FROM edges")
def tree_edges(spark, sf_dir):
    return _engine(spark, sf_dir).edges.select(*_EDGE)


@_tree("SELECT id, text, CASE WHEN starts_with(name, '_') THEN 'protected' ELSE 'public' END AS visibility, false AS is_empty FROM inner_")
def tree_metadata(spark, sf_dir):
    return _engine(spark, sf_dir).nodes.where("kind not in ('file', 'repository', 'component')").select("id", "text", F.col("metadata.visibility").alias("visibility"), paths.is_empty_metadata(F.col("metadata"), ("visibility", "async", "static", "decorators")).alias("is_empty"))


@_tree("SELECT 'node' AS what, id AS a, kind AS b, line AS n FROM nodes UNION ALL SELECT edge_type, source, target, ref_line FROM edges")
def tree_after_update(spark, sf_dir):
    """What an update of an older tree leaves: the graph of the tree as it is."""
    e = _engine(spark, sf_dir, updated=True)
    n = e.nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("kind").alias("b"), F.col("line").alias("n"))
    return n.unionByName(e.edges.select(F.col("edge_type").alias("what"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("ref_line").alias("n")))


@_tree("SELECT path, CASE WHEN what = 's' AND k % 3 <> 0 THEN 'modified' ELSE 'added' END AS op FROM files WHERE what = 's' AND (k % 3 = 0 OR k % 4 = 1) UNION ALL SELECT 'n0/gone.py', 'deleted' UNION ALL SELECT 'zz/package.json', 'deleted'")
def tree_changes(spark, sf_dir):
    """The change set between the snapshots before and after that update."""
    from .operators import changes

    new = _engine(spark, sf_dir, updated=True).store.read("files")
    files = _table(spark, sf_dir).where("what = 's'").select("path", F.when(F.col("k") % 4 == 1, F.sha2(F.replace(F.lit(OLD), F.lit("{k}"), F.col("k").cast("string")), 256)).otherwise(F.sha2("text", 256)).alias("sha256"), "k").where("k % 3 <> 0").drop("k")
    rest = new.join(_table(spark, sf_dir).where("what = 's'").select("path"), "path", "left_anti").select("path", "sha256")
    old = files.unionByName(rest).unionByName(spark.createDataFrame([("n0/gone.py", "x"), ("zz/package.json", "y")], "path string, sha256 string"))
    return changes.diff(old, new.select("path", "sha256"))


# Lookups in the store

_ONE = "n5/__init__.py:nation5"


@_tree(f"SELECT {', '.join(_NODE)} FROM nodes WHERE id = '{_ONE}'")
def tree_node(spark, sf_dir):
    return lookup.node(_engine(spark, sf_dir).nodes, _ONE).select(*_NODE)


@_tree(f"SELECT {', '.join(_NODE)} FROM nodes WHERE file = 'base.py'")
def tree_nodes_of_file(spark, sf_dir):
    return lookup.by_file(_engine(spark, sf_dir).nodes, "base.py").select(*_NODE)


@_tree("SELECT partition_id, id FROM parts WHERE partition_id = 'tree_n5'")
def tree_nodes_of_partition(spark, sf_dir):
    return lookup.by_partition(_engine(spark, sf_dir).nodes, "tree_n5").select("partition_id", "id")


@_tree("SELECT partition_id, count(*) AS n FROM parts GROUP BY ALL")
def tree_partitions(spark, sf_dir):
    return _engine(spark, sf_dir).nodes.groupBy("partition_id").agg(F.count("*").alias("n"))


@_tree("SELECT 'from' AS way, source, target, edge_type FROM edges WHERE source = 'component:tree' UNION ALL SELECT 'to', source, target, edge_type FROM edges WHERE target = 'base.py:Base' UNION ALL SELECT 'both', source, target, edge_type FROM edges WHERE source = 'tree' AND target = 'base.py'")
def tree_edges_by_end(spark, sf_dir):
    e = _engine(spark, sf_dir).edges
    some = lambda way, **k: lookup.edges_by(e, **k).select(F.lit(way).alias("way"), "source", "target", "edge_type")
    return some("from", source="component:tree").unionByName(some("to", target="base.py:Base")).unionByName(some("both", source="tree", target="base.py"))


@_tree("SELECT node_type, kind, count(*) AS n, count(DISTINCT file) AS n_files FROM nodes WHERE (node_type = 'Callable' AND kind = 'method') OR node_type = 'Data' GROUP BY ALL")
def tree_type_filter(spark, sf_dir):
    n = _engine(spark, sf_dir).nodes
    return n.where(lookup.type_filter(["callable:Method", "Data"])).groupBy("node_type", "kind").agg(F.count("*").alias("n"), F.countDistinct("file").alias("n_files"))


@_tree("SELECT edge_type, count(*) AS n FROM edges WHERE edge_type IN ('USES', 'DEPENDS_ON') GROUP BY ALL UNION ALL SELECT 'Callable', count(*) FROM nodes WHERE node_type = 'Callable'")
def tree_by_type(spark, sf_dir):
    e = _engine(spark, sf_dir)
    some = lookup.edges_by(e.edges, "USES").unionByName(lookup.edges_by(e.edges, "DEPENDS_ON")).groupBy("edge_type").agg(F.count("*").alias("n"))
    return some.unionByName(lookup.by_type(e.nodes, "Callable").agg(F.lit("Callable").alias("edge_type"), F.count("*").alias("n")))


@_tree("SELECT node_id, direction, edge_type FROM (SELECT source AS node_id, 'incoming' AS direction, edge_type FROM edges WHERE target = 'base.py:Base' UNION ALL SELECT target, 'outgoing', edge_type FROM edges WHERE source = 'base.py:Base')")
def tree_connected(spark, sf_dir):
    e = _engine(spark, sf_dir)
    some = lambda way: e.connected("base.py:Base", direction=way).select("node_id", F.lit(way).alias("direction"), "edge_type")
    return some("incoming").unionByName(some("outgoing"))


@_tree("SELECT source, target, edge_type, coalesce(ident, '') AS ident FROM edges WHERE source = 'component:tree:n5' OR target = 'component:tree:n5'")
def tree_edges_of(spark, sf_dir):
    return _engine(spark, sf_dir).edges_of("component:tree:n5").select("source", "target", "edge_type", F.coalesce(F.col("metadata")["ident"], F.lit("")).alias("ident"))


@_tree("SELECT source, target, a.partition_id AS src_partition, b.partition_id AS dst_partition FROM edges JOIN parts a ON source = a.id JOIN parts b ON target = b.id WHERE a.partition_id <> b.partition_id")
def tree_cross_references(spark, sf_dir):
    return _engine(spark, sf_dir).edges.where("src_partition <> dst_partition").select("source", "target", "src_partition", "dst_partition")


@_tree("SELECT target, source, edge_type FROM edges JOIN parts a ON source = a.id JOIN parts b ON target = b.id WHERE a.partition_id <> b.partition_id AND (target = 'base.py:Base' OR source = 'component:tree')")
def tree_cross_references_of(spark, sf_dir):
    """Cross references by their target and by their source."""
    e = _engine(spark, sf_dir).edges.where("src_partition <> dst_partition")
    return lookup.edges_by(e, target="base.py:Base").unionByName(lookup.edges_by(e, source="component:tree")).select("target", "source", "edge_type")


@_tree("SELECT name, max(id) AS id FROM (SELECT name, id FROM inner_ QUALIFY row_number() OVER (PARTITION BY name ORDER BY path DESC, line DESC, id DESC) = 1) GROUP BY name")
def tree_definitions(spark, sf_dir):
    from .plans import build

    return resolve.last_definitions(build.definitions(_engine(spark, sf_dir).store.read("rows")))


@_tree("SELECT id, name, file FROM nodes WHERE regexp_matches(name, '^nation.*$') AND node_type = 'Callable' ORDER BY id LIMIT 100")
def tree_find_nodes(spark, sf_dir):
    return _engine(spark, sf_dir).find_nodes("nation*", "callable").select("id", "name", "file")


@_tree("SELECT id, path[1] AS file, path[2:-2] AS containers, path[-1] AS last FROM (SELECT id, string_split(id, ':') AS path FROM inner_)")
def tree_parsed_ids(spark, sf_dir):
    n = _engine(spark, sf_dir).nodes.where("kind not in ('file', 'repository', 'component')")
    p = paths.parse_node_id(F.col("id")).alias("p")
    return n.select("id", p).select("id", F.col("p.file").alias("file"), F.col("p.containers").alias("containers"), F.col("p.name").alias("last"))


@_tree("SELECT kind, count(*) AS n, bool_and(file IS NOT NULL) AS has_file FROM nodes WHERE kind IN ('file', 'component', 'repository') GROUP BY ALL")
def tree_predicates(spark, sf_dir):
    n = _engine(spark, sf_dir).nodes.where(F.col("kind").isin("file", "component", "repository"))
    return n.groupBy("kind").agg(F.count("*").alias("n"), F.bool_and(F.col("file").isNotNull()).alias("has_file"))


# Components


@_tree("SELECT source, target, edge_type, ident, version_spec FROM edges WHERE edge_type = 'DEPENDS_ON' OR starts_with(target, 'component:')")
def tree_component_edges(spark, sf_dir):
    from .plans import build

    return build.component_graph(cut(tree.components(_engine(spark, sf_dir).files(), "tree")), "tree")[1].select("source", "target", "edge_type", "ident", "version_spec")


@_tree("SELECT DISTINCT 'component:tree:n' || n AS id FROM nat UNION SELECT 'component:tree'")
def tree_affected(spark, sf_dir):
    """All components: the dependencies are a ring, and the top holds every directory."""
    return _engine(spark, sf_dir).affected(["n5/__init__.py", "other/x"])


@_tree("SELECT id FROM comps WHERE path IN ('n5/package.json', 'package.json')")
def tree_affected_by_manifest(spark, sf_dir):
    c = _engine(spark, sf_dir).components().select(F.col("id").alias("node_id"), F.col("file").alias("manifest_path"), paths.directory(F.col("file")).alias("directory"))
    changed = spark.createDataFrame([("n5/package.json",), ("package.json",), ("n6/__init__.py",)], "path string")
    return resolve.affected(changed, c, by_directory=False).select(F.col("node_id").alias("id"))


@_tree("SELECT id, name, is_root FROM comps")
def tree_component_list(spark, sf_dir):
    return _engine(spark, sf_dir).components(ecosystem="npm").select("id", "name", F.col("metadata.is_workspace_root").alias("is_root"))


@_tree("SELECT 'digraph components {' || chr(10) || string_agg('  \"@t/n' || n || '\" -> \"@t/n' || (n + 1) % 25 || '\";' || chr(10), '' ORDER BY '@t/n' || n) || '}' || chr(10) AS drawing FROM nat WHERE n NOT IN (2, 3, 4)")
def tree_component_drawing(spark, sf_dir):
    """Every dependency but those from and to two components that are left out, as dot."""
    drawn = _engine(spark, sf_dir).component_graph(exclude=["@t/n3", "@t/n4"])
    return spark.createDataFrame([(drawn,)], "drawing string")


# Descriptions and points


def _described_sql() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(t, '{'|'.join(v.split())}') THEN '{k}' END" for k, v in text.KEYWORDS.items())
    return f"""SELECT id, concat_ws('. ', visibility || ' ' || CASE WHEN node_type = 'Container' THEN subtype ELSE kind END || ' ' || name, CASE WHEN heir THEN 'extends Base' END, params, CASE WHEN heir THEN 'methods: total, _low' || name[2:] END, parent, 'in file ' || array_to_string(string_split(path, '/')[-3:], '/'), calls, CASE WHEN len(words) > 0 THEN 'related to: ' || array_to_string(words, ', ') END, 'code: ' || trim(text)) AS semantic_text
FROM (SELECT *, list_sort(list_filter([{cases}], lambda x: x IS NOT NULL)) AS words FROM (
  SELECT *, lower(name) || chr(10) || lower(text) AS t, CASE WHEN starts_with(name, '_') THEN 'protected' ELSE 'public' END AS visibility, node_type = 'Container' AND name <> 'Base' AS heir,
    CASE WHEN name = 'total' THEN '(amount)' WHEN kind = 'function' THEN '(x)' END AS params, CASE WHEN kind = 'method' THEN 'in ' || string_split(up, ':')[-1] END AS parent,
    CASE WHEN name = 'total' THEN 'calls nation' || regexp_extract(path, '^n([0-9]+)/', 1) WHEN kind = 'method' THEN 'calls total' WHEN heir THEN 'uses types Base' END AS calls FROM inner_ WHERE node_type <> 'Data'))"""


@_tree(_described_sql())
def tree_descriptions(spark, sf_dir):
    e = _engine(spark, sf_dir)
    n = e.nodes.withColumn("content", F.coalesce("text", F.lit("")))
    return describe.describe(n, e.edges, n.where("node_type <> 'Data' and kind not in ('file', 'repository', 'component')")).select("id", "semantic_text")


@_tree("SELECT id AS entity_id, name, node_type AS type, kind, path AS file_path, line AS start_line, text AS content, 768 AS width FROM inner_")
def tree_points(spark, sf_dir):
    """What is indexed: every entity that is no file or repository and has lines of its own."""
    e = _engine(spark, sf_dir)
    if not e.store.exists("points_code"):
        e.index()
    both = e.store.read("points_code").join(e.store.read("points_semantic").select("entity_id"), "entity_id", "left_semi")
    return both.select("entity_id", "name", "type", "kind", "file_path", "start_line", "content", F.size("vector").alias("width"))


@_tree("SELECT id AS entity_id FROM inner_ WHERE name = 'Base'")
def tree_points_by_name(spark, sf_dir):
    """The best hit for an exact name."""
    e = _engine(spark, sf_dir)
    if not e.store.exists("points_code"):
        e.index()
    return e.search("Base", 1).select("entity_id")


# Roll-ups


@_tree("SELECT (SELECT count(DISTINCT partition_id) FROM parts) AS n_partitions, (SELECT count(DISTINCT file) FROM nodes) AS n_files, (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM edges JOIN parts a ON source = a.id JOIN parts b ON target = b.id WHERE a.partition_id <> b.partition_id) AS n_cross, floor(((SELECT count(*) FROM nodes) * 512 + (SELECT count(*) FROM edges) * 128) * 1.4::DOUBLE)::BIGINT AS n_bytes")
def tree_graph_size(spark, sf_dir):
    e = _engine(spark, sf_dir)
    return rollup.graph_size(e.nodes, e.edges)


@_tree("SELECT start, id, depth FROM (SELECT 'tree' AS start, id, CASE WHEN id = 'tree' THEN 0 WHEN id = 'component:tree' OR kind = 'file' THEN 1 WHEN kind = 'component' THEN 2 ELSE len(string_split(id, ':')) END::INTEGER AS depth FROM nodes)")
def tree_reachable(spark, sf_dir):
    e = _engine(spark, sf_dir)
    return traverse.reachable(e.edges, e.nodes.where("kind = 'repository'"), ["CONTAINS"])


# Changes of stored tables

_STORED = "WITH e AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'USES' AS edge_type, 'p' || n_nationkey % 5 AS src_partition, 'q' || n_regionkey AS dst_partition FROM nation)"


def _stored(spark, sf_dir) -> tuple[Store, DataFrame]:
    s = lambda c: F.col(c).cast("string")
    e = _read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), s("n_nationkey")).alias("source"), F.concat(F.lit("r"), s("n_regionkey")).alias("target"), F.lit("USES").alias("edge_type"), F.concat(F.lit("p"), (F.col("n_nationkey") % 5).cast("string")).alias("src_partition"), F.concat(F.lit("q"), s("n_regionkey")).alias("dst_partition"))
    store = Store(spark, place(spark, "store"))
    store.write("edges", e)
    return store, e


@_query(f"{_STORED} SELECT source, target FROM e WHERE source NOT IN ('n3', 'n4')")
def store_delete_by_source(spark, sf_dir):
    store, _ = _stored(spark, sf_dir)
    store.delete("edges", "source", ["n3", "n4", "nobody"])
    return store.read("edges").select("source", "target")


@_query(f"{_STORED} SELECT source, target FROM e WHERE src_partition <> 'p1' AND dst_partition <> 'q0'")
def store_delete_by_partition(spark, sf_dir):
    """Cross references without those of one partition, and of one source partition."""
    store, _ = _stored(spark, sf_dir)
    store.delete("edges", "src_partition", ["p1"])
    store.delete("edges", "dst_partition", ["q0"])
    return store.read("edges").select("source", "target")


@_query(f"{_STORED} SELECT source, target FROM e UNION ALL SELECT source, 'again' FROM e WHERE src_partition = 'p2'")
def store_append(spark, sf_dir):
    store, e = _stored(spark, sf_dir)
    store.append("edges", e.where("src_partition = 'p2'").withColumn("target", F.lit("again")))
    return store.read("edges").select("source", "target")


@_query(f"{_STORED} SELECT source, target FROM e WHERE src_partition <> 'p2' UNION ALL SELECT source, 'new' FROM e WHERE src_partition = 'p2'")
def store_rewrite_partition(spark, sf_dir):
    store, e = _stored(spark, sf_dir)
    store.rewrite("edges", "src_partition", ["p2"], e.where("src_partition = 'p2'").withColumn("target", F.lit("new")))
    return store.read("edges").select("source", "target")


@_query("SELECT 'edges' AS name, false AS kept, 'v1' AS version UNION ALL SELECT 'other', true, 'v1'")
def store_collections(spark, sf_dir):
    """Tables made and dropped, and a value kept with them."""
    store, e = _stored(spark, sf_dir)
    store.write("other", e)
    store.meta("version", "v1")
    store.drop("edges")
    return spark.createDataFrame([(n, store.exists(n), store.meta("version")) for n in ("edges", "other")], "name string, kept boolean, version string")

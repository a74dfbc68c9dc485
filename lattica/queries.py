"""One query per operator over the whole of the driver's tables, each with the SQL that DuckDB answers alike.

The star schema is seen as a property graph: region, nation, customer, supplier,
part, order and lineitem rows are nodes; CONTAINS leads from region to nation to
customer and supplier, from customer to order to lineitem; USES from lineitem to
part and supplier; DEFINES from order to lineitem.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, ranking, text
from .operators import changes, constraints, lookup, resolve, rollup, search, traverse, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_NODES = """nodes AS (
  SELECT 'r:' || r_regionkey AS id, r_name AS name, 'Container' AS node_type, 'repository' AS kind, CAST(NULL AS VARCHAR) AS file, 1 AS line FROM region
  UNION ALL SELECT 'n:' || n_nationkey, n_name, 'Container', 'file', 'r' || n_regionkey || '/n' || n_nationkey, 1 FROM nation
  UNION ALL SELECT 'c:' || c_custkey, c_name, 'Container', 'type', 'n' || c_nationkey || '/c' || c_custkey, 1 FROM customer
  UNION ALL SELECT 's:' || s_suppkey, s_name, 'Container', 'module', 'n' || s_nationkey || '/s' || s_suppkey, 1 FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, p_name, 'Data', 'constant', 'parts/' || p_brand || '/' || p_type, p_size FROM part
  UNION ALL SELECT 'o:' || o_orderkey, o_orderpriority, 'Callable', 'function', 'c' || o_custkey || '/o' || o_orderkey, 1 FROM orders
  UNION ALL SELECT DISTINCT 'l:' || l_orderkey || ':' || l_linenumber, 'line' || l_linenumber, 'Data', 'field', 'o' || l_orderkey || '/l' || l_linenumber, l_linenumber FROM lineitem
)"""
_EDGES = """edges AS (
  SELECT 'r:' || n_regionkey AS source, 'n:' || n_nationkey AS target, 'CONTAINS' AS edge_type, CAST(NULL AS INTEGER) AS ref_line FROM nation
  UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'CONTAINS', NULL FROM customer
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'CONTAINS', NULL FROM supplier
  UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'CONTAINS', NULL FROM orders
  UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'l:' || l_orderkey || ':' || l_linenumber, 'CONTAINS', CAST(NULL AS INTEGER) FROM lineitem
  UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'l:' || l_orderkey || ':' || l_linenumber, 'DEFINES', CAST(NULL AS INTEGER) FROM lineitem
  UNION ALL SELECT DISTINCT 'l:' || l_orderkey || ':' || l_linenumber, 'p:' || l_partkey, 'USES', l_linenumber FROM lineitem
  UNION ALL SELECT DISTINCT 'l:' || l_orderkey || ':' || l_linenumber, 's:' || l_suppkey, 'USES', l_linenumber FROM lineitem
)"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, *columns: str) -> Column:
    return F.concat(F.lit(prefix), F.concat_ws(":", *[F.col(c).cast("string") for c in columns]))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: _read(spark, sf_dir, n)

    def some(df: DataFrame, id_: Column, name, node_type: str, kind: str, file: Column, line=None) -> DataFrame:
        return df.select(id_.alias("id"), F.col(name).alias("name") if isinstance(name, str) else name.alias("name"), F.lit(node_type).alias("node_type"), F.lit(kind).alias("kind"), file.alias("file"), (F.lit(1) if line is None else F.col(line)).cast("int").alias("line"))

    path = lambda a, x, b, y: F.concat(F.lit(a), F.col(x).cast("string"), F.lit(f"/{b}"), F.col(y).cast("string"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber").distinct()
    parts = [
        some(t("region"), _key("r:", "r_regionkey"), "r_name", "Container", "repository", F.lit(None).cast("string")),
        some(t("nation"), _key("n:", "n_nationkey"), "n_name", "Container", "file", path("r", "n_regionkey", "n", "n_nationkey")),
        some(t("customer"), _key("c:", "c_custkey"), "c_name", "Container", "type", path("n", "c_nationkey", "c", "c_custkey")),
        some(t("supplier"), _key("s:", "s_suppkey"), "s_name", "Container", "module", path("n", "s_nationkey", "s", "s_suppkey")),
        some(t("part"), _key("p:", "p_partkey"), "p_name", "Data", "constant", F.concat_ws("/", F.lit("parts"), "p_brand", "p_type"), "p_size"),
        some(t("orders"), _key("o:", "o_orderkey"), "o_orderpriority", "Callable", "function", path("c", "o_custkey", "o", "o_orderkey")),
        some(lines, _key("l:", "l_orderkey", "l_linenumber"), _key("line", "l_linenumber"), "Data", "field", path("o", "l_orderkey", "l", "l_linenumber"), "l_linenumber"),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: _read(spark, sf_dir, n)

    def some(df: DataFrame, source: Column, target: Column, edge_type: str, line: str | None = None) -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(edge_type).alias("edge_type"), (F.col(line) if line else F.lit(None)).cast("int").alias("ref_line"))

    item = _key("l:", "l_orderkey", "l_linenumber")
    own = t("lineitem").select("l_orderkey", "l_linenumber").distinct()
    parts = [
        some(t("nation"), _key("r:", "n_regionkey"), _key("n:", "n_nationkey"), "CONTAINS"),
        some(t("customer"), _key("n:", "c_nationkey"), _key("c:", "c_custkey"), "CONTAINS"),
        some(t("supplier"), _key("n:", "s_nationkey"), _key("s:", "s_suppkey"), "CONTAINS"),
        some(t("orders"), _key("c:", "o_custkey"), _key("o:", "o_orderkey"), "CONTAINS"),
        some(own, _key("o:", "l_orderkey"), item, "CONTAINS"),
        some(own, _key("o:", "l_orderkey"), item, "DEFINES"),
        # distinct as numbers, of which a task holds more than of texts
        some(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct(), item, _key("p:", "l_partkey"), "USES", "l_linenumber"),
        some(t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct(), item, _key("s:", "l_suppkey"), "USES", "l_linenumber"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _query(sql: str | None = None, graph: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = f"WITH RECURSIVE {_NODES},\n{_EDGES}" if graph else ""
            ORACLE_SQL[f.__name__] = head + (",\n" if graph and sql.lstrip().startswith("+") else "\n") + sql.lstrip().lstrip("+")
        return f

    return add


# Lookups and edges


@_query("SELECT 'nodes' AS metric, node_type AS name, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'kind', kind, count(*) FROM nodes WHERE kind IN ('file', 'component') GROUP BY ALL UNION ALL SELECT 'edges', edge_type, count(*) FROM edges GROUP BY ALL", True)
def graph_stats(spark, sf_dir):
    return rollup.graph_stats(nodes(spark, sf_dir), edges(spark, sf_dir))


@_query("SELECT node_type, kind, count(*) AS n, grouping(node_type, kind)::INTEGER AS level FROM nodes GROUP BY ROLLUP (node_type, kind)", True)
def kind_breakdown(spark, sf_dir):
    return rollup.breakdown(nodes(spark, sf_dir))


@_query("SELECT file, count(*) AS n FROM nodes WHERE kind IS NULL OR kind <> 'file' GROUP BY file ORDER BY n DESC, file LIMIT 10", True)
def top_files(spark, sf_dir):
    return rollup.top_files(nodes(spark, sf_dir))


@_query("SELECT source, id AS child, name FROM edges JOIN nodes ON target = id WHERE edge_type = 'CONTAINS'", True)
def children(spark, sf_dir):
    return lookup.children(edges(spark, sf_dir), nodes(spark, sf_dir)).select("source", F.col("node_id").alias("child"), F.col("node_name").alias("name"))


@_query("SELECT target AS id, min(source) AS parent FROM edges WHERE edge_type = 'CONTAINS' GROUP BY target", True)
def parent_of(spark, sf_dir):
    return lookup.parent(edges(spark, sf_dir))


@_query("SELECT id, direction, edge_type, count(*) AS n FROM (SELECT source AS id, edge_type, 'outgoing' AS direction FROM edges UNION ALL SELECT target, edge_type, 'incoming' FROM edges) GROUP BY ALL", True)
def neighbors(spark, sf_dir):
    return lookup.both_ways(edges(spark, sf_dir)).groupBy("id", "direction", "edge_type").agg(F.count("*").alias("n"))


@_query("SELECT target, source AS node_id, name AS node_name, edge_type, ref_line FROM edges JOIN nodes ON source = id WHERE edge_type = 'USES'", True)
def find_references(spark, sf_dir):
    return lookup.incoming(edges(spark, sf_dir), nodes(spark, sf_dir), edge_type="USES").select("target", "node_id", "node_name", "edge_type", "ref_line")


@_query("SELECT source, target AS node_id, name AS node_name, edge_type, ref_line FROM edges JOIN nodes ON target = id WHERE edge_type = 'USES'", True)
def find_outgoing_references(spark, sf_dir):
    return lookup.outgoing(edges(spark, sf_dir), nodes(spark, sf_dir), edge_type="USES").select("source", "node_id", "node_name", "edge_type", "ref_line")


@_query("SELECT source, target AS node_id, name AS node_name FROM edges JOIN nodes ON target = id WHERE edge_type = 'DEFINES'", True)
def find_definitions(spark, sf_dir):
    return lookup.outgoing(edges(spark, sf_dir), nodes(spark, sf_dir), edge_type="DEFINES").select("source", "node_id", "node_name")


@_query("SELECT id, name, file FROM nodes WHERE regexp_matches(name, '^line.*$') AND node_type = 'Data'", True)
def find_nodes(spark, sf_dir):
    return lookup.find_nodes(nodes(spark, sf_dir), "line*", "data").select("id", "name", "file")


@_query("SELECT id, '{\"id\":\"' || id || '\",\"name\":\"' || name || '\",\"type\":\"' || node_type || '\",\"kind\":\"' || kind || '\",' || CASE WHEN file IS NULL THEN '' ELSE '\"file\":\"' || file || '\",' END || '\"line\":' || line || '}' AS info FROM nodes", True)
def node_info(spark, sf_dir):
    n = nodes(spark, sf_dir).withColumn("subtype", F.lit(None).cast("string")).withColumn("end_line", F.lit(None).cast("int"))
    return lookup.node_info(n)


@_query("SELECT edge_type, count(*) AS n FROM edges WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) GROUP BY ALL", True)
def guarded_edges(spark, sf_dir):
    return lookup.guarded(edges(spark, sf_dir), nodes(spark, sf_dir)).groupBy("edge_type").agg(F.count("*").alias("n"))


@_query("SELECT source, target, edge_type FROM edges WHERE source NOT IN (SELECT id FROM nodes WHERE kind = 'module') AND target NOT IN (SELECT id FROM nodes WHERE kind = 'module')", True)
def remove_nodes(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return lookup.remove_nodes(n, edges(spark, sf_dir), n.where("kind = 'module'"))[1].select("source", "target", "edge_type")


# Partitions


def _partitioned(spark, sf_dir):
    n = nodes(spark, sf_dir).withColumn("partition_id", F.coalesce(paths.partition_id(F.lit("tpch"), F.col("file")), F.lit("tpch_root")))
    return n, lookup.classify_edges(edges(spark, sf_dir), n)


_PART = "parts AS (SELECT id, CASE WHEN file IS NULL THEN 'tpch_root' ELSE 'tpch_' || coalesce(nullif(regexp_extract(file, '^(.*)/', 1), ''), 'root') END AS partition_id FROM nodes), cross_edges AS (SELECT e.*, a.partition_id AS src_partition, b.partition_id AS dst_partition FROM edges e JOIN parts a ON source = a.id JOIN parts b ON target = b.id)"


@_query(f"+{_PART} SELECT edge_type, src_partition <> dst_partition AS is_cross, count(*) AS n FROM cross_edges GROUP BY ALL", True)
def edge_classify(spark, sf_dir):
    return _partitioned(spark, sf_dir)[1].groupBy("edge_type", "is_cross").agg(F.count("*").alias("n"))


@_query(f"+{_PART} SELECT coalesce(p.partition_id, c.src_partition) AS partition_id, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(n_cross, 0) AS n_cross FROM (SELECT partition_id, count(*) AS n_nodes FROM parts GROUP BY ALL) p FULL JOIN (SELECT src_partition, count(*) AS n_edges, count(*) FILTER (src_partition <> dst_partition) AS n_cross FROM cross_edges GROUP BY ALL) c ON p.partition_id = c.src_partition", True)
def partition_stats(spark, sf_dir):
    return rollup.partition_stats(*_partitioned(spark, sf_dir))


# Resolution


@_query("SELECT DISTINCT 'l:' || l_orderkey || ':' || l_linenumber AS source, d.id AS target, 'USES' AS edge_type, l_linenumber AS ref_line, p_name AS ident FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (SELECT p_name AS name, 'p:' || p_partkey AS id FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_brand DESC, p_size DESC, p_partkey DESC) = 1) d ON d.name = p_name")
def resolve_references(spark, sf_dir):
    p, items = _read(spark, sf_dir, "part"), _read(spark, sf_dir, "lineitem")
    defs = p.select(F.col("p_name").alias("name"), _key("p:", "p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_size").alias("start_line"), F.col("p_size").alias("end_line"), F.col("p_partkey").alias("seq"))
    refs = items.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_name").alias("name"), _key("l:", "l_orderkey", "l_linenumber").alias("source_id"), F.col("l_linenumber").alias("line"))
    return resolve.resolve_references(refs, defs, nodes(spark, sf_dir))


@_query("WITH p AS (SELECT event_id AS point_id, event_type AS file, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS line FROM events), s AS (SELECT o_orderkey AS span_id, ['click', 'error', 'purchase', 'signup', 'view'][1 + o_orderkey % 5] AS file, CAST(floor(epoch(TIMESTAMP '2024-01-01') / 3600) AS BIGINT) + o_custkey % 700 AS start_line, CAST(floor(epoch(TIMESTAMP '2024-01-01') / 3600) AS BIGINT) + o_custkey % 700 + o_orderkey % 97 AS end_line FROM orders) SELECT point_id, p.file, line, (SELECT span_id FROM s WHERE s.file = p.file AND start_line <= line AND end_line >= line ORDER BY end_line - start_line, -start_line, span_id LIMIT 1) AS span_id FROM p")
def enclosing_span(spark, sf_dir):
    points = _read(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), F.col("event_type").alias("file"), F.floor(F.unix_timestamp("ts") / 3600).alias("line"))
    kinds = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    start = F.floor(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) / 3600) + F.col("o_custkey") % 700
    spans = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("span_id"), F.get(kinds, (F.col("o_orderkey") % 5).cast("int")).alias("file"), start.alias("start_line"), (start + F.col("o_orderkey") % 97).alias("end_line"))
    return resolve.enclosing(points, spans)


_URL = "urls AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"


def _urls(spark, sf_dir):
    plain = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return _read(spark, sf_dir, "pages").select("page_id", plain.alias("path"))


@_query(f"WITH {_URL}, d AS (SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS directory FROM urls), w AS (SELECT unnest(['blog.*', 'm.*', '*', 'en/*']) AS pattern) SELECT directory, pattern FROM d JOIN w ON CASE WHEN pattern LIKE '%/*' THEN starts_with(directory, rtrim(pattern, '/*')) AND directory <> rtrim(pattern, '/*') WHEN pattern LIKE '%*%' THEN starts_with(directory, string_split(pattern, '*')[1]) ELSE directory = pattern END")
def workspace_members(spark, sf_dir):
    d = _urls(spark, sf_dir).select(paths.directory(F.col("path")).alias("directory")).distinct()
    w = spark.createDataFrame([("blog.*", ""), ("m.*", ""), ("*", ""), ("en/*", "")], "pattern string, base string")
    return resolve.members(d, w)


# Traversal


@_query("+c AS (SELECT id AS start, [id] AS path FROM nodes WHERE kind = 'repository' UNION ALL SELECT start, list_append(path, target) FROM c JOIN edges ON source = path[-1] AND edge_type = 'CONTAINS' AND NOT list_contains(path, target) WHERE len(path) < 4) SELECT start, array_to_string(path, '>') AS path, len(path)::INTEGER AS length FROM c WHERE len(path) > 1 AND (len(path) = 4 OR NOT EXISTS (SELECT 1 FROM edges WHERE source = c.path[-1] AND edge_type = 'CONTAINS' AND NOT list_contains(c.path, target)))", True)
def call_chain_down(spark, sf_dir):
    starts = nodes(spark, sf_dir).where("kind = 'repository'")
    out = traverse.chains(edges(spark, sf_dir), starts, 3, ["CONTAINS"], upstream=False)
    return out.select("start", F.array_join("path", ">").alias("path"), "length")


@_query("+c AS (SELECT id AS start, [id] AS path FROM nodes WHERE node_type = 'Data' UNION ALL SELECT start, list_append(path, source) FROM c JOIN edges ON target = path[-1] AND edge_type = 'CONTAINS' AND NOT list_contains(path, source) WHERE len(path) < 4) SELECT start, array_to_string(path, '>') AS path, len(path)::INTEGER AS length FROM c WHERE len(path) = 4", True)
def call_chain_up(spark, sf_dir):
    starts = nodes(spark, sf_dir).where("node_type = 'Data'")
    out = traverse.chains(edges(spark, sf_dir), starts, 3, ["CONTAINS"], upstream=True)
    return out.select("start", F.array_join("path", ">").alias("path"), "length")


@_query("+c AS (SELECT id AS start, id, 0 AS depth FROM nodes WHERE kind = 'repository' UNION SELECT start, target, depth + 1 FROM c JOIN edges ON source = c.id AND edge_type = 'CONTAINS') SELECT start, id, min(depth)::INTEGER AS depth FROM c GROUP BY start, id", True)
def reachability(spark, sf_dir):
    return traverse.reachable(edges(spark, sf_dir), nodes(spark, sf_dir).where("kind = 'repository'"), ["CONTAINS"])


@_query("+d AS (SELECT DISTINCT source, target FROM edges WHERE edge_type = 'CONTAINS'), c AS (SELECT id AS start, id, 0 AS depth FROM nodes WHERE kind = 'file' UNION SELECT start, target, depth + 1 FROM c JOIN d ON source = c.id WHERE depth < 3), m AS (SELECT start, id, min(depth) AS depth FROM c GROUP BY start, id) SELECT start, source, target, (depth + 1)::INTEGER AS depth FROM m JOIN d ON source = m.id WHERE depth < 3", True)
def transitive_deps(spark, sf_dir):
    e = edges(spark, sf_dir).where("edge_type = 'CONTAINS'").withColumn("edge_type", F.lit("DEPENDS_ON"))
    return traverse.dependencies(e, nodes(spark, sf_dir).where("kind = 'file'"), 3)


@_query("+c AS (SELECT id AS start, id, 0 AS depth FROM nodes WHERE kind = 'constant' UNION SELECT start, source, depth + 1 FROM c JOIN edges ON target = c.id AND edge_type IN ('USES', 'DEFINES')) SELECT start, id, min(depth)::INTEGER AS depth FROM c GROUP BY start, id", True)
def affected_closure(spark, sf_dir):
    return traverse.reachable(edges(spark, sf_dir), nodes(spark, sf_dir).where("kind = 'constant'"), ["USES", "DEFINES"], upstream=True)


# Roll-ups


@_query(f"WITH {_URL}, p AS (SELECT path, string_split(path, '/') AS parts, lang FROM urls JOIN (SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN 'en' ELSE 'other' END AS lang FROM pages) USING (page_id)), x AS (SELECT path AS file, lang AS node_type, parts, unnest(range(1, least(2, len(parts)) + 1)) AS depth FROM p) SELECT array_to_string(parts[1:depth], '/') AS path, depth::INTEGER AS depth, node_type, count(*) AS n_nodes, count(DISTINCT file) AS n_files FROM x GROUP BY GROUPING SETS ((array_to_string(parts[1:depth], '/'), depth), (array_to_string(parts[1:depth], '/'), depth, node_type))")
def module_structure(spark, sf_dir):
    lang = _read(spark, sf_dir, "pages").select("page_id", F.when(F.col("url").contains("/en/"), "en").otherwise("other").alias("node_type"))
    own = _urls(spark, sf_dir).join(lang, "page_id").select(F.col("path").alias("file"), "node_type")
    return rollup.module_structure(own, "")


@_query(f"WITH {_URL}, p AS (SELECT string_split(path, '/') AS parts FROM urls), d AS (SELECT parts, unnest(range(1, len(parts))) AS i FROM p) SELECT (SELECT count(*) FROM p) AS n_files, (SELECT avg(len(parts)) FROM p) AS avg_depth, (SELECT count(DISTINCT array_to_string(parts[1:i], '/')) FROM d) AS n_dirs")
def tree_stats(spark, sf_dir):
    return rollup.tree_stats(_urls(spark, sf_dir))


@_query("WITH e AS (SELECT event_id AS id, ts AS last_access, CAST(floor(value * 1000) AS BIGINT) AS n_bytes FROM events), r AS (SELECT id, n_bytes, coalesce(sum(n_bytes) OVER (ORDER BY last_access, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, row_number() OVER (ORDER BY last_access DESC, id DESC) AS recent FROM e) SELECT id, n_bytes FROM r WHERE freed < 50000000 AND recent > 2")
def lru_eviction(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("last_access"), F.floor(F.col("value") * 1000).alias("n_bytes"))
    return rollup.evictions(e, 50_000_000)


@_query("SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type <> 'view') AS misses, count(*) FILTER (event_type = 'view') / count(*)::DOUBLE AS rate FROM events")
def hit_rate(spark, sf_dir):
    return rollup.hit_rate(_read(spark, sf_dir, "events").select((F.col("event_type") == "view").alias("hit")))


# Changes


@_query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def file_hashes(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha256"))


_SNAP = "old AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS sha256 FROM documents WHERE lang <> 'fr'), new AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN source = 'src3' THEN text || '!' ELSE text END) AS sha256 FROM documents WHERE lang <> 'de'), diff AS (SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'deleted' ELSE 'modified' END AS op FROM old FULL JOIN new ON old.path = new.path WHERE old.sha256 IS DISTINCT FROM new.sha256)"


def _snapshots(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "lang", "source")
    old = d.where("lang <> 'fr'").select("path", F.sha2("text", 256).alias("sha256"))
    edited = F.when(F.col("source") == "src3", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return old, d.where("lang <> 'de'").select("path", F.sha2(edited, 256).alias("sha256"))


@_query(f"WITH {_SNAP} SELECT path, op FROM diff")
def snapshot_diff(spark, sf_dir):
    return changes.diff(*_snapshots(spark, sf_dir))


@_query(f"WITH {_SNAP} SELECT count(*) FILTER (op = 'added') AS n_added, count(*) FILTER (op = 'modified') AS n_modified, count(*) FILTER (op = 'deleted') AS n_deleted, count(*) AS n_total FROM diff")
def change_totals(spark, sf_dir):
    return changes.totals(changes.diff(*_snapshots(spark, sf_dir)))


@_query(f"WITH {_SNAP} SELECT path, sha256 FROM new")
def index_changes(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    c = changes.diff(old, new)
    return changes.replace(old, c, new.join(changes.to_process(c), "path", "left_semi"), "path")


@_query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_last_wins(spark, sf_dir):
    return resolve.last_wins(_read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@_query("WITH e AS (SELECT 'o:' || l_orderkey AS source, 'p:' || l_partkey AS target, 'USES' AS edge_type, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_linenumber END AS ref_line FROM lineitem) SELECT source, target, edge_type, coalesce(ref_line, -1) AS ref_line FROM (SELECT DISTINCT * FROM e WHERE ref_line IS NOT NULL UNION ALL SELECT * FROM e WHERE ref_line IS NULL)")
def dedupe_edges(spark, sf_dir):
    e = _read(spark, sf_dir, "lineitem").select(_key("o:", "l_orderkey").alias("source"), _key("p:", "l_partkey").alias("target"), F.lit("USES").alias("edge_type"), F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")).alias("ref_line"))
    return resolve.dedupe_edges(e).withColumn("ref_line", F.coalesce("ref_line", F.lit(-1)))


# Constraints


@_query("SELECT 'kind of type' AS rule, id FROM nodes WHERE NOT ((node_type = 'Container' AND kind IN ('component', 'file', 'module', 'namespace', 'package', 'repository', 'type', 'workspace')) OR (node_type = 'Callable' AND kind IN ('constructor', 'function', 'macro', 'method')) OR (node_type = 'Data' AND kind IN ('constant', 'field', 'local', 'parameter', 'property', 'value')))", True)
def constraint_semantic(spark, sf_dir):
    return constraints.semantic(nodes(spark, sf_dir))


@_query("SELECT 'node name' AS rule, id FROM nodes WHERE coalesce(trim(name), '') = '' UNION ALL SELECT 'line', id FROM nodes WHERE kind NOT IN ('repository', 'workspace', 'component') AND line < 1 UNION ALL SELECT 'file', id FROM nodes WHERE kind NOT IN ('repository', 'workspace', 'component') AND coalesce(file, '') = ''", True)
def constraint_structural(spark, sf_dir):
    return constraints.structural(nodes(spark, sf_dir).withColumn("end_line", F.col("line")), edges(spark, sf_dir))


@_query("SELECT DISTINCT 'dangling' AS rule, id FROM (SELECT source AS id FROM edges UNION SELECT target FROM edges) WHERE id NOT IN (SELECT id FROM nodes)", True)
def constraint_dangling(spark, sf_dir):
    return constraints.dangling(nodes(spark, sf_dir), edges(spark, sf_dir))


@_query("SELECT 'duplicate edge' AS rule, source || '->' || target AS id FROM edges GROUP BY source, target, edge_type HAVING count(*) > 1", True)
def constraint_duplicates(spark, sf_dir):
    return constraints.duplicates(edges(spark, sf_dir))


@_query("SELECT 'orphan' AS rule, id FROM nodes WHERE kind NOT IN ('repository', 'workspace') AND id NOT IN (SELECT target FROM edges)", True)
def constraint_orphans(spark, sf_dir):
    return constraints.orphans(nodes(spark, sf_dir), edges(spark, sf_dir))


@_query("SELECT 'file parent' AS rule, f.id FROM edges JOIN nodes f ON target = f.id AND f.kind = 'file' JOIN nodes u ON source = u.id AND u.kind NOT IN ('repository', 'component', 'workspace') WHERE edge_type = 'CONTAINS'", True)
def constraint_containment(spark, sf_dir):
    return constraints.containment(nodes(spark, sf_dir), edges(spark, sf_dir))


# Scalar functions


@_query(f"WITH {_URL} SELECT page_id, regexp_matches(path, '(^|/)(__pycache__|build|dist|node_modules|target|venv)(/|$)') OR regexp_matches(path, '(^|/)\\.[^./]') OR regexp_matches(path, '\\.(class|db|dll|dylib|egg|exe|o|obj|pyc|pyd|pyo|so|sqlite|sqlite3)$') OR regexp_matches(path, '^.*\\.html$') AS is_excluded FROM urls")
def exclude_filter(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", paths.is_excluded(F.col("path"), ("*.html",)).alias("is_excluded"))


@_query("WITH e AS (SELECT p_partkey, 'src/' || p_brand || '.' || ['py', 'ts', 'go', 'c', 'java', 'hpp', 'TSX'][1 + p_partkey % 7] AS path, ['python', 'typescript', 'go', 'c', NULL, 'cpp', 'tsx'][1 + p_partkey % 7] AS language FROM part) SELECT * FROM e")
def language_of_path(spark, sf_dir):
    ext = F.array(*[F.lit(x) for x in ("py", "ts", "go", "c", "java", "hpp", "TSX")])
    p = _read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("src/"), "p_brand", F.lit("."), F.get(ext, (F.col("p_partkey") % 7).cast("int"))).alias("path"))
    return p.withColumn("language", paths.language_of_path(F.col("path")))


@_query("WITH q AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations UNION ALL SELECT -p_partkey - 1, 0, replace(p_brand, '#', '_') FROM part UNION ALL SELECT -p_partkey - 1, 1, p_type FROM part) SELECT conv_id, turn, CASE WHEN ends_with(t, '?') OR regexp_split_to_array(lower(t), '\\s+')[1] IN ('are', 'can', 'do', 'does', 'how', 'is', 'what', 'when', 'where', 'which', 'who', 'why') THEN 'Question' WHEN regexp_matches(replace(t, ' ', ''), '^[A-Za-z_][A-Za-z0-9_-]*$') AND (contains(t, '_') OR contains(t, '-') OR regexp_matches(t, '[a-z][A-Z]') OR (NOT contains(t, ' ') AND regexp_matches(t, '^[A-Z]'))) THEN 'Identifier' ELSE 'Natural' END AS query_type FROM q")
def classify_query(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    p = _read(spark, sf_dir, "part").select((-F.col("p_partkey") - 1).alias("conv_id"), F.replace("p_brand", F.lit("#"), F.lit("_")).alias("b"), "p_type")
    q = c.unionByName(p.select("conv_id", F.lit(0).cast("long").alias("turn"), F.col("b").alias("text"))).unionByName(p.select("conv_id", F.lit(1).cast("long").alias("turn"), F.col("p_type").alias("text")))
    return q.select("conv_id", "turn", ranking.classify_query(F.col("text")).alias("query_type"))


@_query("SELECT DISTINCT p_partkey, unnest([p_name, lower(p_name), upper(p_name), upper(p_name[1]) || p_name[2:], lower(p_name[1]) || p_name[2:]]) AS variant FROM part")
def name_variants(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", F.explode(ranking.name_variants(F.col("p_name"))).alias("variant"))


@_query("WITH n AS (SELECT p_partkey, p_name, trim(lower(p_name)) AS n, trim(lower(unnest(['red', 'red_widget', 'red widget', 'a small ring of steel']))) AS q FROM part) SELECT p_partkey, q, round(CASE WHEN q = n THEN 0.35 WHEN regexp_replace(q, '[_-]', '', 'g') = regexp_replace(n, '[_-]', '', 'g') THEN 0.25 WHEN strlen(q) >= 3 AND contains(n, q) THEN CASE WHEN strlen(q) / strlen(n)::DOUBLE > 0.3 THEN 0.15 * (strlen(q) / strlen(n)::DOUBLE) ELSE 0 END WHEN strlen(q) >= 3 AND contains(q, n) AND strlen(n) >= 3 THEN 0.08 ELSE 0 END, 6)::DOUBLE AS bonus FROM n")
def exact_match_bonus(spark, sf_dir):
    q = F.explode(F.array(*[F.lit(x) for x in ("red", "red_widget", "red widget", "a small ring of steel")])).alias("q")
    return _read(spark, sf_dir, "part").select("p_partkey", "p_name", q).select("p_partkey", "q", F.round(ranking.exact_match_bonus(F.col("q"), F.col("p_name")), 6).alias("bonus"))


@_query("SELECT id, (CASE WHEN node_type = 'Callable' THEN 0.08 ELSE 0 END)::DOUBLE AS bonus, (CASE WHEN contains(lower(coalesce(file, '')), '/src/') THEN 0.06 WHEN contains(lower(coalesce(file, '')), '/test') THEN -0.03 ELSE 0 END)::DOUBLE AS boost FROM nodes", True)
def type_and_context(spark, sf_dir):
    q = "which method defines it"
    return nodes(spark, sf_dir).select("id", ranking.type_bonus(q, F.col("node_type")).alias("bonus"), ranking.context_boost(q, F.coalesce("file", F.lit(""))).alias("boost"))


def _keyword_sql() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(t, '{'|'.join(v.split())}') THEN '{k}' END" for k, v in text.KEYWORDS.items())
    return f"WITH d AS (SELECT doc_id, lower(coalesce(text, '')) || ' ' || lower(coalesce(source, '')) AS t FROM documents) SELECT doc_id, array_to_string(list_sort(list_filter([{cases}], lambda x: x IS NOT NULL)), ', ') AS keywords FROM d"


@_query(_keyword_sql())
def semantic_keywords(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(text.keywords(F.col("source"), F.col("text")), ", ").alias("keywords"))


@_query("WITH d AS (SELECT c_custkey, 'def f(self, ' || c_mktsegment || ': int, ' || c_nationkey || ' = 3, long ' || c_name || ',)' AS t FROM customer) SELECT c_custkey, c_mktsegment || ', ' || c_nationkey || ', ' || c_name AS params FROM d JOIN customer USING (c_custkey)")
def parameters(spark, sf_dir):
    t = F.concat(F.lit("def f(self, "), "c_mktsegment", F.lit(": int, "), F.col("c_nationkey").cast("string"), F.lit(" = 3, long "), "c_name", F.lit(",)"))
    return _read(spark, sf_dir, "customer").select("c_custkey", text.parameters(t).alias("params"))


@_query(f"WITH {_URL} SELECT page_id, array_to_string(string_split(path, '/')[-3:], '/') AS short, 'web_' || coalesce(nullif(regexp_extract(path, '^(.*)/', 1), ''), 'root') AS partition_id, string_split(path, '/')[-1] AS file_name FROM urls")
def path_functions(spark, sf_dir):
    p = F.col("path")
    return _urls(spark, sf_dir).select("page_id", paths.short_path(p).alias("short"), paths.partition_id(F.lit("web"), p).alias("partition_id"), paths.file_name(p).alias("file_name"))


@_query("WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t FROM documents), c AS (SELECT doc_id, t, list_max(list_filter(range(0, 301), lambda n: strlen(substring(t, 1, n)) <= 300)) AS n FROM d) SELECT doc_id, CASE WHEN strlen(t) <= 300 THEN t WHEN contains(substring(t, 1, n), ' ') THEN regexp_extract(substring(t, 1, n), '^(.*) ', 1) || '...' ELSE substring(t, 1, n) || '...' END AS preview FROM c")
def content_preview(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@_query("SELECT doc_id, array_to_string(string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10))[1:3], chr(10)) AS head FROM documents")
def read_lines(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.lines(F.col("text"), F.lit(2), F.lit(2), context=1).alias("head"))


@_query("WITH t AS (SELECT p_partkey, p_partkey % 6 AS k FROM part) SELECT p_partkey, ['definition', 'reference', 'definition', 'definition', NULL, 'definition'][1 + k] AS category, ['Callable', 'Callable', 'Container', 'Data', NULL, 'Container'][1 + k] AS node_type, ['function', NULL, 'type', 'constant', NULL, 'file'][1 + k] AS kind, [NULL, NULL, 'class', NULL, NULL, NULL][1 + k] AS subtype, ['test', NULL, NULL, 'fixture', NULL, NULL][1 + k] AS scope FROM t")
def parse_tags(spark, sf_dir):
    tags = F.array(*[F.lit(x) for x in ("@definition.callable.function.scope.test", "reference.callable", "definition.container.type.class", "definition.data.constant.scope.fixture", "nothing.callable", "definition.file")])
    t = paths.parse_tag(F.get(tags, (F.col("p_partkey") % 6).cast("int"))).alias("t")
    return _read(spark, sf_dir, "part").select("p_partkey", t).select("p_partkey", "t.*")


@_query("SELECT s_suppkey, ['lib/x', 'a/x', 'x', 'a/lib/x'][1 + s_suppkey % 4] AS path FROM supplier")
def normal_paths(spark, sf_dir):
    rel = F.array(*[F.lit(x) for x in ("../lib/./x", "x", "../../../x", "lib//x")])
    return _read(spark, sf_dir, "supplier").select("s_suppkey", paths.normal_path(F.lit("a"), F.get(rel, (F.col("s_suppkey") % 4).cast("int"))).alias("path"))


# Search


_UNIT = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@_query(f"SELECT a.vec_id AS query_id, b.vec_id, round({_UNIT}, 6) AS score FROM embeddings a, embeddings b QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_UNIT}, 6) DESC, b.vec_id) <= 10")
def knn_join(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.knn_join(e, e, 10).select("query_id", F.col("id").alias("vec_id"), "score")


def _first(spark, sf_dir, i: int) -> list[float]:
    return list(_read(spark, sf_dir, "embeddings").where(F.col("vec_id") == i).first()["embedding"])


def _points(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("entity_id"), F.concat(F.lit("name_"), F.col("label").cast("string")).alias("name"), F.element_at(F.array(F.lit("Container"), F.lit("Callable"), F.lit("Data")), F.col("label") % 3 + 1).alias("type"), F.concat(F.lit("lib/src/f"), F.col("label").cast("string")).alias("file_path"), F.col("embedding").alias("vector"))


@_query("SELECT b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id LIMIT 20")
def knn_topk(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    return search.knn(e, _first(spark, sf_dir, 0), 20, "vec_id", "embedding").select("vec_id", F.round("score", 6).alias("score"))


@_query("SELECT b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.label IN (1, 3) ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id LIMIT 20")
def knn_filtered(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    return search.knn(e, _first(spark, sf_dir, 0), 20, "vec_id", "embedding", F.col("label").isin(1, 3)).select("vec_id", F.round("score", 6).alias("score"))


_P = "p AS (SELECT lpad(vec_id::VARCHAR, 8, '0') AS entity_id, 'name_' || label AS name, ['Container', 'Callable', 'Data'][label % 3 + 1] AS type, embedding::DOUBLE[] AS v FROM embeddings)"


@_query(f"WITH {_P}, s AS (SELECT entity_id, name, type, list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS c FROM p ORDER BY c DESC, entity_id LIMIT 80) SELECT entity_id, round(greatest(0, least(1, CASE WHEN c <= 0.5 THEN c * 1.3 ELSE 0.65 * (c - 0.5) / 0.5 END + CASE WHEN name = 'name_4' THEN 0.35 ELSE 0 END + 0.06)), 6) AS score FROM s ORDER BY score DESC, entity_id LIMIT 20")
def code_only_rescaled(spark, sf_dir):
    return search.by_mode("code", _points(spark, sf_dir), _points(spark, sf_dir), "name_4", [], _first(spark, sf_dir, 0), 20).select("entity_id", F.round("score", 6).alias("score"))


@_query(f"WITH {_P}, l AS (SELECT 'semantic' AS via, entity_id, name, row_number() OVER (ORDER BY list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, entity_id) - 1 AS rank FROM p UNION ALL SELECT 'code', entity_id, name, row_number() OVER (ORDER BY list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)) DESC, entity_id) - 1 FROM p), n AS (SELECT entity_id, name FROM p WHERE name = 'name_4' ORDER BY entity_id LIMIT 10), g AS (SELECT entity_id, any_value(name) AS name, max(rank) FILTER (via = 'semantic') AS rs, max(rank) FILTER (via = 'code') AS rc FROM l WHERE rank < 80 GROUP BY entity_id), f AS (SELECT coalesce(g.entity_id, n.entity_id) AS entity_id, coalesce(g.name, n.name) AS name, rs, rc, n.entity_id IS NOT NULL AS named FROM g FULL JOIN n ON g.entity_id = n.entity_id) SELECT entity_id, round(greatest(0, least(1, 30 * (coalesce(0.5::DOUBLE / (61 + rs), 0) + coalesce(0.5::DOUBLE / (61 + rc), 0) + CASE WHEN named THEN 1::DOUBLE / 61 ELSE 0 END) + CASE WHEN named OR name = 'name_4' THEN 0.35 ELSE 0 END + 0.06)), 6) AS score, array_to_string(list_filter([CASE WHEN rs IS NOT NULL THEN 'semantic' END, CASE WHEN rc IS NOT NULL THEN 'code' END, CASE WHEN named THEN 'name' END], lambda x: x IS NOT NULL), ',') AS found_via FROM f ORDER BY score DESC, entity_id LIMIT 20")
def hybrid_rrf(spark, sf_dir):
    p = _points(spark, sf_dir)
    hits = search.hybrid(p, p, "name_4", _first(spark, sf_dir, 0), _first(spark, sf_dir, 1), 20)
    return hits.select("entity_id", F.round("score", 6).alias("score"), F.array_join("found_via", ",").alias("found_via"))


@_query("WITH r AS (SELECT source AS workspace, doc_id::VARCHAR AS id, n_chars / 100000.0 AS score FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id::VARCHAR) <= 60) SELECT workspace || '::' || id AS id, workspace, score::DOUBLE AS score FROM r ORDER BY score DESC, id LIMIT 30")
def multi_workspace_merge(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.col("source").alias("workspace"), F.col("doc_id").cast("string").alias("id"), (F.col("n_chars") / 100000.0).alias("score"))
    return search.merge_workspaces(d, 30)

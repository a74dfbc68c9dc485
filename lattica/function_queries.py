"""Queries of column functions, small operators and event-time windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import paths, ranking, text
from .operators import changes, constraints, lookup, resolve, rollup, search, traverse
from .queries import _query, _read, _URL, _urls, edges, nodes
from .streaming import sync

# Names, tags and ids


def _pick(key: str, values: list):
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


_TAGS = ["@manifest.dependency.scope.dev", "manifest.component.name", "@name.definition.data", "manifest.workspace.member.scope.x", "manifest.other"]


@_query(f"SELECT p_partkey, {_list([True, True, False, True, True])}[1 + p_partkey % 5]::BOOLEAN AS is_manifest, {_list(['dependency', 'component.name', None, 'workspace.member', None])}[1 + p_partkey % 5] AS element, {_list(['dev', None, None, 'x', None])}[1 + p_partkey % 5] AS scope, {_list(['manifest.dependency.scope.dev', 'manifest.component.name', 'definition.data', 'manifest.workspace.member.scope.x', 'manifest.other'])}[1 + p_partkey % 5] AS plain FROM part")
def manifest_tags(spark, sf_dir):
    t = _read(spark, sf_dir, "part").select("p_partkey", _pick("p_partkey", _TAGS).alias("t"))
    m = paths.parse_manifest_tag(F.col("t"))
    return t.select("p_partkey", paths.is_manifest_tag(F.col("t")).alias("is_manifest"), m["element"].alias("element"), m["scope"].alias("scope"), paths.normal_tag(F.col("t")).alias("plain"))


@_query(f"WITH {_URL} SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '')[-1] AS last, regexp_replace(path, '[/:\\\\]', '_', 'g') AS safe, regexp_extract(path, '^(.*)/', 1) AS directory FROM urls")
def names_from_paths(spark, sf_dir):
    p = F.col("path")
    return _urls(spark, sf_dir).select("page_id", paths.last_segment(p).alias("last"), paths.safe_name(p).alias("safe"), paths.directory(p).alias("directory"))


@_query("SELECT p_partkey, 'Core' || p_partkey AS name FROM part")
def project_names(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    p = F.concat(_pick("p_partkey", ["..\\lib\\", "src/", "", "a/b\\"]), F.lit("Core"), k, _pick("p_partkey", [".csproj", ".vbproj", ".fsproj"]))
    return _read(spark, sf_dir, "part").select("p_partkey", paths.project_name(p).alias("name"))


@_query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'workspace:*' WHEN 1 THEN 'path:' || p_brand WHEN 2 THEN 'project:' || p_brand WHEN 3 THEN 'replace:' || p_brand WHEN 4 THEN 'subdir:' || p_brand END AS spec, CASE WHEN p_size > 25 THEN '^1' ELSE CASE p_partkey % 6 WHEN 0 THEN 'workspace:*' WHEN 1 THEN 'path:' || p_brand WHEN 2 THEN 'project:' || p_brand WHEN 3 THEN 'replace:' || p_brand WHEN 4 THEN 'subdir:' || p_brand END END AS own FROM part")
def version_specs(spark, sf_dir):
    kind = _pick("p_partkey", ["workspace", "path", "project_reference", "replace", "subdirectory", "registry"])
    return _read(spark, sf_dir, "part").select("p_partkey", paths.version_spec(kind, F.col("p_brand")).alias("spec"), paths.version_spec(kind, F.col("p_brand"), F.when(F.col("p_size") > 25, "^1")).alias("own"))


@_query(f"SELECT p_partkey, {_list(['CONTAINS', 'DEPENDS_ON', 'DEPENDS_ON', 'USES', None, 'DEFINES'])}[1 + p_partkey % 6] AS edge_type FROM part")
def edge_type_names(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", paths.edge_type_of(_pick("p_partkey", ["Contains", "dependsOn", "DEPENDS_ON", "uses", "calls", "Defines"])).alias("edge_type"))


@_query("SELECT c_custkey, c_mktsegment || '::' || c_name AS id, c_mktsegment AS workspace, c_name AS own, NULL::VARCHAR AS none FROM customer")
def workspace_ids(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", paths.prefixed(F.col("c_mktsegment"), F.col("c_name")).alias("id"))
    u = paths.unprefixed(F.col("id"))
    return c.select("c_custkey", "id", u["workspace"].alias("workspace"), u["id"].alias("own"), paths.unprefixed(F.col("c_name"))["workspace"].alias("none"))


@_query(f"SELECT p_partkey, {_list(['public', 'private', 'protected', 'public'])}[1 + p_partkey % 4] AS python, {_list(['private', 'private', 'private', 'public'])}[1 + p_partkey % 4] AS go, NULL::VARCHAR AS c FROM part")
def name_visibility(spark, sf_dir):
    n = _pick("p_partkey", ["__init__", "__x", "_x", "X"])
    return _read(spark, sf_dir, "part").select("p_partkey", paths.name_visibility(F.lit("python"), n).alias("python"), paths.name_visibility(F.lit("go"), n).alias("go"), paths.name_visibility(F.lit("c"), n).alias("c"))


@_query("SELECT c_custkey, 'f.py:A:B:' || c_name AS deep, 'f.py:' || c_name AS flat, 'f.py:<' || c_name || '>:' || c_nationkey AS anonymous FROM customer")
def node_ids(spark, sf_dir):
    n, none = F.col("c_name"), F.array().cast("array<string>")
    return _read(spark, sf_dir, "customer").select("c_custkey", paths.node_id(F.lit("f.py"), F.array(F.lit("A"), F.lit("B")), n).alias("deep"), paths.node_id(F.lit("f.py"), none, n).alias("flat"), paths.node_id(F.lit("f.py"), none, F.concat(F.lit("<"), n, F.lit(">")), F.col("c_nationkey")).alias("anonymous"))


@_query("SELECT kind, node_type, kind IN ('component', 'file', 'module', 'namespace', 'package', 'repository', 'type', 'workspace') AS is_container FROM (SELECT DISTINCT kind, node_type FROM nodes)", True)
def kinds_and_types(spark, sf_dir):
    k = nodes(spark, sf_dir).select("kind").distinct()
    return k.select("kind", paths.node_type_of_kind(F.col("kind")).alias("node_type"), paths.is_valid_kind(F.lit("Container"), F.col("kind")).alias("is_container"))


@_query("SELECT DISTINCT name, name IN ('build', 'target') AS visible, name IN ('build', 'target', '.x') AS skipped FROM (SELECT ['src', 'build', '.x', 'target', 'lib'][1 + p_partkey % 5] AS name FROM part)")
def directory_skip(spark, sf_dir):
    d = _read(spark, sf_dir, "part").select(_pick("p_partkey", ["src", "build", ".x", "target", "lib"]).alias("name")).distinct()
    return d.select("name", paths.skips_dir(F.col("name"), False).alias("visible"), paths.skips_dir(F.col("name")).alias("skipped"))


# Numbers and texts


@_query("SELECT o_orderkey, floor((o_custkey * 512 + o_orderkey * 128) * 1.4::DOUBLE)::BIGINT AS estimate, floor((o_custkey * 100 + o_orderkey * 10) * 2.0::DOUBLE)::BIGINT AS own, greatest(o_orderkey + o_custkey - 500, 0) AS needed FROM orders")
def memory_estimates(spark, sf_dir):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select("o_orderkey", paths.memory_estimate(c, o).alias("estimate"), paths.memory_estimate(c, o, 100, 10, 2.0).alias("own"), paths.needed_bytes(F.lit(500), o, c).alias("needed"))


@_query("SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:,.2f} KB', n / 1024.0) WHEN n < 1073741824 THEN format('{:,.2f} MB', n / 1048576.0) ELSE format('{:,.2f} GB', n / 1073741824.0) END AS size FROM (SELECT o_orderkey, o_orderkey * o_custkey % 7 * 1048576 * (o_orderkey % 300) + o_orderkey AS n FROM orders)")
def human_sizes(spark, sf_dir):
    o = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select("o_orderkey", paths.human_size(o * F.col("o_custkey") % 7 * 1048576 * (o % 300) + o).alias("size"))


@_query("SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 5) AS length, round(u[1], 5) AS first FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS u FROM embeddings)")
def unit_vectors(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").select("vec_id", ranking.l2_normal(F.col("embedding")).alias("u"))
    return e.select("vec_id", F.round(F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 5).alias("length"), F.round(F.col("u")[0].cast("double"), 5).alias("first"))


@_query("SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS snippet FROM documents")
def snippets(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@_query("SELECT doc_id, array_to_string(string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10))[2:5], chr(10)) AS part FROM documents")
def read_window(spark, sf_dir):
    """Lines 3 and 4 with one more on either side, at most four."""
    return _read(spark, sf_dir, "documents").select("doc_id", text.lines(F.col("text"), F.lit(3), F.lit(4), context=1, most=4).alias("part"))


# Roll-ups and constraints


@_query("SELECT 'nodes' AS metric, node_type AS name, 2 * count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'kind', kind, 2 * count(*) FROM nodes WHERE kind IN ('file', 'component') GROUP BY ALL UNION ALL SELECT 'edges', edge_type, 2 * count(*) FROM edges GROUP BY ALL", True)
def workspace_stats(spark, sf_dir):
    """The counts of two workspaces, here the same graph twice."""
    one = rollup.graph_stats(nodes(spark, sf_dir), edges(spark, sf_dir))
    return rollup.merged_stats(one, one)


@_query("WITH s AS (SELECT CASE event_type WHEN 'error' THEN 'fail' WHEN 'click' THEN 'warn' WHEN 'view' THEN 'skip' ELSE 'pass' END AS status FROM events) SELECT count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'warn') AS n_warn, count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status = 'skip') AS n_skip, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS overall FROM s")
def health_summary(spark, sf_dir):
    t = F.col("event_type")
    return rollup.worst_status(_read(spark, sf_dir, "events").select(F.when(t == "error", "fail").when(t == "click", "warn").when(t == "view", "skip").otherwise("pass").alias("status")))


@_query("SELECT o_orderkey, abs(o_custkey - o_orderkey % 1500) > o_custkey // 10 AS stale FROM orders")
def stale_indexes(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", rollup.stale(F.col("o_custkey"), F.col("o_orderkey") % 1500).alias("stale"))


@_query("WITH c AS (SELECT event_type AS name, count(*) AS n FROM events GROUP BY ALL), w(name, least) AS (VALUES ('click', 10), ('view', 1000000000), ('nothing', 5), ('error', 1)) SELECT w.name, coalesce(n, 0) AS n, w.least::BIGINT AS least, coalesce(n, 0) >= floor(w.least * 0.9) AS ok FROM w LEFT JOIN c ON w.name = c.name")
def minimum_counts(spark, sf_dir):
    c = _read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return constraints.minimum_counts(c, {"click": 10, "view": 1_000_000_000, "nothing": 5, "error": 1})


@_query("SELECT count(DISTINCT file) AS n_files, count(DISTINCT regexp_extract(file, '^(.*)/', 1)) AS n_directories FROM nodes", True)
def unique_files(spark, sf_dir):
    return nodes(spark, sf_dir).agg(F.countDistinct("file").alias("n_files"), F.countDistinct(paths.directory(F.col("file"))).alias("n_directories"))


@_query("WITH h AS (SELECT sha256(doc_id || chr(0) || sha256(text)) AS h FROM documents), s AS (SELECT " + ", ".join(f"sum(('0x' || h[{1 + 8 * i}:{8 + 8 * i}])::BIGINT)::VARCHAR AS w{i}" for i in range(8)) + ", count(*) AS n FROM h) SELECT sha256(concat_ws(',', n, " + ", ".join(f"w{i}" for i in range(8)) + ")) AS version FROM s")
def graph_version(spark, sf_dir):
    """The version of a snapshot; chr(0) is what separates path and hash."""
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    return changes.version(d)


@_query("SELECT user_id, event_type, count(*) AS n, bool_or(value > 50) AS any_high FROM events GROUP BY CUBE (user_id, event_type)")
def event_cube(spark, sf_dir):
    """Cubes through the SQL front end."""
    _read(spark, sf_dir, "events").createOrReplaceTempView("events_")
    return spark.sql("SELECT user_id, event_type, count(*) AS n, bool_or(value > 50) AS any_high FROM events_ GROUP BY CUBE (user_id, event_type)")


# Drawing and trees


@_query("SELECT '  \"' || r_name || '\" -> \"' || n_name || '\";' AS line FROM nation JOIN region ON n_regionkey = r_regionkey")
def drawn_edges(spark, sf_dir):
    """Regions and nations as lines of dot."""
    n, r = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    rows = [(x.r_name, x.n_name) for x in n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").collect()]  # as many as nations
    return spark.createDataFrame([(x,) for x in traverse.draw(rows).split("\n")[1:-2]], "line string")


@_query("SELECT '  ' || n_name AS line FROM nation UNION ALL SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def drawn_tree(spark, sf_dir):
    n, r = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    rows = [(x.r_name, x.n_name) for x in n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").collect()]  # as many as nations
    return spark.createDataFrame([(x,) for x in traverse.draw(rows, "ascii").split("\n")[:-1]], "line string")


# Search

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@_query(f"SELECT b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND {_COS} >= 0.1 ORDER BY {_COS} DESC, b.vec_id LIMIT 15")
def knn_min_score(spark, sf_dir):
    from .queries import _first

    e = _read(spark, sf_dir, "embeddings")
    return search.knn(e, _first(spark, sf_dir, 0), 15, "vec_id", "embedding").where("score >= 0.1").select("vec_id", F.round("score", 6).alias("score"))


@_query("SELECT name, entity_id FROM (SELECT 'name_' || label AS name, lpad(vec_id::VARCHAR, 8, '0') AS entity_id FROM embeddings) WHERE name IN ('name_2', 'name_7') QUALIFY row_number() OVER (PARTITION BY name ORDER BY entity_id) <= 5")
def points_by_name(spark, sf_dir):
    from .queries import _points

    return search.by_name(_points(spark, sf_dir), ["name_2", "name_7"], 5).select("name", "entity_id")


@_query("SELECT DISTINCT file_path FROM (SELECT 'lib/src/f' || label AS file_path, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) AS c, vec_id FROM embeddings ORDER BY c DESC, lpad(vec_id::VARCHAR, 8, '0') LIMIT 12)")
def files_of_hits(spark, sf_dir):
    from .queries import _first, _points

    return search.knn(_points(spark, sf_dir), _first(spark, sf_dir, 3), 12).select("file_path").distinct()


@_query("SELECT id FROM nodes WHERE kind NOT IN ('file', 'repository') AND trim(name) <> ''", True)
def index_filter(spark, sf_dir):
    return nodes(spark, sf_dir).where("kind not in ('file', 'repository') and trim(name) <> ''").select("id")


@_query("SELECT 'ws::' || id AS id, name FROM nodes WHERE regexp_matches(name, '^.*ASIA.*$')", True)
def find_nodes_in_workspaces(spark, sf_dir):
    n = lookup.find_nodes(nodes(spark, sf_dir), "*ASIA*")
    return n.select(paths.prefixed(F.lit("ws"), F.col("id")).alias("id"), "name")


# Event time, and joins by it


@_query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark, sf_dir):
    return sync.windowed(_read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@_query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, session")
def user_sessions(spark, sf_dir):
    return sync.sessions(_read(spark, sf_dir, "events"))


@_query("SELECT e.event_id, (SELECT max_by(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'view' AND p.ts <= e.ts) AS view_id FROM events e WHERE e.event_type = 'purchase'")
def as_of_join(spark, sf_dir):
    """The last view of a user at the time of each purchase."""
    e = _read(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "ts")
    return resolve.as_of(left, right, ["user_id"], "ts", "view_id").select("event_id", "view_id")


@_query("SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def users_in_both(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.where("event_type = 'view'").select("user_id").intersect(e.where("event_type = 'error'").select("user_id"))

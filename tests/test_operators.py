"""Operators and column functions on small inputs, and against plain Python on random graphs."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica import tree_queries
from lattica.functions import embed, paths, ranking, text
from lattica.operators import changes, constraints, lookup, resolve, rollup, search, traverse, vectors
from lattica.plans import build, tables
from lattica.sources import extract, manifests, walk


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "z int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("query", "kind"),
    [("parseFile", "Identifier"), ("parse_file", "Identifier"), ("ParseFile", "Identifier"), ("MAX_VALUE", "Identifier"), ("how does authentication work?", "Question"), ("what is the purpose of this function", "Question"), ("How to implement caching", "Question"), ("user authentication logic", "Natural"), ("database connection handling", "Natural"), ("VM allocation", "Natural"), ("", "Natural"), ("x-y", "Identifier")],
)
def test_classification(spark, query, kind):
    assert one(spark, ranking.classify_query(F.col("q")), q=query) == kind == search.query_type(query)


def test_bonuses(spark):
    b = lambda q, n: round(one(spark, ranking.exact_match_bonus(q, F.col("n")), n=n), 4)
    assert b(" ParseFile", "parsefile") == 0.35 and b("parse_file", "parseFile") == 0.25
    assert b("parse", "parse_file") == round(0.15 * 5 / 10, 4) and b("par", "parse_file_into") == 0 and b("the parse_file", "parse_file") == 0.08 and b("ab", "abc") == 0
    assert one(spark, ranking.rescale(F.lit(0.5))) == 0.65 and one(spark, ranking.rescale(F.lit(1.0))) == 0.65
    assert one(spark, ranking.type_bonus("find class def", F.lit("Callable"))) == 0 and one(spark, ranking.type_bonus("def x", F.lit("Callable"))) == 0.08
    assert one(spark, ranking.context_boost("q", F.lit("a/src/b"))) == 0.06 and one(spark, ranking.context_boost("q", F.lit("a/tests/b"))) == -0.03 and one(spark, ranking.context_boost("Test q", F.lit("a/tests/b"))) == 0


def test_paths(spark):
    f = lambda c, **v: one(spark, c, **v)
    p = F.col("p")
    for path, excluded in [("a/.git/x", True), (".env", True), ("a/b.py", False), ("node_modules/x.js", True), ("src/builds/x.py", False), ("a/x.pyc", True), ("a..b/c", False), ("./a", False)]:
        assert f(paths.is_excluded(p), p=path) == excluded, path
    assert f(paths.is_excluded(p, ("docs/*",)), p="docs/a/b.md") and not f(paths.is_excluded(p, ("*.md",)), p="a.mdx")
    assert f(paths.language_of_path(p), p="A/b.HPP") == "cpp" and f(paths.language_of_path(p), p="a.jsx") is None and f(paths.language_of_path(p), p=".py") is None
    assert f(paths.manifest_language(p), p="x/App.csproj") == "xml" and f(paths.manifest_language(p), p="go.mod") == "gomod"
    assert f(paths.partition_id(F.lit("r"), p), p="a/b/c.py") == "r_a/b" and f(paths.partition_id(F.lit("r"), p), p="c.py") == "r_root"
    assert f(paths.normal_path(F.lit("a/b"), p), p="../../../c/./d") == "c/d" and f(paths.normal_path(F.lit("a"), p), p="/x") == "x"
    assert f(paths.parse_node_id(p), p="f.py:A:b").asDict() == {"file": "f.py", "containers": ["A"], "name": "b"} and f(paths.parse_node_id(p), p="f.py") is None
    assert f(paths.node_id(F.lit("f"), F.array(F.lit("A")), p, F.lit(3)), p="<x>") == "f:A:<x>:3"
    assert f(paths.parse_tag(p), p="@definition.callable.method.static.scope.test").asDict() == {"category": "definition", "node_type": "Callable", "kind": "method", "subtype": "static", "scope": "test"}
    assert f(paths.parse_tag(p), p="definition.data.variable").kind is None and f(paths.parse_tag(p), p="x") is None
    assert f(paths.parse_manifest_tag(p), p="manifest.dependency.scope.dev").asDict() == {"element": "dependency", "scope": "dev"} and f(paths.parse_manifest_tag(p), p="manifest.other") is None
    assert f(paths.project_name(p), p="..\\lib\\Core.csproj") == "Core" and f(paths.last_segment(p), p="a/b//") == "b"
    assert f(paths.unprefixed(p), p="ws::f:a::b").asDict() == {"workspace": "ws", "id": "f:a::b"}
    assert f(paths.edge_type_of(p), p="dependsOn") == "DEPENDS_ON" and f(paths.edge_type_of(p), p="x") is None
    assert [f(paths.name_visibility(F.lit("python"), p), p=n) for n in ("__a__", "__a", "_a", "a")] == ["public", "private", "protected", "public"]
    assert f(paths.human_size(F.lit(1536))) == "1.50 KB"


def test_text(spark):
    assert one(spark, text.parameters(F.col("t")), t="f(self, a: int, b=2, long c, cls)") == "a, b, c" and one(spark, text.parameters(F.col("t")), t="f()") is None
    long = "é" * 149 + " ab cd"
    assert one(spark, text.preview(F.col("t")), t=long) == "é" * 149 + "..." == text.preview_text(long)
    assert one(spark, text.preview(F.col("t")), t="x" * 400) == "x" * 300 + "..." and one(spark, text.preview(F.col("t")), t=" a \n b ") == "a b"
    assert one(spark, text.lines(F.col("t"), F.lit(2), F.lit(2)), t="a\nb\nc\n") == "b" and one(spark, text.lines(F.col("t"), F.lit(9), F.lit(9)), t="a") == ""
    assert one(spark, text.lines(F.col("t"), F.lit(2), F.lit(2), 5, 2), t="a\nb\nc") == "a\nb"
    assert one(spark, text.keywords(F.col("n"), F.lit("jwt"), F.lit("benchmark")), n="HttpClient") == ["HTTP", "authentication", "networking", "performance"]


def test_python_extraction():
    nodes, edges, refs = extract.build_file("a.py", "X = 1\nclass A(B):\n    y = 2\n    @staticmethod\n    async def f(p):\n        g(p)\n    def A(self): pass\ndef <".replace("def <", "def g(q): return A()"), "python")
    kinds = {n["id"]: n["kind"] for n in nodes}
    assert kinds["a.py:A:f"] == "method" and kinds["a.py:X"] == "constant" and kinds["a.py:A:f:p"] == "parameter" and kinds["a.py:A:A"] == "method"
    assert ("a.py:A", "a.py:A:y", "DEFINES") in edges and ("a.py", "a.py:X", "CONTAINS") in edges and ("a.py", "a.py:X", "DEFINES") not in edges
    assert ("g", "a.py:A:f", 6) in refs and ("B", "a.py:A", 2) in refs and ("A", "a.py:g", 8) in refs
    meta = next(n for n in nodes if n["id"] == "a.py:A:f")["metadata"]
    assert meta["static"] and meta["async"] and meta["decorators"] == ["staticmethod"]
    assert extract.build_file("a.py", "def broken(:\n  pass\nclass Ok:\n  def m(self): pass\n", "python")[0]
    assert [n["kind"] for n in extract.build_file("e.py", "", "python")[0]] == ["file"]


@pytest.mark.parametrize(
    ("language", "code", "want"),
    [
        ("go", "package p\ntype S struct {\n\tn int\n}\nfunc (s *S) M() int { return s.n }\nfunc F() { x.M() }\n", {"p": "module", "p:S": "type", "p:S:n": "field", "p:S:M": "method", "p:F": "function"}),
        ("rust", "pub struct S { pub n: i32 }\nimpl S {\n    pub fn m(&self) -> i32 { self.n }\n}\nenum E {\n    A,\n}\nfn f() {}\n", {"S": "type", "S:m": "method", "E": "type", "E:A": "constant", "f": "function"}),
        ("typescript", "interface I { a(): void; }\nexport class C {\n  x = 1;\n  constructor() {}\n  m(a: string): void { f(a); }\n}\nfunction f(b) {}\nconst g = (x) => x;\n", {"I": "type", "C": "type", "C:constructor": "constructor", "C:m": "method", "C:m:a": "parameter", "C:x": "field", "f": "function", "g": "function"}),
        ("c", "struct P {\n  int x;\n};\nint add(int a, int b) {\n  return a + b; // }\n}\n", {"P": "type", "P:x": "field", "add": "function", "add:a": "parameter"}),
        ("cpp", "namespace n {\nclass C {\n public:\n  C() {}\n  int m() { return 1; }\n};\n}\n", {"n": "namespace", "n:C": "type", "n:C:C": "constructor", "n:C:m": "method"}),
        ("csharp", "namespace N {\n  public class C {\n    private int f = 1;\n    public int P { get; set; }\n    public C() {}\n    public void M(int a) {}\n  }\n}\n", {"N": "namespace", "N:C": "type", "N:C:f": "field", "N:C:P": "property", "N:C:C": "constructor", "N:C:M": "method"}),
    ],
)
def test_scanners(language, code, want):
    nodes, _, _ = extract.build_file("f", code, language)
    got = {n["id"].removeprefix("f:"): n["kind"] for n in nodes}
    assert {k: got.get(k) for k in want} == want


def test_manifests():
    assert manifests.parse("Cargo.toml", '[package]\nname = "a"\nversion = "1"\n[dependencies]\nb = { path = "../b" }\nserde = "1"\n[dev-dependencies]\nc = { path = "../c" }')["local_dependencies"][1]["is_dev"]
    x = manifests.parse("go.mod", "module m/x\nrequire a v1\nreplace a => ../a // c\nreplace b => b.org v2\n")
    assert x["name"] == "m/x" and [d["path"] for d in x["local_dependencies"]] == ["../a"]
    assert manifests.parse("A.csproj", '<Project><ItemGroup><ProjectReference Include="..\\B\\B.csproj"/></ItemGroup></Project>')["local_dependencies"][0]["name"] == "B"
    assert manifests.parse("CMakeLists.txt", "project(top VERSION 1.2)\nadd_subdirectory(lib/x) # no\n")["local_dependencies"][0] == {"name": "x", "path": "lib/x", "dep_type": "subdirectory", "is_dev": False, "is_build": False, "version_spec": None}
    assert manifests.parse("pyproject.toml", '[tool.poetry]\nname = "p"\n[tool.poetry.dependencies]\nq = {path = "../q"}')["name"] == "p"
    assert manifests.parse("package.json", "{") is None and manifests.parse("package.json", "{}") is None and manifests.parse("x.txt", "") is None


def test_ignore_rules():
    rules = [walk.Rules("*.log\n!keep.log\n/top\nsub/dir/\n# no\ndeep/**/x\n\\#hash\n[a-c]?.txt\nwide/**\nblank \n")]
    for path, want in [("a/b.log", True), ("a/keep.log", False), ("top", True), ("a/top", False), ("sub/dir", False), ("deep/a/b/x", True), ("deep/x", True), ("other", False), ("#hash", True), ("b1.txt", True), ("d1.txt", False), ("wide/x", True), ("blank", True)]:
        assert walk.ignored(path, False, rules) == want, path
    assert walk.ignored("sub/dir", True, rules) and not walk.ignored("x/sub/dir", True, rules)
    many = [walk.Rules("\n".join(f"/gone/f{i}\n*.g{i}" for i in range(5000)))]
    assert walk.ignored("gone/f4999", False, many) and walk.ignored("a/b.g17", False, many) and not walk.ignored("gone/f5000", False, many)


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(6)
    ids = [f"n{i}" for i in range(25)]
    pairs = sorted({(r.choice(ids), r.choice(ids)) for _ in range(45)})
    e = spark.createDataFrame([(a, b, "USES", None) for a, b in pairs], "source string, target string, edge_type string, ref_line int").cache()
    n = spark.createDataFrame([(i, i, "Callable", "function", None, "f", 1, 1) for i in ids], "id string, name string, node_type string, kind string, subtype string, file string, line int, end_line int").cache()
    return ids, pairs, n, e


def test_chains_equal_search(graph):
    ids, pairs, nodes, edges = graph
    then = {i: sorted(b for a, b in pairs if a == i) for i in ids}

    def walk(path):
        new = [b for b in then[path[-1]] if b not in path]
        if len(path) == 4 or not new:
            return [path] if len(path) > 1 else []
        return [p for b in new for p in walk([*path, b])]

    want = sorted(p for i in ids for p in walk([i]))
    assert sorted(r.path for r in traverse.chains(edges, nodes, 3, upstream=False).collect()) == want
    few = traverse.chains(edges, nodes, 3, upstream=False, most=2).collect()
    assert sorted(r.path for r in few) == sorted(p for i in ids for p in [x for x in want if x[0] == i][:2])


def test_reachable_equals_search(graph):
    ids, pairs, nodes, edges = graph
    want = {}
    for s in ids:
        seen, front, d = {s: 0}, [s], 0
        while front:
            d += 1
            front = [b for b in {b for a, b in pairs if a in front} if b not in seen]
            seen.update(dict.fromkeys(front, d))
        want |= {(s, k): v for k, v in seen.items()}
    assert {(r.start, r.id): r.depth for r in traverse.reachable(edges, nodes).collect()} == want
    assert {(r.start, r.id): r.depth for r in traverse.reachable(edges, nodes, depth=2).collect()} == {k: v for k, v in want.items() if v <= 2}


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b", "CONTAINS"), ("b", "c", "CONTAINS"), ("c", "a", "CONTAINS"), ("x", "y", "CONTAINS")], "source string, target string, edge_type string")
    assert {r.id for r in traverse.on_cycles(e).collect()} == {"a", "b", "c"}
    assert traverse.on_cycles(e.where("source = 'x'")).count() == 0
    assert "(circular)" in traverse.draw([("a", "b"), ("b", "a")], "ascii") and "-->" in traverse.draw([("a", "b")], "mermaid")


def test_what_hangs_below_a_cycle_is_left_and_leaves_go_at_once(spark, monkeypatch):
    kept, write = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: kept.append(write(df)) or kept[-1])
    tree = [(f"n{i}", f"n{i + 1}", "CONTAINS") for i in range(3)] + [("n3", f"leaf{i}", "CONTAINS") for i in range(50)]
    e = lambda rows: spark.createDataFrame(rows, "source string, target string, edge_type string")
    assert traverse.on_cycles(e(tree)).count() == 0
    assert sum(df.count() for df in kept[1:]) < 50
    rows = [("a", "b", "CONTAINS"), ("b", "a", "CONTAINS"), ("b", "a", "CONTAINS"), ("b", "c", "CONTAINS"), ("x", "a", "CONTAINS")]
    assert {r.id for r in traverse.on_cycles(e(rows)).collect()} == {"a", "b", "c"}


def test_links_and_guards_are_not_made_distinct_first(spark):
    e = spark.createDataFrame([("a", "b", "USES"), ("a", "b", "USES"), ("a", "b", "DEFINES"), ("b", "z", "USES")], "source string, target string, edge_type string")
    n = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan(traverse._links(e, None, False)) + plan(lookup.guarded(e, n))
    assert lookup.guarded(e, n).count() == 3
    assert sorted(map(tuple, traverse.reachable(e, n.where("id = 'a'")).collect())) == [("a", "a", 0), ("a", "b", 1), ("a", "z", 2)]


def test_lookup(graph, spark):
    ids, pairs, nodes, edges = graph
    out = [b for a, b in pairs if a == "n1"]
    into = [a for a, b in pairs if b == "n1"]
    assert sorted(r.node_id for r in lookup.connected(edges, nodes, "n1").collect()) == sorted(out + into)
    assert sorted(r.node_id for r in lookup.connected(edges, nodes, "n1", "nothing", "outgoing").collect()) == sorted(out)
    with pytest.raises(ValueError):
        lookup.connected(edges, nodes, "n1", direction="up")
    got = lookup.references(edges.withColumn("ident", F.lit(None).cast("string")), nodes, "n1", limit=1).collect()
    assert len(got) == min(1, len(into)) and all(r.truncated for r in got)
    gone, left = lookup.remove_nodes(nodes, edges, nodes.where("id = 'n1'"))
    assert gone.count() == 24 and left.count() == sum("n1" not in p for p in pairs)
    extra = edges.unionByName(spark.createDataFrame([("n1", "nowhere", "USES", 1)], edges.schema))
    assert lookup.guarded(extra, nodes).count() == len(pairs) and constraints.dangling(nodes, extra).first().id == "nowhere"


def test_enclosing_equals_brute_force(spark):
    r = random.Random(8)
    spans = [(i, r.choice("ab"), s, s + r.randrange(200)) for i, s in enumerate(r.randrange(300) for _ in range(60))]
    points = [(i, r.choice("abc"), r.randrange(500)) for i in range(120)]
    got = {x.point_id: x.span_id for x in resolve.enclosing(spark.createDataFrame(points, "point_id int, file string, line int"), spark.createDataFrame(spans, "span_id int, file string, start_line int, end_line int")).collect()}
    for i, f, n in points:
        cover = [(e - s, -s, j) for j, g, s, e in spans if g == f and s <= n <= e]
        assert got[i] == (min(cover)[2] if cover else None)


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, sha256 string")
    d = changes.diff(old, new)
    assert {(r.path, r.op) for r in d.collect()} == {("b", "modified"), ("c", "deleted"), ("d", "added")}
    assert {tuple(r) for r in changes.replace(old, d, new.join(changes.to_process(d), "path", "left_semi"), "path").collect()} == {tuple(r) for r in new.collect()}
    assert changes.upsert(old, new, ["path"]).count() == 4
    e = spark.createDataFrame([("a", "b", "T", 1)] * 2 + [("a", "b", "T", None)] * 2, "source string, target string, edge_type string, ref_line int")
    assert resolve.dedupe_edges(e).count() == 3


def test_knn_join_equals_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8)).astype(np.float32)
    v[7] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(90, [0.0] * 8), (91, None)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    got = {}
    for r in vectors.knn_join(df, df, 5, block=20).orderBy("query_id", F.desc("score"), "id").collect():
        got.setdefault(r.query_id, []).append(r.id)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    for i in range(90):
        assert got[i] == sorted(range(90), key=lambda j: (-s[i, j], j))[:5]
    assert set(got) == set(range(90))


def test_best_of_a_block_equals_a_full_sort():
    s = np.round(np.random.default_rng(3).normal(size=(40, 90)), 1)
    s[3], s[5, :60] = np.nan, 0.2
    s += np.random.default_rng(4).uniform(-4e-7, 4e-7, s.shape)
    for k in (1, 10, 90, 120):
        want = [(i, j, -x) for i, r in enumerate(np.round(s, 6)) for x, j in sorted((-x, j) for j, x in enumerate(r) if np.isfinite(x))[:k]]
        assert list(zip(*(x.tolist() for x in vectors._best(s, k, 6)), strict=True)) == want


def test_fusion(spark):
    cols = "entity_id string, name string, type string, file_path string, score double"
    sem = spark.createDataFrame([("a", "alpha", "Callable", "x/src/a", 0.9), ("b", "beta", "Data", "x/test/b", 0.8)], cols)
    code = spark.createDataFrame([("b", "beta", "Data", "x/test/b", 0.7)], cols)
    names = spark.createDataFrame([("c", "gamma_fn", "Callable", "c", 1.0)], cols)
    got = {r.entity_id: r for r in search.fuse(sem, code, names, "gamma_fn", "Identifier").collect()}
    assert got["a"].score == pytest.approx(30 * 0.5 / 61 + 0.06) and got["c"].score == pytest.approx(30 / 61 + 0.35)
    assert got["b"].score == pytest.approx(30 * (0.5 / 62 + 0.5 / 61) - 0.03) and got["b"].found_via == ["semantic", "code"] and got["b"].code_score == 0.7
    ws = spark.createDataFrame([("w1", "a", 0.5), ("w1", "b", 0.4), ("w2", "a", 0.9)], "workspace string, id string, score double")
    assert [r.id for r in search.merge_workspaces(ws, 2).collect()] == ["w2::a", "w1::a"]


def test_providers(spark):
    p = embed.provider("hashing", dim=32)
    m = p.encode(["parseFile", "parse file", "", None])
    assert np.allclose(m[0], m[1]) and np.allclose(np.linalg.norm(m[:2], axis=1), 1) and not m[2:].any()
    got = spark.createDataFrame([("a b",), (None,)], "t string").select(embed.embed(F.col("t"), p).alias("v")).collect()
    assert len(got[0].v) == 32 and got[1].v is None
    with pytest.raises(ValueError):
        embed.provider("other")
    with pytest.raises(embed.ProviderError):
        embed.provider("http", url="http://127.0.0.1:1/x", model="m", tries=1, timeout=1).encode(["a"])
    assert np.allclose(embed.mean_pool(np.array([[[1.0], [3.0], [9.0]]]), np.array([[1, 1, 0]])), [[2.0]])


def test_vectors_come_a_batch_at_a_time():
    p, texts = embed.provider("hashing", dim=8), [None if i % 7 == 3 else f"word{i} other" for i in range(3 * embed.BATCH + 5)]
    got = list(embed.pieces(iter([pa.array(texts), pa.array([None, None], pa.string())]), p))
    assert max(map(len, got)) == embed.BATCH and sum(map(len, got)) == len(texts) + 2
    rows = [v for x in got for v in x.to_pylist()]
    want = [None if t is None else p.encode([t])[0].tolist() for t in [*texts, None, None]]
    assert rows == want


def test_dependencies_do_not_hang_on_the_order_of_rows(spark):
    """Each time that they are read the rows come in another order."""

    def mixed(batches):
        for b in batches:
            yield b.take(pa.array(random.SystemRandom().sample(range(b.num_rows), b.num_rows)))

    n, m = 60, tables.COMPONENTS
    dep = lambda i: ("@t/n%d" % ((i + 1) % n), None, "workspace", False, False, "workspace:*")
    c = spark.createDataFrame([(f"component:r:n{i}", f"@t/n{i}", f"n{i}/package.json", f"n{i}", "npm", "1", False, [], [dep(i)]) for i in range(n)], m).coalesce(1)
    e = resolve.dependency_edges(c.mapInArrow(mixed, m)).collect()
    assert sorted((r.source, r.target, r.ident) for r in e) == sorted((f"component:r:n{i}", f"component:r:n{(i + 1) % n}", f"@t/n{(i + 1) % n}") for i in range(n))


def test_extraction_hands_on_few_rows_at_a_time():
    text = "".join(f"def f{i}(a, b):\n    return a\n" for i in range(50))
    batch = pa.RecordBatch.from_pydict({"path": [f"f{i}.py" for i in range(300)], "text": [text] * 300, "language": ["python"] * 300, "hash": ["h"] * 300})
    got = list(build._extract(iter([batch])))
    a_file = next(build._extract(iter([batch.slice(0, 1)]))).num_rows
    assert len(got) > 10 and max(b.num_rows for b in got) < build.GIVEN + a_file and sum(b.num_rows for b in got) == 300 * a_file


def test_many_tasks_write_a_tree(spark, tmp_path, monkeypatch):
    def note(root):
        def run(batches):
            if n := sum(b.num_rows for b in batches):
                (tmp_path / f"{n}-{random.SystemRandom().random()}").touch()
            yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["path"])

        return run

    monkeypatch.setattr(tree_queries, "_write", note)
    tree_queries._put(spark.range(200).selectExpr("concat('a', id) path", "'' text").coalesce(1), "")
    counts = [int(p.name.split("-")[0]) for p in tmp_path.iterdir()]
    assert sum(counts) == 200 and max(counts) < 50


def test_rollups(spark):
    n = spark.createDataFrame([("a/b/c.py", "Data"), ("a/b/d.py", "Data"), ("a/x.py", "Callable")], "file string, node_type string")
    got = {(r.path, r.node_type): (r.n_nodes, r.n_files) for r in rollup.module_structure(n, "a", 5).collect()}
    assert got[("b", None)] == (2, 2) and got[("b/c.py", "Data")] == (1, 1) and got[("x.py", None)] == (1, 1)
    t = rollup.tree_stats(n.select(F.col("file").alias("path"))).first()
    assert (t.n_files, t.n_dirs, round(t.avg_depth, 3)) == (3, 2, 2.667)
    e = spark.createDataFrame([(1, 1, 10), (2, 2, 10), (3, 3, 10), (4, 4, 10)], "id int, last_access int, n_bytes int")
    assert [r.id for r in rollup.evictions(e, 15).orderBy("id").collect()] == [1, 2] and rollup.evictions(e, 100).count() == 2
    assert rollup.worst_status(spark.createDataFrame([("pass",), ("warn",)], "status string")).first().overall == "warn"
    assert rollup.hit_rate(spark.createDataFrame([], "hit boolean")).first().rate == 0


def test_streams(spark, tmp_path):
    from lattica.streaming import sync

    rows = [(i, f"2024-01-01 00:{i:02}:00", i % 3, "view", 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, at string, user_id long, event_type string, value double").selectExpr("event_id", "cast(at as timestamp) ts", "user_id", "event_type", "value")
    df.write.parquet(str(tmp_path / "in"))
    s = sync.read_events(spark, str(tmp_path / "in"), df.schema)
    q = sync.windowed(s, "10 minutes").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.total) for r in spark.table("win").collect()) == sorted((r.n, r.total) for r in sync.windowed(df, "10 minutes").collect())
    seen = []
    sync.apply_changes(s, lambda d, n: seen.extend(d.collect()), ["user_id"], ["ts"], str(tmp_path / "ck")).awaitTermination()
    assert {r.user_id: r.event_id for r in seen} == {0: 27, 1: 28, 2: 29}
    assert sync.sessions(df, "2 minutes").count() >= 3


def test_decorators_and_attributes():
    ts = "@Component({\n  selector: 'x',\n})\nexport class Foo extends Bar {\n  @Input() name: string;\n  @HostListener('click')\n  private async onClick(e: Event): Promise<void> { this.go(e); }\n}\n"
    rs = "/// doc\n#[derive(Debug, Clone)]\npub struct P { pub x: i32 }\n#[test]\nfn works() { helper(); }\nimpl P { #[inline] pub fn new() -> P { P { x: 1 } } }\n"
    cs = "namespace N {\n  [Serializable]\n  public class C {\n    [Obsolete(\"x\")]\n    public static\n    void M(int a) { G(); }\n    [Key] public int Id { get; set; }\n  }\n}\n"
    found = {(t.name, d, m.get("visibility"), m.get("static"), m.get("async")) for lang, code in (("typescript", ts), ("rust", rs), ("csharp", cs)) for t in extract.extract(code, lang) if t.definition and t.decorators for m in (extract.metadata(t, lang),) for d in t.decorators}
    assert found >= {("Foo", "Component", None, None, None), ("name", "Input", None, None, None), ("onClick", "HostListener", "private", None, True), ("P", "derive", "public", None, None), ("works", "test", "private", None, None), ("C", "Serializable", "public", None, None), ("M", "Obsolete", "public", True, None), ("Id", "Key", "public", None, None)}


@pytest.mark.parametrize(("language", "code", "n"), [("c", "some plain words here and there\n" * 20_000, 0), ("c", "/*" + "\n" * 50_000 + "*/\nint main(void) {\n return f(1);\n}\n", 1), ("csharp", "\n" * 50_000 + "a" * 100_000, 0), ("c", "int t[] = {\n" + "1, 2, 3,\n" * 20_000 + "};\n", 0), ("python", "".join(f"def f{i}(a):\n" + "    g(a)\n" * 20 for i in range(1500)), 1500)])
def test_large_files_take_time_in_proportion(language, code, n):
    begin = time.monotonic()
    nodes, _, refs = extract.build_file("x", code, language)
    assert time.monotonic() - begin < 20 and sum(x["node_type"] == "Callable" for x in nodes) == n


def test_enclosing_span_of_references():
    """The narrowest declaration around each call, also where blocks end and begin on one line."""
    code = "def a():\n    x()\n    def b():\n        y()\n    z()\n\nclass C:\n    def d(self): w()\n    v()\n\nu()\n"
    refs = extract.build_file("f.py", code, "python")[2]
    assert {(n, s) for n, s, _ in refs} == {("x", "f.py:a"), ("y", "f.py:a:b"), ("z", "f.py:a"), ("w", "f.py:C:d"), ("v", "f.py:C"), ("u", "f.py")}


@pytest.mark.parametrize("strip", [4, 16, 4096])
def test_enclosing_in_strips(spark, strip):
    r = random.Random(8)
    spans = [(i, r.choice("fg"), a, a + r.choice([0, 1, 3, 9, 40, 200])) for i in range(120) for a in (r.randrange(150),)] + [(200, None, 1, 9), (201, "f", 9, 1)]
    points = [(i, r.choice("fgh"), r.randrange(-5, 260)) for i in range(200)] + [(900, None, 3), (901, "f", None)]
    got = {x.point_id: x.span_id for x in resolve.enclosing(spark.createDataFrame(points, "point_id long, file string, line int"), spark.createDataFrame(spans, "span_id long, file string, start_line int, end_line int"), strip).collect()}
    for i, f, line in points:
        cover = [(b - a, -a, s) for s, g, a, b in spans if line is not None and f is not None and g == f and a <= line <= b]
        assert got[i] == (min(cover)[2] if cover else None)


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 3)], "i int, k string, t int")
    right = spark.createDataFrame([("a", 3, 30), ("a", 5, 50), ("a", 5, 51), ("a", 6, 60), ("b", 9, None), (None, 1, 7)], "k string, t int, v int")
    assert {x.i: x.v for x in resolve.as_of(left, right, ["k"], "t", "v").collect()} == {1: 51, 2: None, 3: None, 4: 7}


def test_keywords_equal_patterns():
    import re

    r = random.Random(4)
    words = [w for ws in text.KEYWORDS.values() for w in ws.split()] + ["xx", "ing", "co", "un"]
    for _ in range(200):
        t = "".join(r.choice(words) + r.choice(["", " ", "_"]) for _ in range(r.randrange(6)))
        assert text.keywords_of(t) == sorted(k for k, ws in text.KEYWORDS.items() if re.search("|".join(ws.split()), t))

"""A small tree on disk, end to end."""

import json

import pytest
from pyspark.sql import functions as F

from lattica.operators import changes, constraints
from lattica.plans.engine import Engine, NotFound, Workspaces
from lattica.plans import build
from lattica.sources import tree
from lattica.sources.store import Store

FILES = {
    "app/main.py": "import util\n\nLIMIT = 3\n\n\nclass Runner(Base):\n    def __init__(self, size):\n        self.size = size\n\n    def run(self):\n        return helper(LIMIT)\n\n\ndef start():\n    Runner(1).run()\n",
    "app/util.py": "class Base:\n    pass\n\n\ndef helper(x):\n    return x\n",
    "web/view.ts": "export interface Shape { area(): number; }\nexport class Square implements Shape {\n  side: number = 1;\n  area(): number { return this.side; }\n}\n",
    "web/package.json": json.dumps({"version": "0.3.1", "private": True, "name": "@acme/web", "dependencies": {"@acme/lib": "workspace:*", "left": "^1"}}),
    "lib/package.json": json.dumps({"name": "@acme/lib"}),
    "package.json": json.dumps({"name": "top", "workspaces": ["web", "lib"]}),
    "skipped.log.py": "def no(): pass\n",
    "node_modules/x.js": "function no() {}\n",
    ".gitignore": "*.log.py\n",
    "notes.txt": "text",
}


@pytest.fixture
def root(tmp_path):
    for p, t in FILES.items():
        f = tmp_path / "repo" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    return tmp_path / "repo"


def _rows(df):
    return sorted(map(repr, (r.asDict(recursive=True) for r in df.collect())))


def test_scan_skips_what_it_should(spark, root):
    found = {r.path for r in tree.scan(spark, str(root)).collect()}
    assert found == {"app/main.py", "app/util.py", "web/view.ts", "web/package.json", "lib/package.json", "package.json", "notes.txt"}


def test_scan_finds_every_name(spark, tmp_path, monkeypatch):
    """Names that Spark's own listing hides, ignore files at several levels, links, thousands of rules, and a tree wide enough to be dealt out."""
    want = {"pkg/__init__.py", "pkg/_private.py", "pkg/mod.py", "pkg/__tests__/a.js", "_internal/m.py", "a b/ü.py", "low/kept.tmp", "low/in/x.py", "_x/y=1/z.py"}
    gone = {"pkg/gen.tmp", "low/drop/x.py", "low/in/never.py", "build/x.py", ".hidden/x.py", "out/deep/x.py", "gone/f4999", "x.pyc"}
    top = tmp_path / "t"
    for p in want | gone:
        (top / p).parent.mkdir(parents=True, exist_ok=True)
        (top / p).write_text(p)
    (top / ".gitignore").write_text("*.tmp\nout/\n" + "".join(f"/gone/f{i}\n*.g{i}\n" for i in range(5000)))
    (top / "low/.gitignore").write_text("!kept.tmp\n/drop\n")
    (top / "low/in/.latticaignore").write_text("never.py\n")
    (top / "link.py").symlink_to(top / "pkg/mod.py")
    (top / "linked").symlink_to(top / "pkg")
    for wide in (64, 2):
        monkeypatch.setattr(tree, "WIDE", wide)
        got = {r.path: bytes(r.content).decode() for r in tree.scan(spark, str(top)).collect()}
        assert got == {p: p for p in want}
    assert {r.path for r in tree.scan(spark, f"file://{top}").select("path").collect()} == want
    assert {r.path for r in tree.scan(spark, str(top), exclude=("*.js", "low/*"), hidden=False).select("path").collect()} - {".gitignore"} == (want | {".hidden/x.py"}) - {"pkg/__tests__/a.js", "low/kept.tmp", "low/in/x.py"}
    assert {r.path for r in tree.scan(spark, str(top), rules="_*\n").select("path").collect()} == {"pkg/mod.py", "a b/ü.py", "low/kept.tmp", "low/in/x.py"}
    # the user's own rules, and those of a repository above the tree
    (tmp_path / "config/git").mkdir(parents=True)
    (tmp_path / "config/git/ignore").write_text("mod.py\n")
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    (tmp_path / ".git").mkdir()
    (tmp_path / ".gitignore").write_text("/t/_internal\n")
    assert {r.path for r in tree.scan(spark, str(top)).select("path").collect()} == want - {"pkg/mod.py", "_internal/m.py"}
    assert tree.scan(spark, str(tmp_path / "config")).count() == 1 and tree.scan(spark, str(tmp_path / "nowhere")).count() == 0


def test_build_query_update(spark, root, tmp_path):
    e = Engine(spark, str(root), str(tmp_path / "store"))
    assert e.rebuild()["nodes"] > 15
    ids = {r.id: r for r in e.nodes.collect()}
    assert ids["app/main.py:Runner:__init__"].kind == "constructor" and ids["app/main.py:Runner:run"].kind == "method"
    assert ids["web/view.ts:Square:area"].kind == "method" and ids["component:repo:web"].kind == "component"
    edges = {(r.source, r.target, r.edge_type) for r in e.edges.collect()}
    assert ("app/main.py:Runner:run", "app/util.py:helper", "USES") in edges
    assert ("app/main.py:Runner", "app/util.py:Base", "USES") in edges
    assert ("repo", "app/main.py", "CONTAINS") in edges
    assert ("component:repo:web", "component:repo:lib", "DEPENDS_ON") in edges
    assert ("component:repo", "component:repo:web", "CONTAINS") in edges
    for rule in (constraints.structural(e.nodes, e.edges), constraints.semantic(e.nodes), constraints.dangling(e.nodes, e.edges), constraints.containment(e.nodes, e.edges), constraints.orphans(e.nodes, e.edges)):
        assert rule.collect() == []
    assert e.index()["indexed"] > 10
    assert e.search("helper", 3).first().entity_id == "app/util.py:helper"
    assert e.search("helper", 3, mode="code", types=["Callable:function"]).where("type <> 'Callable'").isEmpty()
    assert e.node("app/util.py:helper")["line"] == 5
    with pytest.raises(NotFound):
        e.node("nowhere")
    assert e.read_code("app/main.py:Runner:run", span=True).startswith("    def run")
    assert [r.path for r in e.call_chain("app/util.py:helper").collect()] == [["app/util.py:helper", "app/main.py:Runner:run", "app/main.py:start"]]
    assert {r.node_id for r in e.find_references("app/util.py:helper", ["USES"]).collect()} == {"app/main.py:Runner:run"}
    assert {r.id for r in e.affected(["lib/x.js"]).collect()} >= {"component:repo:lib", "component:repo:web"}
    assert '"@acme/web" -> "@acme/lib"' in e.component_graph()
    # an update gives what a rebuild gives
    (root / "app/util.py").write_text("class Base:\n    pass\n\n\ndef other(x):\n    return x\n\n\ndef helper(y):\n    return other(y)\n")
    (root / "web/view.ts").unlink()
    (root / "app/new.go").write_text("package app\n\nfunc Go() { helper(1) }\n")
    assert {(r.path, r.op) for r in e.changes().collect()} == {("app/util.py", "modified"), ("web/view.ts", "deleted"), ("app/new.go", "added")}
    assert e.update()["n_total"] == 3 and e.update()["n_total"] == 0
    fresh = Engine(spark, str(root), str(tmp_path / "other"))
    fresh.rebuild()
    fresh.index()
    assert _rows(e.nodes) == _rows(fresh.nodes) and _rows(e.edges) == _rows(fresh.edges)
    assert {r.entity_id for r in e.store.read("points_code").collect()} == {r.entity_id for r in fresh.store.read("points_code").collect()}
    assert not e.needs_reindex() and all(s != "fail" for _, s, _ in e.doctor())


def test_update_writes_little(spark, tmp_path):
    """One changed file of many: what is written, what readers see meanwhile, and what a rebuild gives."""
    top = tmp_path / "many"
    for i in range(400):
        f = top / f"d{i % 20}/m{i}.py"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(f"class C{i}:\n" + "".join(f"    def f{i}_{j}(self, a):\n        return f{(i + 1) % 400}_{j}(a)\n\n" for j in range(12)))
    e = Engine(spark, str(top), str(tmp_path / "store"))
    e.rebuild()
    whole = {n: s[0]["rows"] for n, s in e.store._pointer()["tables"].items()}
    nodes_before = e.nodes
    n = nodes_before.count()
    (top / "d3/m3.py").write_text("class C3:\n    def f3_0(self, a):\n        return f9_1(a)\n\n    def new(self):\n        return f3_0(1)\n")
    assert e.update()["n_modified"] == 1
    assert nodes_before.count() == n  # a reader of the version before
    after = e.store._pointer()["tables"]
    size = lambda p: sum(f.stat().st_size for f in (tmp_path / "store" / p).rglob("*.parquet"))
    assert all(s[0]["rows"] == whole[t] and len(s) == 2 for t, s in after.items())
    assert sum(size(s[1]["rows"]) + size(s[1]["gone"]) for s in after.values()) < 0.05 * sum(map(size, whole.values()))
    fresh = Engine(spark, str(top), str(tmp_path / "other"))
    fresh.rebuild()
    assert _rows(e.nodes) == _rows(fresh.nodes) and _rows(e.edges) == _rows(fresh.edges)


def test_store_changes(spark, tmp_path):
    """Partitions rewritten, rows appended and deleted, several tables at once, many small changes, old versions."""
    s = Store(spark, str(tmp_path / "s"))
    edge = lambda *rows: spark.createDataFrame([(a, b, "USES", p, q) for a, b, p, q in rows], "source string, target string, edge_type string, src_partition string, dst_partition string")
    show = lambda: sorted((r.source, r.target) for r in s.read("edges").collect())
    s.write("edges", edge(("a", "b", "p", "p"), ("a", "c", "p", "q"), ("d", "a", "q", "p")))
    s.append("edges", edge(("e", "a", "r", "p")))
    assert show() == [("a", "b"), ("a", "c"), ("d", "a"), ("e", "a")]
    assert s.delete("edges", "source", ["a", "nobody"]) == 2 and show() == [("d", "a"), ("e", "a")] and s.delete("edges", "source", ["a"]) == 0
    s.append("edges", edge(("a", "z", "p", "p")))  # back again after it was deleted
    s.rewrite("edges", "dst_partition", ["p"], edge(("f", "g", "q", "p")))
    assert show() == [("f", "g")]
    for i in range(10):
        s.append("edges", edge((f"n{i}", "x", "p", "p")))
    assert len(show()) == 11 and len(s._pointer()["tables"]["edges"]) < 10 and len(s._numbers()) <= 3
    assert s.meta("k", "v") == "v" and s.drop("edges") and not s.exists("edges") and not s.drop("edges")
    old = tmp_path / "old"
    old.mkdir()
    edge(("a", "b", "p", "p")).write.parquet(str(old / "edges-1"))
    (old / "_versions.json").write_text(json.dumps({"schema_version": "1.1", "tables": {"edges": "edges-1"}, "meta": {"k": "w"}}))
    assert Store(spark, str(old)).read("edges").count() == 1 and Store(spark, str(old)).meta("k") == "w"


def test_workspaces(spark, root, tmp_path):
    w = Workspaces(spark, str(tmp_path / "registry.json"))
    w.register("one", str(root))
    w.set_active("one")
    e = w.engine("one")
    e.rebuild()
    e.index()
    hit = w.search("helper", 2).first()
    assert hit.id == "one::app/util.py:helper" and hit.workspace == "one"
    assert w.node("one::app/util.py:helper")["name"] == "helper"
    again = Workspaces(spark, str(tmp_path / "registry.json"))
    assert again.active == "one" and again.list()[0]["has_index"]
    assert again.index_status()["workspaces"] == 1 and again.index_status()["needs_reindex"] == [] and again.index_status()["points_code"] > 5
    assert w.unregister("one") and w.active is None and not w.unregister("one")
    with pytest.raises(NotFound):
        w.register("two", str(tmp_path / "missing"))


def test_version_follows_content(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    b = spark.createDataFrame([("b", "2"), ("a", "1")], "path string, sha256 string")
    v = lambda d: changes.version(d).first()[0]
    assert v(a) == v(b) != v(a.withColumn("sha256", F.lit("3")))


def test_workspace_of_two_roots(spark, tmp_path):
    for r in ("x", "y"):
        (tmp_path / r / ".git").mkdir(parents=True)
        (tmp_path / r / "same.py").write_text("def f():\n    pass\n")
    assert [r["path"] for r in tree.discover_roots(str(tmp_path))] == ["x", "y"]
    nodes, edges = build.build_workspace(spark, str(tmp_path))
    ids = {r.id for r in nodes.collect()}
    assert {"x/same.py:f", "y/same.py:f", "x", "y"} <= ids
    assert edges.where("source like 'workspace:%'").count() == 2


def test_sync_once(spark, root, tmp_path):
    from lattica.streaming import sync

    e, seen = Engine(spark, str(root), str(tmp_path / "store")), []
    sync.auto_sync(e, once=True, then=seen.append).awaitTermination(120)
    assert seen and seen[0]["full"] and e.store.exists("nodes")
    own = sync.Sync(e)
    assert own.run()["n_total"] == 0 and own.status()["state"] == sync.IDLE and own.status()["runs"] == 1
    with own._lock, pytest.raises(sync.Busy):
        own.run()
    own.engine = None
    with pytest.raises(AttributeError):
        own.run()
    assert own.state == sync.FAILED


def test_git_and_discovery(spark, tmp_path):
    """Branch and commit of a repository, also of a detached head; workspaces below a folder."""
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "a"), "-c", "user.name=x", "-c", "user.email=x@y.z", *a], check=True, capture_output=True, text=True).stdout.strip()
    (tmp_path / "a/in").mkdir(parents=True)
    (tmp_path / "a/x.py").write_text("x = 1\n")
    assert tree.git_metadata(str(tmp_path / "a")) == {"remote": None, "commit": None, "branch": None}
    git("init", "-q", "-b", "trunk")
    git("add", "x.py")
    git("commit", "-q", "-m", "one")
    git("remote", "add", "origin", "https://example.org/a.git")
    assert tree.git_metadata(str(tmp_path / "a")) == {"remote": "https://example.org/a.git", "commit": git("rev-parse", "HEAD"), "branch": "trunk"}
    git("checkout", "-q", "--detach")
    assert tree.git_metadata(str(tmp_path / "a"))["branch"] == "HEAD"
    (tmp_path / "b/.lattica").mkdir(parents=True)
    found = Workspaces.discover(str(tmp_path))
    assert found == [str(tmp_path / "a"), str(tmp_path / "b")]
    w = Workspaces(spark, str(tmp_path / "r.json"))
    assert w.register_discovered(found, "all") == 2 and [x["name"] for x in w.list()] == ["all/a", "all/b"]


def test_rules_of_a_user(spark, tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/a.toml").write_text("[[rule]]\nlanguage = 'python'\npattern = '^register\\(\"(?P<n>\\w+)\"'\ntype = 'Callable'\nkind = 'function'\n")
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.py").write_text('register("job", 1)\n\ndef f():\n    job()\n')
    e = Engine(spark, str(tmp_path / "t"), str(tmp_path / "s"), rules=str(tmp_path / "rules"))
    e.rebuild()
    assert e.node("x.py:job")["kind"] == "function" and ("x.py:f", "x.py:job") in {(r.source, r.target) for r in e.edges.where("edge_type = 'USES'").collect()}


def test_command_line(root, tmp_path, capsys, spark):
    from lattica.__main__ import config_value, load_config, main, set_config

    set_config(str(root), "search.mode", "code")
    set_config(str(root), "search.limit", "7")
    set_config(str(root), "analysis.exclude", '["a b"]')
    assert load_config(str(root), None, str(tmp_path))["search"] == {"limit": 7, "mode": "code", "min_score": 0.0} and load_config(str(root), None, str(tmp_path))["analysis"]["exclude"] == ["a b"]
    with pytest.raises(NotFound):
        set_config(str(root), "search.limit.x", "1")

    (root / ".lattica").mkdir(exist_ok=True)
    (root / ".lattica/config.toml").write_text('[search]\nlimit = 3\n[embedding]\nprovider = "hashing"\ndim = 64\n')
    assert load_config(str(root), {"search": {"mode": "code"}}, str(tmp_path))["search"] == {"limit": 3, "mode": "code", "min_score": 0.0}
    with pytest.raises(NotFound):
        config_value({"a": 1}, "a.b")
    w = ["-w", str(root), "--registry", str(tmp_path / "r.json")]
    for args in (["init"], ["search", "helper"], ["graph", "find", "hel*"], ["graph", "code", "app/util.py:helper"], ["components", "graph", "--format", "ascii"], ["doctor"], ["workspace", "register", "x", str(root)], ["workspace", "list"]):
        assert main(w + args) == 0, args
    out = capsys.readouterr().out
    assert "app/util.py:helper" in out and "@acme/web" in out and '"has_index": true' in out

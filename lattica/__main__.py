"""Command line: python -m lattica COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tomllib
from pathlib import Path

from .functions import embed
from .plans.engine import Engine, NotFound, Workspaces
from .session import session

DEFAULTS = {"storage": {"path": None}, "search": {"limit": 10, "mode": None, "min_score": 0.0}, "embedding": {"provider": "hashing"}, "analysis": {"exclude": [], "rules": None}, "sync": {"every": "30 seconds"}}


def merged(a: dict, b: dict) -> dict:
    return a | {k: merged(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}


def load_config(workspace: str, overrides: dict | None = None, home: str | None = None) -> dict:
    """Defaults, then the user's file, then the workspace's, then overrides."""
    out = DEFAULTS
    for p in (Path(home or Path.home(), ".config/lattica/config.toml"), Path(workspace, ".lattica/config.toml")):
        if p.is_file():
            out = merged(out, tomllib.loads(p.read_text()))
    return merged(out, overrides or {})


def config_value(config: dict, key: str):
    for part in key.split("."):
        if not isinstance(config, dict) or part not in config:
            raise NotFound(key)
        config = config[part]
    return config


def set_config(workspace: str, key: str, value: str) -> None:
    """Set a dotted key in the workspace's file, which is written anew. The value is read as TOML, else taken as text."""
    path = Path(workspace, ".lattica/config.toml")
    config = tomllib.loads(path.read_text()) if path.is_file() else {}
    *parts, last = key.split(".")
    at = config
    for part in parts:
        at = at.setdefault(part, {})
        if not isinstance(at, dict):
            raise NotFound(key)
    try:
        at[last] = tomllib.loads(f"x = {value}")["x"]
    except tomllib.TOMLDecodeError:
        at[last] = value
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(_toml(config))


def _toml(table: dict, at: str = "") -> str:
    plain = "".join(f"{json.dumps(k)} = {json.dumps(v, ensure_ascii=False)}\n" for k, v in table.items() if not isinstance(v, dict))
    inner = "".join(_toml(v, f"{at}.{json.dumps(k)}" if at else json.dumps(k)) for k, v in table.items() if isinstance(v, dict))
    return (f"[{at}]\n" if at and plain else "") + plain + inner


def _show(df, limit: int | None = None) -> None:
    for row in (df.limit(limit) if limit else df).toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lattica")
    p.add_argument("-w", "--workspace", default=".")
    p.add_argument("--registry", default=os.path.expanduser("~/.config/lattica/workspaces.json"))
    c = p.add_subparsers(dest="command", required=True)
    for name in ("init", "update", "status", "doctor", "index"):
        c.add_parser(name)
    c.choices["update"].add_argument("--full", action="store_true")
    s = c.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int)
    s.add_argument("--mode", choices=["code", "info", "hybrid"])
    s.add_argument("--type", action="append")
    s.add_argument("--min-score", type=float)
    s.add_argument("--files", action="store_true")
    g = c.add_parser("graph").add_subparsers(dest="what", required=True)
    g.add_parser("stats")
    for name in ("node", "edges", "connected", "code", "references", "chain"):
        q = g.add_parser(name)
        q.add_argument("id")
        if name in ("edges", "connected"):
            q.add_argument("--type")
            q.add_argument("--direction", default="both", choices=["incoming", "outgoing", "both"])
        if name == "code":
            q.add_argument("--context", type=int, default=0)
            q.add_argument("--span", action="store_true")
        if name == "chain":
            q.add_argument("--direction", default="upstream")
    f = g.add_parser("find")
    f.add_argument("pattern")
    f.add_argument("--type")
    f.add_argument("--limit", type=int, default=20)
    m = g.add_parser("modules")
    m.add_argument("base")
    m.add_argument("--depth", type=int, default=2)
    k = c.add_parser("components").add_subparsers(dest="what", required=True)
    k.add_parser("list").add_argument("--roots", action="store_true")
    d = k.add_parser("deps")
    d.add_argument("id")
    d.add_argument("--transitive", action="store_true")
    d.add_argument("--reverse", action="store_true")
    k.add_parser("affected").add_argument("files", nargs="+")
    h = k.add_parser("graph")
    h.add_argument("--format", default="dot", choices=["dot", "mermaid", "ascii"])
    h.add_argument("--include", action="append")
    h.add_argument("--exclude", action="append")
    w = c.add_parser("workspace").add_subparsers(dest="what", required=True)
    r = w.add_parser("register")
    r.add_argument("name")
    r.add_argument("path")
    w.add_parser("unregister").add_argument("name")
    w.add_parser("activate").add_argument("name")
    w.add_parser("list")
    w.add_parser("discover").add_argument("root")
    x = c.add_parser("clean")
    x.add_argument("--dry-run", action="store_true")
    v = c.add_parser("config")
    v.add_argument("key", nargs="?")
    v.add_argument("value", nargs="?")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    config = load_config(a.workspace)
    if a.command == "config" and a.value is not None:
        set_config(a.workspace, a.key, a.value)
        return 0
    if a.command == "config":
        print(json.dumps(config_value(config, a.key) if a.key else config, indent=1))
        return 0
    spark = session()
    spaces = Workspaces(spark, a.registry)
    if a.command == "workspace":
        if a.what == "register":
            print(spaces.register(a.name, a.path))
        elif a.what == "unregister":
            return int(not spaces.unregister(a.name))
        elif a.what == "activate":
            spaces.set_active(a.name)
        else:
            for x in spaces.list() if a.what == "list" else spaces.discover(a.root):
                print(json.dumps(x))
        return 0
    options = dict(config["embedding"])
    e = Engine(spark, os.path.abspath(a.workspace), config["storage"]["path"], provider=embed.provider(options.pop("provider"), **options), exclude=tuple(config["analysis"]["exclude"]), rules=config["analysis"]["rules"])
    if a.command == "init":
        print(json.dumps(e.rebuild() | e.index()))
    elif a.command == "update":
        print(json.dumps(e.update(a.full)))
    elif a.command == "index":
        print(json.dumps(e.index()))
    elif a.command == "status":
        _show(e.graph_stats())
        print(json.dumps(e.index_status()))
    elif a.command == "doctor":
        found = e.doctor()
        for row in found:
            print("\t".join(row))
        return int(any(s == "fail" for _, s, _ in found))
    elif a.command == "clean":
        print(e.store.clean(a.dry_run))
    elif a.command == "search":
        s = config["search"]
        hits = e.search(a.query, a.limit or s["limit"], a.mode or s["mode"], a.type, s["min_score"] if a.min_score is None else a.min_score)
        _show(hits.select("file_path").dropDuplicates() if a.files else hits)
    elif a.command == "graph":
        if a.what == "stats":
            _show(e.graph_stats())
        elif a.what == "node":
            print(json.dumps(e.node(a.id), default=str))
        elif a.what == "code":
            print(e.read_code(a.id, a.context, a.span))
        elif a.what == "find":
            _show(e.find_nodes(a.pattern, a.type, a.limit))
        elif a.what == "modules":
            _show(e.module_structure(a.base, a.depth))
        elif a.what == "references":
            _show(e.find_references(a.id))
        elif a.what == "chain":
            _show(e.call_chain(a.id, a.direction))
        else:
            _show((e.edges_of if a.what == "edges" else e.connected)(a.id, a.type, a.direction))
    elif a.command == "components":
        if a.what == "list":
            _show(e.components(a.roots))
        elif a.what == "deps":
            _show(e.dependencies(a.id, a.transitive, a.reverse))
        elif a.what == "affected":
            _show(e.affected(a.files))
        else:
            print(e.component_graph(a.format, a.include, a.exclude))
    return 0


if __name__ == "__main__":
    sys.exit(main())

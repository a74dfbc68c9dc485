"""Component manifests: package.json, vcpkg.json, Cargo.toml, pyproject.toml, go.mod, CMakeLists.txt and .NET projects."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET


def parse(name: str, text: str) -> dict | None:
    """name, version, is_workspace_root, workspace_members, local_dependencies and ecosystem of a manifest; null if it can't be read or says nothing."""
    out: dict = {"name": None, "version": None, "is_workspace_root": False, "workspace_members": [], "local_dependencies": []}
    try:
        if name in ("package.json", "vcpkg.json"):
            _json(json.loads(text), out)
            out["ecosystem"] = "npm" if name == "package.json" else "vcpkg"
        elif name == "Cargo.toml":
            _cargo(tomllib.loads(text), out)
            out["ecosystem"] = "cargo"
        elif name == "pyproject.toml":
            _python(tomllib.loads(text), out)
            out["ecosystem"] = "python"
        elif name == "go.mod":
            _gomod(text, out)
            out["ecosystem"] = "go"
        elif name == "CMakeLists.txt":
            _cmake(text, out)
            out["ecosystem"] = "cmake"
        elif name.endswith(("csproj", "vbproj", "fsproj")):
            _dotnet(ET.fromstring(text), name, out)
            out["ecosystem"] = "dotnet"
        else:
            return None
    except (ValueError, ET.ParseError, AttributeError, TypeError, RecursionError):
        return None
    return out if out["name"] or out["version"] or out["is_workspace_root"] or out["local_dependencies"] else None


def _dep(out: dict, name: str, path: str | None, kind: str, dev: bool = False, build: bool = False, spec: str | None = None) -> None:
    out["local_dependencies"].append({"name": name, "path": path, "dep_type": kind, "is_dev": dev, "is_build": build, "version_spec": spec})


def _json(x: dict, out: dict) -> None:
    out["name"], out["version"] = x.get("name"), x.get("version") or x.get("version-string")
    w = x.get("workspaces")
    members = w.get("packages", []) if isinstance(w, dict) else w
    if members:
        out["is_workspace_root"], out["workspace_members"] = True, [str(m) for m in members]
    for key, dev in (("dependencies", False), ("devDependencies", True), ("peerDependencies", False), ("optionalDependencies", False)):
        if isinstance(x.get(key), dict):
            for name, spec in x[key].items():
                if str(spec).startswith("workspace:"):
                    _dep(out, name, None, "workspace", dev, spec=spec)
                elif str(spec).startswith(("file:", "link:")):
                    _dep(out, name, spec.split(":", 1)[1], "path", dev)


def _cargo(x: dict, out: dict) -> None:
    p = x.get("package", {})
    out["name"] = p.get("name")
    out["version"] = p["version"] if isinstance(p.get("version"), str) else None
    if "workspace" in x:
        out["is_workspace_root"], out["workspace_members"] = True, list(x["workspace"].get("members", []))
    for table in [x, *x.get("target", {}).values()]:
        for key in ("dependencies", "dev-dependencies", "build-dependencies"):
            for name, spec in table.get(key, {}).items():
                if isinstance(spec, dict) and "path" in spec:
                    _dep(out, spec.get("package", name), spec["path"], "path", key == "dev-dependencies", key == "build-dependencies")
                elif isinstance(spec, dict) and spec.get("workspace"):
                    own = x.get("workspace", {}).get("dependencies", {}).get(name)
                    _dep(out, name, own.get("path") if isinstance(own, dict) else None, "workspace", key == "dev-dependencies", key == "build-dependencies")


def _python(x: dict, out: dict) -> None:
    project, tool = x.get("project", {}), x.get("tool", {})
    poetry, uv = tool.get("poetry", {}), tool.get("uv", {})
    out["name"], out["version"] = project.get("name") or poetry.get("name"), project.get("version") or poetry.get("version")
    if "workspace" in uv:
        out["is_workspace_root"], out["workspace_members"] = True, list(uv["workspace"].get("members", []))
    for name, spec in uv.get("sources", {}).items():
        if isinstance(spec, dict) and spec.get("workspace"):
            _dep(out, name, None, "workspace")
        elif isinstance(spec, dict) and "path" in spec:
            _dep(out, name, spec["path"], "path")
    tables = [(poetry.get("dependencies", {}), False), (poetry.get("dev-dependencies", {}), True), *((g.get("dependencies", {}), True) for g in poetry.get("group", {}).values())]
    for table, dev in tables:
        for name, spec in table.items():
            if isinstance(spec, dict) and "path" in spec:
                _dep(out, name, spec["path"], "path", dev)


def _last(path: str) -> str:
    return next((p for p in reversed(re.split(r"[/\\]", path)) if p), path)


def _gomod(text: str, out: dict) -> None:
    if m := re.search(r"^\s*module\s+(\S+)", text, re.M):
        out["name"] = m[1]
    for m in re.finditer(r"(\S+)(?:\s+v\S+)?\s*=>\s*(\.{1,2}/\S*|/\S+)", re.sub(r"//[^\n]*", "", text)):
        _dep(out, m[1], m[2], "replace")


def _cmake(text: str, out: dict) -> None:
    text = re.sub(r"#[^\n]*", "", text)
    if m := re.search(r"\bproject\s*\(\s*\"?([\w.-]+)\"?([^)]*)\)", text, re.I):
        out["name"] = m[1]
        if v := re.search(r"\bVERSION\s+([\d.]+)", m[2]):
            out["version"] = v[1]
    for m in re.finditer(r"\badd_subdirectory\s*\(\s*\"?([^\s\")]+)", text, re.I):
        _dep(out, _last(m[1]), m[1], "subdirectory")


def _dotnet(root: ET.Element, name: str, out: dict) -> None:
    tag = lambda e: e.tag.rpartition("}")[2]
    for e in root.iter():
        if tag(e) in ("AssemblyName", "PackageId") and not out["name"] and e.text:
            out["name"] = e.text.strip()
        elif tag(e) == "Version" and not out["version"] and e.text:
            out["version"] = e.text.strip()
        elif tag(e) == "ProjectReference" and e.get("Include"):
            path = e.get("Include").replace("\\", "/")
            _dep(out, re.sub(r"\.(?:cs|vb|fs)proj$", "", _last(path)), path, "project_reference")
    out["name"] = out["name"] or re.sub(r"\.(?:cs|vb|fs)proj$", "", name)

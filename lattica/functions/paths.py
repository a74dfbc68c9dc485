"""Column functions over paths, node ids and tag strings."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension, lower case, of each source language.
LANGUAGES = {"py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "rs": "rust", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "cs": "csharp"}
MANIFESTS = {"package.json": "json", "vcpkg.json": "json", "Cargo.toml": "toml", "pyproject.toml": "toml", "go.mod": "gomod", "CMakeLists.txt": "cmake"}
PROJECT_SUFFIXES = ("csproj", "vbproj", "fsproj")
#: Sorted; hidden names are excluded whether listed or not.
SKIPPED_DIRS = ("__pycache__", "build", "dist", "node_modules", "target", "venv")
SKIPPED_SUFFIXES = ("class", "db", "dll", "dylib", "egg", "exe", "o", "obj", "pyc", "pyd", "pyo", "so", "sqlite", "sqlite3")
KINDS = {
    "Container": ("component", "file", "module", "namespace", "package", "repository", "type", "workspace"),
    "Callable": ("constructor", "function", "macro", "method"),
    "Data": ("constant", "field", "local", "parameter", "property", "value"),
}
DEFAULT_KIND = {"Container": "type", "Callable": "function", "Data": "value"}
#: Container kinds that a tag may name.
TAG_KINDS = KINDS | {"Container": ("module", "namespace", "package", "type")}
EDGE_TYPES = ("CONTAINS", "DEFINES", "DEPENDS_ON", "USES")


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null if there is none, or the name only begins with one."""
    found = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    return F.when(found != "", found)


def language_of_path(path: Column) -> Column:
    """Source language by extension; null for other files."""
    return _lookup(F.coalesce(F.lower(extension(path)), F.lit("")), LANGUAGES)


def manifest_language(path: Column) -> Column:
    """Format of a component manifest by file name; null for other files."""
    name = file_name(path)
    return F.coalesce(_lookup(name, MANIFESTS), F.when(F.coalesce(extension(path), F.lit("")).isin(*PROJECT_SUFFIXES), F.lit("xml")))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell glob; `*` and `?` also match `/`."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            i = end
        else:
            out += c if c.isalnum() or c in "_/" or ord(c) > 127 else f"\\{c}"
        i += 1
    return f"^{out}$"


def _exclusions(patterns: tuple[str, ...], hidden: bool) -> tuple[list[str], list[str]]:
    """Regular expressions found in an excluded path, and in the path or the name."""
    named = r"(?:^|/)\.(?!\.?(?:/|$))" if hidden else r"(?:^|/)\.(?:git|DS_Store|venv|env|idea|vscode)(?:/|$)"
    return [rf"(?:^|/)(?:{'|'.join(SKIPPED_DIRS)})(?:/|$)", rf"\.(?:{'|'.join(SKIPPED_SUFFIXES)})$", named], [glob_regex(p) for p in patterns]


def is_excluded(path: Column, patterns: tuple[str, ...] = (), hidden: bool = True) -> Column:
    """Hidden and tool-made parts of a tree, compiled files, and any of the globs on name or path."""
    fixed, globs = _exclusions(patterns, hidden)
    # one pattern: a nested condition for each of thousands of globs would not be planned
    out = path.rlike("|".join(fixed))
    if globs:
        either = "|".join(f"(?:{g})" for g in globs)
        out = out | path.rlike(either) | file_name(path).rlike(either)
    return out


def skipper(patterns: tuple[str, ...] = (), hidden: bool = True) -> Callable[[str, bool], bool]:
    """is_excluded for one path, file or directory, in Python; globs are for files only."""
    fixed, globs = _exclusions(patterns, hidden)
    whole, either = re.compile("|".join(fixed)), re.compile("|".join(f"(?:{g})" for g in globs)) if globs else None

    def skip(path: str, is_dir: bool) -> bool:
        if whole.search(f"{path}/x" if is_dir else path):
            return True
        return bool(either and not is_dir and (either.search(path) or either.search(path.rpartition("/")[2])))

    return skip


def skips_dir(name: Column, hidden: bool = True) -> Column:
    """A directory that is not entered."""
    return is_excluded(F.concat(name, F.lit("/x")), (), hidden)


def short_path(path: Column) -> Column:
    """The last three parts."""
    return F.substring_index(path, "/", -3)


def directory(path: Column) -> Column:
    """Parent directory, empty at the top."""
    return F.regexp_extract(path, "^(.*)/", 1)


def partition_id(root: Column, path: Column) -> Column:
    """`{root}_{directory}`, with `root` for files at the top."""
    return F.concat(root, F.lit("_"), F.coalesce(F.nullif(directory(path), F.lit("")), F.lit("root")))


def safe_name(partition: Column) -> Column:
    """A partition id as a file name: slashes, backslashes and colons become underscores."""
    return F.regexp_replace(partition, r"[/\\:]", "_")


def file_of_node(node_id: Column) -> Column:
    """The file part of a node id: all up to the first colon."""
    return F.substring_index(node_id, ":", 1)


def node_id(file: Column, path: Column, name: Column, line: Column | None = None) -> Column:
    """`file:container:...:name`; a name in angle brackets gets its line as well."""
    out = F.concat_ws(":", file, F.when(F.size(path) > 0, F.array_join(path, ":")), name)
    if line is not None:
        out = F.when(name.rlike("^<.*>$"), F.concat_ws(":", out, line.cast("string"))).otherwise(out)
    return out


def parse_node_id(id_: Column) -> Column:
    """struct<file, containers, name>; null for ids without a colon."""
    parts = F.split(id_, ":")
    return F.when(F.size(parts) > 1, F.struct(parts[0].alias("file"), F.slice(parts, 2, F.size(parts) - 2).alias("containers"), F.element_at(parts, -1).alias("name")))


def normal_path(base: Column, relative: Column) -> Column:
    """relative, as seen from base, with `.` and `..` folded (`..` at the top has no effect); a leading `/` is dropped and starts at the top."""
    joined = F.when(relative.startswith("/"), relative).otherwise(F.concat_ws("/", base, relative))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(parts, empty, lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
    return F.array_join(folded, "/")


def last_segment(path: Column) -> Column:
    """The last part that is not empty; null if there is none."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1))


def project_name(path: Column) -> Column:
    """Name of a project file, without its suffix; either slash separates."""
    return F.regexp_replace(last_segment(F.replace(path, F.lit("\\"), F.lit("/"))), r"\.(?:csproj|vbproj|fsproj)$", "")


def version_spec(dep_type: Column, path: Column, spec: Column | None = None) -> Column:
    """Text of a local dependency's version: `path:x`, `workspace:*`, `project:x`, `replace:x`, `subdir:x`; an explicit one has precedence."""
    own = F.when(dep_type == "workspace", F.lit("workspace:*"))
    for kind, prefix in (("path", "path:"), ("project_reference", "project:"), ("replace", "replace:"), ("subdirectory", "subdir:")):
        own = F.when(dep_type == kind, F.concat(F.lit(prefix), F.coalesce(path, F.lit("")))).otherwise(own)
    return own if spec is None else F.coalesce(spec, own)


def normal_tag(tag: Column) -> Column:
    """A capture name without `@` and `name.`."""
    return F.regexp_replace(F.regexp_replace(tag, "^@", ""), "^name[.]", "")


def parse_tag(tag: Column) -> Column:
    """struct<category, node_type, kind, subtype, scope> of a capture name: `definition` or `reference`, a type in lower case, a kind, perhaps a subtype, perhaps `scope` and a scope, with dots between; null for anything else. Unknown kinds are null."""
    parts = F.split(F.regexp_replace(tag, "^@", ""), "[.]")
    at = lambda i: F.get(parts, F.lit(i))
    kind_of = F.when(at(1) == "container", F.lit("Container")).when(at(1) == "callable", F.lit("Callable")).when(at(1) == "data", F.lit("Data")).when(at(1) == "file", F.lit("Container"))
    kind = F.when(at(1) == "file", F.lit("file"))
    for t, kinds in TAG_KINDS.items():
        kind = F.when((kind_of == t) & (at(1) != "file") & at(2).isin(*kinds), at(2)).otherwise(kind)
    rest = F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0)))
    rest = F.when(at(1) == "file", F.array().cast("array<string>")).otherwise(rest)
    mark = F.array_position(rest, "scope")
    subtype = F.when((mark == 0) | (mark > 1), F.get(rest, F.lit(0)))
    scope = F.when(mark > 0, F.get(rest, mark.cast("int")))
    whole = F.struct(at(0).alias("category"), kind_of.alias("node_type"), kind.alias("kind"), subtype.alias("subtype"), scope.alias("scope"))
    return F.when(at(0).isin("definition", "reference") & kind_of.isNotNull(), whole)


def is_manifest_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^@", "").startswith("manifest.")


def parse_manifest_tag(tag: Column) -> Column:
    """struct<element, scope> of `manifest.component.name`, `manifest.component.version`, `manifest.workspace.member`, `manifest.workspace.root` or `manifest.dependency`, each with `.scope.{s}` or not; null for anything else."""
    plain = F.regexp_replace(tag, "^@", "")
    pattern = r"^manifest\.(component\.name|component\.version|workspace\.member|workspace\.root|dependency)(?:\.|$)"
    element = F.regexp_extract(plain, pattern, 1)
    rest = F.split(F.regexp_replace(plain, pattern, ""), "[.]")
    scope = F.when(F.get(rest, F.lit(0)) == "scope", F.get(rest, F.lit(1)))
    return F.when(element != "", F.struct(element.alias("element"), scope.alias("scope")))


def node_type_of_kind(kind: Column) -> Column:
    return _lookup(kind, {k: t for t, kinds in KINDS.items() for k in kinds})


def is_valid_kind(node_type: Column, kind: Column) -> Column:
    return F.coalesce(node_type_of_kind(kind) == node_type, F.lit(False))


def edge_type_of(text: Column) -> Column:
    """An edge type by name, in any case and with or without `_`; null if unknown."""
    return _lookup(F.lower(text), {"contains": "CONTAINS", "uses": "USES", "defines": "DEFINES", "dependson": "DEPENDS_ON", "depends_on": "DEPENDS_ON"})


def prefixed(workspace: Column, id_: Column) -> Column:
    return F.concat(workspace, F.lit("::"), id_)


def unprefixed(id_: Column) -> Column:
    """struct<workspace, id>; the workspace is null without `::`."""
    parts = F.split(id_, "::", 2)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("workspace"), parts[1].alias("id"))).otherwise(F.struct(F.lit(None).cast("string").alias("workspace"), id_.alias("id")))


def name_visibility(language: Column, name: Column) -> Column:
    """Visibility that a name tells: Python by leading underscores, Go by case; null for other languages."""
    python = F.when(name.rlike("^__.*__$"), "public").when(name.startswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public")
    go = F.when(name.rlike(r"^\p{Lu}"), "public").otherwise("private")
    return F.when(language == "python", python).when(language == "go", go)


def memory_estimate(nodes: Column, edges: Column, node_size: int = 512, edge_size: int = 128, overhead: float = 1.4) -> Column:
    """Bytes that a partition of this size takes in memory."""
    return F.floor((nodes * node_size + edges * edge_size) * F.lit(overhead)).cast("long")


def needed_bytes(budget: Column, used: Column, wanted: Column) -> Column:
    """Bytes that must be freed so that `wanted` more fit into a budget."""
    return F.greatest(used + wanted - budget, F.lit(0))


def is_empty_metadata(metadata: Column, fields: tuple[str, ...]) -> Column:
    """Whether none of the fields says anything."""
    out = F.lit(True)
    for f in fields:
        out = out & metadata[f].isNull()
    return out


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB."""
    show = lambda f, unit: F.concat(F.format_number(n / f, 2), F.lit(unit))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, show(1 << 10, " KB")).when(n < 1 << 30, show(1 << 20, " MB")).otherwise(show(1 << 30, " GB"))

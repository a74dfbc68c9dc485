"""Listing and reading trees of files, on local disks and on any file system that pyarrow opens.

Spark's own file index hides every name that begins with `_`, so trees are listed
here. The first levels are listed by the driver until there are directories enough
to deal out; tasks list what is below them, with the ignore rules that hold there,
and other tasks read the files. Symbolic links are not followed.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs

#: Names of ignore files, later ones overrule earlier ones of the same directory.
IGNORE_FILES = (".gitignore", ".ignore", ".latticaignore")
#: A batch of contents is handed on when it has so many bytes or files.
BATCH_BYTES, BATCH_FILES = 8 << 20, 500


def _regex(pattern: str) -> str:
    """A git pattern, without its leading and trailing slash, as a regular expression."""
    r, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            r, i = r + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            r, i = r + ".*", i + 2
        elif pattern[i] == "*":
            r, i = r + "[^/]*", i + 1
        elif pattern[i] == "?":
            r, i = r + "[^/]", i + 1
        elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            r, i = r + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif pattern[i] == "\\" and i + 1 < len(pattern):
            r, i = r + re.escape(pattern[i + 1]), i + 2
        else:
            r, i = r + re.escape(pattern[i]), i + 1
    return r


class _Run:
    """Neighbouring rules that say the same: names and paths without wild cards are looked up, the others are one pattern."""

    def __init__(self, keep: bool):
        self.keep, self.names, self.paths, self.others = keep, (set(), set()), (set(), set()), ([], [])
        self.compiled: list[re.Pattern | None] | None = None

    def add(self, pattern: str, only_dir: bool) -> None:
        anchored, plain = "/" in pattern, pattern.lstrip("/")
        if not re.search(r"[*?\[\\]", plain):
            (self.paths if anchored else self.names)[only_dir].add(plain)
        else:
            self.others[only_dir].append(("" if anchored else "(?:.*/)?") + _regex(plain))

    def matches(self, path: str, name: str, is_dir: bool) -> bool:
        if self.compiled is None:
            self.compiled = [re.compile("|".join(f"(?:{x})" for x in rs)) if rs else None for rs in self.others]
        return any(name in self.names[d] or path in self.paths[d] or (self.compiled[d] and self.compiled[d].fullmatch(path)) for d in (False, True)[: 1 + is_dir])


class Rules:
    """The rules of one ignore file; base is its directory."""

    def __init__(self, text: str, base: str = ""):
        self.base, self.runs = f"{base}/" if base else "", []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r"))
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            pattern = line[1:] if keep else line.removeprefix("\\") if line.startswith(("\\#", "\\!")) else line
            only_dir, pattern = pattern.endswith("/"), pattern.rstrip("/")
            if not pattern:
                continue
            if not self.runs or self.runs[-1].keep != keep:
                self.runs.append(_Run(keep))
            self.runs[-1].add(pattern, only_dir)

    def says(self, path: str, is_dir: bool) -> bool | None:
        """Whether a path from the top is ignored; None if no rule matches it. The last rule that does decides."""
        if not path.startswith(self.base):
            return None
        own = path[len(self.base) :]
        name = own.rpartition("/")[2]
        return next((not r.keep for r in reversed(self.runs) if r.matches(own, name, is_dir)), None)


def ignored(path: str, is_dir: bool, rules: list[Rules]) -> bool:
    """What the rules nearest to a path say; what is below an ignored directory is never asked about."""
    return next((said for r in reversed(rules) if (said := r.says(path, is_dir)) is not None), False)


class Entry(NamedTuple):
    name: str
    is_dir: bool
    size: int


class Disk:
    """A local disk or another file system by its URI."""

    def __init__(self, root: str):
        self.uri = root
        if "://" in root and not root.startswith("file://"):
            self.fs, self.top = pafs.FileSystem.from_uri(root)
        else:
            self.fs, self.top = None, os.path.abspath(re.sub("^file:/*", "/", root))

    def _at(self, path: str) -> str:
        return f"{self.top.rstrip('/')}/{path}" if path else self.top

    def list(self, path: str) -> list[Entry]:
        """Files and directories, without links, sorted; none if the directory can't be read."""
        try:
            if self.fs is None:
                with os.scandir(self._at(path)) as found:
                    return sorted(Entry(e.name, e.is_dir(follow_symlinks=False), 0 if e.is_dir(follow_symlinks=False) else e.stat(follow_symlinks=False).st_size) for e in found if e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False))
            found = self.fs.get_file_info(pafs.FileSelector(self._at(path)))
            return sorted(Entry(e.base_name, e.type == pafs.FileType.Directory, e.size or 0) for e in found if e.type in (pafs.FileType.File, pafs.FileType.Directory))
        except OSError:
            return []

    def read(self, path: str) -> bytes | None:
        """The content; None if the file can't be read, or is gone."""
        try:
            if self.fs is None:
                with open(self._at(path), "rb") as f:
                    return f.read()
            with self.fs.open_input_file(self._at(path)) as f:
                return f.read()
        except OSError:
            return None


def above(root: str) -> list[tuple[str, str]]:
    """(base, text) of the rules that hold for a whole tree: the user's for git, the repository's exclude file, and on a local disk the ignore files of the directories above, up to the repository's top."""
    disk = Disk(root)
    out, exclude = [], disk.read(".git/info/exclude")
    if disk.fs is None:
        try:
            said = subprocess.run(["git", "config", "--global", "--get", "core.excludesFile"], capture_output=True, text=True, timeout=10).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            said = ""
        mine = Path(said or Path(os.environ.get("XDG_CONFIG_HOME") or "~/.config", "git/ignore")).expanduser()
        if mine.is_file():
            out.append(("", mine.read_text(errors="replace")))
    if exclude:
        out.append(("", exclude.decode("utf-8", "replace")))
    if disk.fs is None and not os.path.exists(os.path.join(disk.top, ".git")):
        parents = [p for p in Path(disk.top).parents]
        top = next((i for i, p in enumerate(parents) if (p / ".git").exists()), None)
        for p in reversed(parents[: top + 1]) if top is not None else []:
            prefix = os.path.relpath(disk.top, p)
            for name in IGNORE_FILES:
                if (p / name).is_file():
                    out.append((f"\0{prefix}", (p / name).read_text(errors="replace")))
    return out


class _Outer(Rules):
    """Rules of a directory above the tree: paths are seen from there."""

    def __init__(self, text: str, prefix: str):
        super().__init__(text)
        self.prefix = prefix

    def says(self, path: str, is_dir: bool) -> bool | None:
        return super().says(f"{self.prefix}/{path}", is_dir)


def compiled(known: list[tuple[str, str]]) -> list[Rules]:
    return [_Outer(text, base[1:]) if base.startswith("\0") else Rules(text, base) for base, text in known]


class Found(NamedTuple):
    path: str
    size: int


def walk(disk: Disk, at: str, known: list[tuple[str, str]], skip: Callable[[str, bool], bool], until: int | None = None) -> Iterator[Found | tuple[str, list[tuple[str, str]]]]:
    """Files below a directory; with `until`, level by level, and once so many directories are open these with their rules, (path, known), in place of what is in them."""
    level = [(at, known, compiled(known))]
    while level:
        if until and len(level) >= until:
            yield from ((path, own) for path, own, _ in level)
            return
        below = []
        while level:
            path, own, rules = level.pop(0 if until else -1)
            entries = disk.list(path)
            names = {e.name for e in entries if not e.is_dir}
            for name in IGNORE_FILES:
                if name in names and (raw := disk.read(f"{path}/{name}" if path else name)):
                    text = raw.decode("utf-8", "replace")
                    own, rules = [*own, (path, text)], [*rules, Rules(text, path)]
            for e in entries:
                p = f"{path}/{e.name}" if path else e.name
                if skip(p, e.is_dir) or ignored(p, e.is_dir, rules):
                    continue
                if e.is_dir:
                    below.append((p, own, rules))
                else:
                    yield Found(p, e.size)
            if not until:  # depth first: what is open stays small
                level += below
                below = []
        level = below


def lister(root: str, known: list[list[tuple[str, str]]], skip: Callable[[str, bool], bool]):
    """mapInArrow: (path, rules, size) of files and of directories (rules: a number of `known`; -1 for files) to (path, size) of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk = Disk(root)
        out: list[tuple[str, int]] = []
        give = lambda: pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["path", "size"])
        for batch in batches:
            for path, rules, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for f in walk(disk, path, known[rules], skip) if rules >= 0 else [Found(path, size)]:
                    out.append(f)
                    if len(out) == 10_000:
                        yield give()
                        out.clear()
        yield give()

    return run


def reader(root: str):
    """mapInArrow: (path, size) to (path, content, n_bytes); files that are gone meanwhile are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, rows, size = Disk(root), [], 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([len(r[1]) for r in rows], pa.int64())], names=["path", "content", "n_bytes"])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                content = disk.read(path)
                if content is None:
                    continue
                rows.append((path, content))
                size += len(content)
                if size >= BATCH_BYTES or len(rows) == BATCH_FILES:
                    yield give()
                    rows.clear()
                    size = 0
        yield give()

    return run

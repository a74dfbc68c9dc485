"""Source trees as tables: files, snapshots, roots and components."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..plans import tables
from ..session import ship
from . import manifests, walk

#: Directories that are open when listing is dealt out to tasks.
WIDE = 64


def scan(spark: SparkSession, root: str, rules: str | None = None, exclude: tuple[str, ...] = (), hidden: bool = True) -> DataFrame:
    """(path, content, n_bytes): every file below root that is not excluded, by path relative to it. Ignore files of the tree hold, on any file system; `rules` is the text of one more, which they overrule. Symbolic links are left out."""
    skip = paths.skipper(exclude, hidden)
    disk, known = walk.Disk(root), walk.above(root) + ([("", rules)] if rules else [])
    chains: list[list[tuple[str, str]]] = []
    rows: list[tuple[str, int, int]] = []
    for found in walk.walk(disk, "", known, skip, WIDE):
        if isinstance(found, walk.Found):
            rows.append((found.path, -1, found.size))
        else:
            if found[1] not in chains[-1:]:
                chains.append(found[1])
            rows.append((found[0], len(chains) - 1, 0))
    most = 4 * ship(spark).sparkContext.defaultParallelism
    first = spark.createDataFrame(rows, "path string, rules int, size long")
    if not chains:  # all of it is listed
        return read(first, root, min(most, 1 + len(rows) // 100 + sum(r[2] for r in rows) // walk.BATCH_BYTES))
    listed = first.repartition(min(most, len(rows)), "path").mapInArrow(walk.lister(root, chains, skip), "path string, size long")
    return read(listed, root)


def read(listed: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """(path, content, n_bytes) of the files of a table with a column path."""
    spark = ship(listed.sparkSession)
    # a fixed number of tasks: to AQE these rows are nothing, but their files are not
    own = listed.select("path").repartition(tasks or 4 * spark.sparkContext.defaultParallelism, "path")
    return own.mapInArrow(walk.reader(root), "path string, content binary, n_bytes long")


def sources(files: DataFrame) -> DataFrame:
    """The files of known languages, with `language` and `text`; what is not UTF-8 is read with replacement signs."""
    own = files.withColumn("language", paths.language_of_path(F.col("path"))).where("language is not null")
    return own.withColumn("text", F.col("content").cast("string"))


def snapshot(files: DataFrame, root: str = ".") -> DataFrame:
    """FILES rows (path, sha256, n_bytes, language, root)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), "n_bytes", paths.language_of_path(F.col("path")).alias("language"), F.lit(root).alias("root"))


def discover_roots(path: str, depth: int = 3) -> list[dict]:
    """Roots of a workspace on disk: itself if it is a git repository; else, down to `depth`, git repositories, and directories with source files of their own outside of those. Sorted by path; an error if there is none."""
    top = Path(path)
    is_git = lambda p: (p / ".git").exists()
    if is_git(top):
        return [{"name": top.resolve().name, "path": ".", "kind": "git", **git_metadata(str(top))}]
    found: list[dict] = []

    def walk(p: Path, level: int, inside: bool) -> bool:
        """Whether there is a git repository below p."""
        below = False
        try:
            entries = sorted(x for x in p.iterdir())
        except OSError:
            return False
        for d in entries:
            if d.is_dir() and not d.is_symlink() and not d.name.startswith(".") and d.name not in paths.SKIPPED_DIRS and level < depth:
                if is_git(d):
                    below = True
                    if not inside:
                        found.append({"name": d.name, "path": str(d.relative_to(top)), "kind": "git", **git_metadata(str(d))})
                else:
                    below |= walk(d, level + 1, inside)
        if not below and any(f.is_file() and f.suffix.lstrip(".").lower() in paths.LANGUAGES for f in entries):
            found.append({"name": p.resolve().name, "path": str(p.relative_to(top)), "kind": "code", "remote": None, "branch": None, "commit": None})
        return below

    walk(top, 0, False)
    codes = [r["path"] for r in found if r["kind"] == "code"]
    nested = lambda r: r["kind"] == "code" and any(r["path"] != c and (c == "." or r["path"].startswith(f"{c}/")) for c in codes)
    found = sorted((r for r in found if not nested(r)), key=lambda r: r["path"])
    if not found:
        raise ValueError(f"no code below {path}")
    return found


def git_metadata(path: str) -> dict:
    """remote, branch and commit, null where git does not tell."""

    def ask(*args: str) -> str | None:
        try:
            r = subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, timeout=10)
        except (OSError, subprocess.SubprocessError):
            return None
        return r.stdout.strip() or None if r.returncode == 0 else None

    return {"remote": ask("remote", "get-url", "origin"), "commit": ask("log", "-1", "--format=%H"), "branch": ask("rev-parse", "--abbrev-ref", "HEAD")}


def components(files: DataFrame, repo: str) -> DataFrame:
    """COMPONENTS rows of all manifests that say something; those that can't be read are left out. Ids are `component:{repo}[:{directory}]`."""
    own = files.where(paths.manifest_language(F.col("path")).isNotNull()).select("path", F.col("content").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                directory, _, name = path.rpartition("/")
                info = manifests.parse(name, text or "")
                if info:
                    rows.append((path, json.dumps(info | {"name": info["name"] or directory.rpartition("/")[2] or repo, "directory": directory, "node_id": f"component:{repo}" + (f":{directory}" if directory else "")})))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["path", "info"])

    ship(files.sparkSession)
    found = own.mapInArrow(run, "path string, info string")
    return found.select(F.from_json("info", tables.COMPONENTS).alias("i"), "path").select(F.col("i.node_id"), F.col("i.name"), F.col("path").alias("manifest_path"), *[F.col(f"i.{c}") for c in ("directory", "ecosystem", "version", "is_workspace_root", "workspace_members", "local_dependencies")])

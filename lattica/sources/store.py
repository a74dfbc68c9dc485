"""Graph, files and vectors as Parquet tables that change by small steps.

A table is a list of segments. The first holds all rows; each later one holds the
rows of a change, and keys (a column and a value, such as a file) that the rows of
earlier segments must not have: what a change takes away. A segment is never
changed once written. After MOST changes, or when they hold more rows than a
fifth of the first segment, the next one writes the table anew.

What the tables are is said by a small numbered pointer file, written whole under
another name and then renamed; one names all tables, so that a reader sees a
change of several tables at once or not at all. What the last KEPT pointers do
not name is removed when the next one is written: a reader that began before may
still read for as long.

Nodes are sorted by file and id, edges by source, so that row-group statistics skip
what a lookup does not need.
"""

from __future__ import annotations

import copy
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import tables

SCHEMAS = {"nodes": tables.NODES, "edges": tables.EDGES, "files": tables.FILES, "points_semantic": tables.POINTS, "points_code": tables.POINTS, "components": tables.COMPONENTS}
ORDER = {"nodes": ["file", "id"], "edges": ["source", "target"], "files": ["path"], "points_semantic": ["entity_id"], "points_code": ["entity_id"], "components": ["node_id"], "rows": ["file", "id"]}
#: Columns of a table, beside those of its schema, that changes are made by.
KEYS = {"edges": "_file string, _name string"}
MOST, KEPT = 8, 3
GONE = "key string, value string"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._fs("_versions")
        found = fs.listStatus(p) if fs.exists(p) else []
        return sorted(int(m[1]) for x in found if (m := re.fullmatch(r"(\d+)\.json", x.getPath().getName())))

    def _load(self, number: int | None) -> dict:
        fs, p = self._fs("_versions.json" if number is None else f"_versions/{number:012}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _pointer(self) -> dict:
        numbers = self._numbers()
        if numbers:
            found = self._load(numbers[-1])
        elif self._fs("_versions.json")[0].exists(self._fs("_versions.json")[1]):  # up to version 1.1: one pointer, a table is one path
            found = self._load(None)
            found["tables"] = {n: [{"rows": at, "gone": None, "by": []}] for n, at in found["tables"].items()}
        else:
            return {"schema_version": tables.VERSION, "tables": {}}
        if found["schema_version"] not in ("1.0", "1.1", tables.VERSION):
            raise ValueError(f"schema version {found['schema_version']}")
        return found

    def _point(self, found: dict) -> None:
        """The next pointer; an error if another writer was first."""
        numbers = self._numbers()
        n = numbers[-1] + 1 if numbers else 1
        fs, draft = self._fs(f"_versions/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(found, indent=1).encode()))
        out.close()
        final = self._fs(f"_versions/{n:012}.json")[1]
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"{self.path} was changed by another writer")
        self._forget([*numbers, n])

    def _forget(self, numbers: list[int]) -> None:
        """Remove older pointers, and the segments that only they name."""
        old, kept = numbers[:-KEPT], numbers[-KEPT:]
        if not old:
            return
        used = {p for n in kept for p in _paths(self._load(n))}
        for n in old:
            for p in _paths(self._load(n)) - used:
                fs, at = self._fs(p)
                fs.delete(at, True)
            fs, at = self._fs(f"_versions/{n:012}.json")
            fs.delete(at, False)

    def exists(self, name: str) -> bool:
        return name in self._pointer()["tables"]

    def _schema(self, name: str) -> str | None:
        return f"{SCHEMAS[name]}, {KEYS[name]}" if name in KEYS else SCHEMAS.get(name)

    def _parquet(self, name: str, path: str) -> DataFrame:
        schema = self._schema(name)
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(f"{self.path}/{path}")

    def read(self, name: str, keys: bool = False) -> DataFrame:
        """The current version; an empty table if there is none. Columns that an older version lacks are null. With keys also the columns that changes are made by."""
        segments = self._pointer()["tables"].get(name)
        if segments is None:
            return self.spark.createDataFrame([], SCHEMAS.get(name, "id string"))
        out = None
        for i, s in enumerate(segments):
            own = self._parquet(name, s["rows"])
            for c in sorted({c for later in segments[i + 1 :] for c in later["by"]}):
                gone = [self.spark.read.schema(GONE).parquet(f"{self.path}/{later['gone']}") for later in segments[i + 1 :] if c in later["by"]]
                values = gone[0]
                for g in gone[1:]:
                    values = values.unionByName(g)
                own = own.join(values.where(F.col("key") == c).select(F.col("value").alias("_gone")).distinct(), F.col(f"`{c}`") == F.col("_gone"), "left_anti")
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out if keys or name not in KEYS else out.drop(*(k.split()[0] for k in KEYS[name].split(", ")))

    def _write(self, name: str, df: DataFrame, whole: bool = True, late: dict[str, Column] | None = None) -> str:
        path = f"{name}-{uuid.uuid4().hex[:12]}"
        order = [c for c in ORDER.get(name, []) if c in df.columns]
        own = lambda df: df
        if name in SCHEMAS:
            empty = self.spark.createDataFrame([], self._schema(name))
            own = lambda df: empty.unionByName(df.select(*[c for c in empty.columns if c in df.columns]), allowMissingColumns=True)
        if not late:
            df = own(df)
        # by range, so that one big directory or repository does not become one task
        df = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        if late:
            df = own(df.withColumns(late))
        writer = df.write
        if order and whole:  # for a few rows the filter would be larger than they are
            writer = writer.option(f"parquet.bloom.filter.enabled#{order[-1]}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.path}/{path}")
        return path

    def commit(self, whole: dict[str, DataFrame] | None = None, changes: dict[str, tuple[DataFrame, DataFrame]] | None = None, meta: dict[str, str] | None = None, late: dict[str, dict[str, Column]] | None = None) -> None:
        """Replace tables by `whole` and change others: to fresh rows, and without the rows of which some key (column, value) is in a table GONE. All of it is seen at once. late: by table, columns that are made when its rows are in order, since what is costly would be made twice before."""
        found, late = copy.deepcopy(self._pointer()), late or {}
        for name, df in (whole or {}).items():
            found["tables"][name] = [{"rows": self._write(name, df, late=late.get(name)), "gone": None, "by": []}]
        for name, (fresh, gone) in (changes or {}).items():
            segments = found["tables"].get(name)
            if segments is None:
                found["tables"][name] = [{"rows": self._write(name, fresh, late=late.get(name)), "gone": None, "by": []}]
                continue
            path = f"{name}-gone-{uuid.uuid4().hex[:12]}"
            gone.distinct().coalesce(1).write.parquet(f"{self.path}/{path}")
            by = [r[0] for r in self.spark.read.schema(GONE).parquet(f"{self.path}/{path}").select("key").distinct().collect()]  # column names
            segments.append({"rows": self._write(name, fresh, False, late.get(name)), "gone": path, "by": sorted(by)})
        found["schema_version"] = tables.VERSION
        found.setdefault("meta", {}).update(meta or {})
        self._point(found)
        for name in changes or {}:
            self._compact(name)

    def _bytes(self, path: str) -> int:
        fs, p = self._fs(path)
        return fs.getContentSummary(p).getLength()

    def _compact(self, name: str) -> None:
        segments = self._pointer()["tables"][name]
        if len(segments) > MOST or 5 * sum(self._bytes(s["rows"]) for s in segments[1:]) > self._bytes(segments[0]["rows"]) > 8 << 20:
            self.commit({name: self.read(name, keys=True)})

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """A new version in place of the current one; df may read what it replaces."""
        self.commit({name: df})
        return self.read(name)

    def rewrite(self, name: str, column: str, values: list[str], fresh: DataFrame) -> None:
        """Replace the rows of a table whose column has one of the values, such as the nodes of a partition, by fresh ones; the rest is not touched."""
        self.commit(changes={name: (fresh, gone_by(self.spark, column, values))})

    def append(self, name: str, fresh: DataFrame) -> None:
        """More rows, such as cross references; nothing goes."""
        self.commit(changes={name: (fresh, self.spark.createDataFrame([], GONE))})

    def delete(self, name: str, column: str, values: list[str]) -> int:
        """Remove the rows whose column has one of the values, such as the edges of a source or the cross references of a partition; returns their number."""
        n = self.read(name, keys=True).where(F.col(column).isin(values)).count()
        if n:
            self.rewrite(name, column, values, self.read(name, keys=True).limit(0))
        return n

    def drop(self, name: str) -> bool:
        found = self._pointer()
        if found["tables"].pop(name, None) is None:
            return False
        self._point(found)
        return True

    def save_graph(self, nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None, meta: dict[str, str] | None = None, **others: DataFrame) -> dict:
        """Write a graph, edges with the partitions of their ends, and other tables, all at once; returns its counts."""
        from ..operators.lookup import classify_edges
        from .shared import cut

        n = cut(nodes)
        self.commit({"nodes": n, "edges": classify_edges(edges, n), **({} if files is None else {"files": files}), **others}, meta=meta)
        return self.counts()

    def counts(self) -> dict:
        cross = F.count_if(F.col("src_partition") != F.col("dst_partition"))
        a, b = self.read("nodes").agg(F.count("*"), F.countDistinct("partition_id")).first(), self.read("edges").agg(F.count("*"), cross).first()
        return {"nodes": a[0], "partitions": a[1], "edges": b[0], "cross": b[1], "intra": b[0] - b[1]}

    def meta(self, key: str, value: str | None = None) -> str | None:
        """A small value kept with the tables; set if given."""
        if value is not None:
            self.commit(meta={key: value})
        return self._pointer().get("meta", {}).get(key)

    def size(self) -> int:
        """Bytes of all files."""
        fs, p = self._fs("")
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def clean(self, dry_run: bool = False) -> int:
        """Remove everything; returns the bytes."""
        n = self.size()
        if not dry_run:
            fs, p = self._fs("")
            fs.delete(p, True)
        return n


def gone_by(spark: SparkSession, column: str, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(column, v) for v in values], GONE)


def _paths(pointer: dict) -> set[str]:
    return {p for segments in pointer["tables"].values() for s in segments for p in (s["rows"], s["gone"]) if p}

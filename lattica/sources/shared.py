"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_open = threading.local()


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where none is set and all runs on this machine, as in tests, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: its lineage ends there. It is removed when the innermost scope ends, or the program."""
    path = f"{folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((df.sparkSession, path))
    for s in getattr(_open, "scopes", [])[-1:]:
        s.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the program ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """What is cut inside is removed at the end; for work whose results are written elsewhere."""
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for x in scopes.pop():
            with contextlib.suppress(ValueError):
                _made.remove(x)
            _remove(*x)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for x in _made:
        try:
            _remove(*x)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return

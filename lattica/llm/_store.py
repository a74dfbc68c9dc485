"""Tables and files kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where none is set, as in tests, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lattica/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_remove_all)
    _made[path] = spark
    return path


def remove(path: str) -> None:
    spark = _made.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_all() -> None:
    for path in list(_made):
        try:
            remove(path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, and gives the planner its true size."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove what keep() wrote."""
    remove(getattr(df, "_lattica_path", ""))


def arrow(df: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    """mapInArrow with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under names of our own, so that others can't clash: pick(df, id="doc_id")."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)

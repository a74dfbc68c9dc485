"""Sessions, and this package on the executors."""

from __future__ import annotations

import io
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: "weakref.WeakKeyDictionary" = weakref.WeakKeyDictionary()


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    spark = SparkSession.builder.master(master).config(map=settings | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a context, so that Python workers can import it from any working directory.

    The archive goes to the folder of spark.checkpoint.dir; where none is set, as in tests, to a temporary one."""
    context = spark.sparkContext
    if context in _shipped:
        return spark
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        target = f"{shared.rstrip('/')}/lattica-{uuid.uuid4().hex[:12]}.zip"
        path = context._jvm.org.apache.hadoop.fs.Path(target)
        out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(data.getvalue()))
        out.close()
    else:
        target = str(Path(tempfile.mkdtemp(prefix="lattica-")) / "lattica.zip")
        Path(target).write_bytes(data.getvalue())
    context.addPyFile(target)
    _shipped[context] = True
    return spark

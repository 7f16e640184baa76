"""Tables of a query's own in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, gone when the driver ends. In local mode, where that may be unset, below a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: it has to name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="quadrille-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        folder = "file:" + _own[0]
    path = f"{folder}/quadrille-{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path

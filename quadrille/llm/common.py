"""Helpers that the training-data operators share: folders, tables, and numpy views of Arrow text."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. In local mode, where that may be unset, a folder of our own
    that goes with the process; on a cluster without the setting, an error."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is unset: it has to name a folder that the driver and all executors share")
    if _own_folder is None:
        own = tempfile.mkdtemp(prefix="quadrille-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_folder = "file:" + own
    return _own_folder


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, and survives the loss of any executor.

    The files go when the driver ends, or at `discard`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quadrille-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, store = _hadoop(spark, path)
    store.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that came from `written`; nothing may read them any more, nor what was derived from them."""
    for df in tables:
        where, store = _hadoop(df.sparkSession, df._written)
        store.delete(where, True)


@contextlib.contextmanager
def shuffles_reaped(spark: SparkSession) -> Iterator[None]:
    """Within it Spark drops the shuffle files of a query as soon as it has ended; several jobs of an operator then don't add up."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for mapInArrow whose worker hands free memory back when its partition ends: workers are used again."""
    def tidy(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return tidy


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores more that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


def id_hash_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold of a row. A null id has no fold (null)."""
    return F.crc32(F.col(column).cast("string")) % modulus


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string or binary column and the row offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def blocks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes each (one row at least), so that temporary arrays stay small."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last

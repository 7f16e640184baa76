"""Point reads of archive rows: a data source that opens only the row groups and columns that are asked for.

    spark.dataSource.register(ArchiveRows)
    spark.read.format("archive_rows").schema("thumbnail binary").option("wanted", folder).load()

`wanted` is a folder of Parquet files with a row for each file and portion of its rows (parquet_url, rows: array<int>), as
`plan_rows` writes it, a row group each. Each such row is a partition: its task reads this row of the plan and the footer of one
file, finds the row groups that hold the rows, and reads these groups and the named columns, nothing else. The rows come with their address (parquet_url,
parquet_row) in front. The driver only counts the rows of the plan, from its footers; the ordinals stay with the tasks. A row
that a file doesn't have is an error.

Files are opened by `opener`: paths, file: and what pyarrow's file systems know; others by a function of one's own, named by the
option `opener` as module:function (it takes the address and returns a file object that can seek).
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quadrille.sources.shared import shared_path

ADDRESS = ["parquet_url", "parquet_row"]


def uri(path: str) -> str:
    """Spark writes file:/x; pyarrow reads file:///x."""
    return "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def opened(url: str):
    """A file of any file system that pyarrow knows."""
    store, path = pafs.FileSystem.from_uri(uri(url)) if ":" in url.split("/", 1)[0] else (pafs.LocalFileSystem(), url)
    return store.open_input_file(path)


def picked(url: str, rows: list[int], columns: list[str], opener=opened) -> Iterator[pa.RecordBatch]:
    """The rows of a file at the given ordinals, ascending, each once, with the ordinal as parquet_row; a group at a time."""
    with opener(url) as source, pq.ParquetFile(source) as file:
        ends = np.cumsum([file.metadata.row_group(g).num_rows for g in range(file.num_row_groups)])
        want = np.unique(np.asarray(rows, np.int64))
        if len(want) and (want[0] < 0 or want[-1] >= (ends[-1] if len(ends) else 0)):
            raise IndexError(f"{url} has no row {want[0] if want[0] < 0 else want[-1]}")
        group = np.searchsorted(ends, want, "right")
        for g in np.unique(group).tolist():
            own = want[group == g]
            table = file.read_row_group(g, columns=columns)
            part = table.take(pa.array(own - (ends[g] - table.num_rows)))
            yield from part.append_column("parquet_row", pa.array(own.astype(np.int32))).to_batches()


@dataclass
class Portion(InputPartition):
    file: str  # of the plan
    ordinal: int  # of the row group there, which is one row

    def __init__(self, file: str, ordinal: int):
        super().__init__((file, ordinal))
        self.file, self.ordinal = file, ordinal


class ArchiveRowReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.names, self.wanted = schema.fieldNames(), options["wanted"]
        self.kinds = to_arrow_schema(schema)
        module, _, name = options.get("opener", "").partition(":")
        self.opener = getattr(importlib.import_module(module), name) if module else opened

    def partitions(self) -> list[Portion]:
        files, prefix = ds.dataset(uri(self.wanted), format="parquet").files, uri(self.wanted).partition("://")[0] + "://" if "://" in uri(self.wanted) else ""
        out = []
        for file in sorted(files):
            with opened(prefix + file) as source:
                found = pq.ParquetFile(source).metadata
                if found.num_row_groups != found.num_rows:
                    raise ValueError(f"{file} is no plan: it has {found.num_rows} rows in {found.num_row_groups} row groups")
                out += [Portion(prefix + file, k) for k in range(found.num_rows)]
        return out

    def read(self, partition: Portion | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # so Spark reads a plan without rows
            return
        with opened(partition.file) as source:
            plan = pq.ParquetFile(source).read_row_groups([partition.ordinal], columns=["parquet_url", "rows"]).to_pylist()[0]
        columns = [n for n in self.names if n not in ADDRESS]
        for batch in picked(plan["parquet_url"], plan["rows"], columns, self.opener):
            address = {"parquet_url": pa.array([plan["parquet_url"]] * batch.num_rows, pa.string())}
            arrays = [address[n] if n in address else batch.column(n) for n in self.names]
            yield pa.RecordBatch.from_arrays([a.cast(self.kinds.field(n).type) for a, n in zip(arrays, self.names)], schema=self.kinds)


class ArchiveRows(DataSource):
    """The data source "archive_rows"; see the module."""

    @classmethod
    def name(cls) -> str:
        return "archive_rows"

    def reader(self, schema: StructType) -> ArchiveRowReader:
        return ArchiveRowReader(schema, self.options)


def plan_rows(wanted: DataFrame, path: str, portion: int = 256) -> None:
    """Write the plan of a read: the addresses (parquet_url, parquet_row) of `wanted`, each once, by file and portion of rows.

    A portion spans `portion` ordinals, so a file of which very many rows are wanted is read by many tasks. Each portion is a row
    group and a file of the plan has few, so that a task reads its own portion and not the plan.
    """
    own = wanted.select(F.col("parquet_url").cast("string").alias("parquet_url"), F.col("parquet_row").cast("int").alias("parquet_row")).where("parquet_url IS NOT NULL AND parquet_row IS NOT NULL")
    by_file = own.groupBy("parquet_url", F.floor(F.col("parquet_row") / portion).alias("portion")).agg(F.sort_array(F.collect_set("parquet_row")).alias("rows"))
    by_file.select("parquet_url", "rows").write.option("parquet.block.row.count.limit", 1).option("maxRecordsPerFile", 64).parquet(path)


def addresses(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of all rows of the archives below `path`, with their address (parquet_url, parquet_row).

    A task takes whole files and reads the chunks of these columns only. Spark's own reader (`readers.archive`) fetches some
    128 KB around each chunk, which in an archive of one raster a row group is far more than the archive.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    kept = spark.read.parquet(path).select(*columns).schema
    kinds = to_arrow_schema(StructType([StructField("parquet_url", StringType()), StructField("parquet_row", IntegerType()), *kept.fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column("path").to_pylist():
                with opened(url) as source:
                    at = 0
                    for part in pq.ParquetFile(source).iter_batches(8192, columns=columns):
                        n = part.num_rows
                        arrays = [pa.array([url] * n, pa.string()), pa.array(np.arange(at, at + n, dtype=np.int32)), *[part.column(c) for c in columns]]
                        yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, kinds)], schema=kinds)
                        at += n

    schema = StructType([StructField("parquet_url", StringType()), StructField("parquet_row", IntegerType()), *kept.fields])
    return files.repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInArrow(run, schema)


def read_rows(wanted: DataFrame, columns: StructType, portion: int = 256, opener: str | None = None) -> DataFrame:
    """parquet_url, parquet_row and `columns` of the archive rows that `wanted` addresses, each row once.

    Only their row groups and these columns are read. The plan is kept in the shared folder as long as the driver runs.
    """
    spark: SparkSession = wanted.sparkSession
    path = shared_path(spark, "wanted")
    plan_rows(wanted, path, portion)
    spark.dataSource.register(ArchiveRows)
    schema = StructType([StructField("parquet_url", StringType()), StructField("parquet_row", IntegerType()), *columns.fields])
    reader = spark.read.format("archive_rows").schema(schema).option("wanted", path)
    return (reader.option("opener", opener) if opener else reader).load()

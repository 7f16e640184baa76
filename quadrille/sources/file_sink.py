"""A sink of files that commits: a tree of files appears whole, once, whatever tasks fail, run twice or are lost.

    write_files(df, root)   # columns path (relative to root) and content

A task writes its files below root/_jobs/<job>/<attempt>, a folder no other attempt shares, with a list of their paths. The
driver commits by one small file that names the attempts Spark accepted, one a task. Then a Spark job moves the files to their
places: a task an attempt. A move that was made already is passed over, so that job can be repeated; `resume` does so for
committed jobs whose driver was lost before the end. A job that fails leaves nothing in place but what earlier jobs wrote; what
its last tasks, still running then, leave below _jobs is for `sweep`.

Rows without a path or content give no file; a path that leaves the root, one below _jobs, and one given twice, with
content or without, are errors. A file that is there from an earlier job is replaced. Any file system that pyarrow knows will do, if all executors share it.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quadrille.sources.archive_rows import uri

JOBS, COMMITTED, LISTING = "_jobs", "committed", "listing"


def located(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a root and the path there."""
    return pafs.FileSystem.from_uri(uri(root)) if ":" in root.split("/", 1)[0] else (pafs.LocalFileSystem(), root)


def relative(path: str) -> str:
    """The path in plain form; it has to stay below the root and outside the folder of jobs."""
    plain = posixpath.normpath(path)
    if plain.startswith("/") or ".." in path.split("/") or plain.split("/")[0] in (".", JOBS):
        raise ValueError(f"{path!r} is no path below the root")
    return plain


@dataclass
class Staged(WriterCommitMessage):
    """What a task tells the driver: its folder, and how many files it holds."""

    attempt: str
    files: int


class Staging:
    """The folder of one attempt; files are numbered there, their paths listed at the end."""

    def __init__(self, root: str, job: str):
        self.store, base = located(root)
        self.attempt, self.paths = uuid.uuid4().hex, []
        self.folder = f"{base}/{JOBS}/{job}/{self.attempt}"
        self.store.create_dir(self.folder, recursive=False)  # the driver made the folder of the job; it is gone after an abort

    def stream(self, path: str):
        self.paths.append(relative(path))
        return self.store.open_output_stream(f"{self.folder}/{len(self.paths) - 1}")

    def done(self) -> Staged:
        pq.write_table(pa.table({"path": pa.array(self.paths, pa.string())}), f"{self.folder}/{LISTING}", filesystem=self.store)
        return Staged(self.attempt, len(self.paths))


class StagedWriter(DataSourceArrowWriter):
    """Commit and abort of a job; what a task writes is for the subclass to say, in `stage`."""

    def __init__(self, options):
        self.root, self.job = options["path"], options["job"]

    def stage(self, batches: Iterator[pa.RecordBatch], to: Staging) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        to = Staging(self.root, self.job)
        self.stage(iterator, to)
        return to.done()

    def commit(self, messages: list[Staged | None]) -> None:
        store, base = located(self.root)
        folder = f"{base}/{JOBS}/{self.job}"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{COMMITTED}.new") as out:
            out.write("\n".join(m.attempt for m in messages if m is not None and m.files).encode())
        store.move(f"{folder}/{COMMITTED}.new", f"{folder}/{COMMITTED}")

    def abort(self, messages: list[Staged | None]) -> None:
        try:
            forget(self.root, self.job)
        except OSError:  # a task that still runs wrote meanwhile
            pass


class FileWriter(StagedWriter):
    def stage(self, batches: Iterator[pa.RecordBatch], to: Staging) -> None:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                if path.is_valid and content.is_valid:
                    with to.stream(path.as_py()) as out:
                        out.write(content.as_buffer())


class StagedFiles(DataSource):
    """The format "staged_files": columns path and content; option job. `write_files` uses it."""

    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options)


def forget(root: str, job: str) -> None:
    """Remove the folder of a job."""
    store, base = located(root)
    folder = f"{base}/{JOBS}/{job}"
    if store.get_file_info(folder).type == pafs.FileType.Directory:
        store.delete_dir(folder)


def _exists(store: pafs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type == pafs.FileType.File


def moved(root: str, job: str, attempt: str) -> int:
    """Move the files of an attempt to their places; those that are there already are passed over."""
    store, base = located(root)
    folder = f"{base}/{JOBS}/{job}/{attempt}"
    paths = pq.read_table(f"{folder}/{LISTING}", filesystem=store)["path"].to_pylist()
    for i, path in enumerate(paths):
        source, target = f"{folder}/{i}", f"{base}/{path}"
        if _exists(store, source):
            store.create_dir(posixpath.dirname(target), recursive=True)
            try:
                store.move(source, target)
                continue
            except FileNotFoundError:  # another run of this task was faster
                pass
        if not _exists(store, target):
            raise FileNotFoundError(f"{path} of job {job} is neither staged nor written")
    return len(paths)


def publish(spark: SparkSession, root: str, job: str) -> int:
    """Move the files of a committed job to their places, a task an attempt; how many there are."""
    store, base = located(root)
    with store.open_input_file(f"{base}/{JOBS}/{job}/{COMMITTED}") as source:
        attempts = source.read().decode().split()  # one a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"files": pa.array([moved(root, job, a) for a in batch.column("attempt").to_pylist()], pa.int64())})

    files = 0
    if attempts:
        each = spark.createDataFrame([(a,) for a in attempts], "attempt string").repartition(len(attempts))
        files = each.mapInArrow(run, "files long").agg(F.sum("files")).first()[0]
    forget(root, job)
    return files


def resume(spark: SparkSession, root: str) -> int:
    """Finish committed jobs whose driver was lost; jobs that did not commit are left alone, they may be running."""
    store, base = located(root)
    jobs = store.get_file_info(pafs.FileSelector(f"{base}/{JOBS}", allow_not_found=True))
    return sum(publish(spark, root, j.base_name) for j in jobs if _exists(store, f"{j.path}/{COMMITTED}"))


def sweep(root: str, seconds: float = 7 * 86_400) -> int:
    """Remove what jobs that never committed left, if their folder has not changed for so long; how many jobs."""
    store, base = located(root)
    jobs = store.get_file_info(pafs.FileSelector(f"{base}/{JOBS}", allow_not_found=True))
    old = [j.base_name for j in jobs if not _exists(store, f"{j.path}/{COMMITTED}") and time.time() - j.mtime_ns / 1e9 >= seconds]
    for job in old:
        forget(root, job)
    return len(old)


def write_staged(df: DataFrame, root: str, source: type[DataSource], **options: str) -> int:
    """Write with a staged format, commit and publish; how many files were written."""
    spark, job = df.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(source)
    store, base = located(root)
    store.create_dir(f"{base}/{JOBS}/{job}", recursive=True)
    df.write.format(source.name()).mode("append").options(job=job, **options).save(root)
    return publish(spark, root, job)


def write_files(files: DataFrame, root: str) -> int:
    """Write a file for each row (path, content); see the module. The contents are not shuffled, and only paths are compared."""
    own = files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "/+", "/"), r"(^|/)(\./)+", "$1"), r"/\.?$", "")  # as `relative`
    twice = own.where("path IS NOT NULL").groupBy(plain.alias("path")).count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['path']!r} is the path of {twice['count']} rows")
    return write_staged(own, root, StagedFiles)

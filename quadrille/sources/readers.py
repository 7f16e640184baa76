"""Sources: metadata tables, query points, image archives, unpacked samples, raster and picture files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.sources.images import decoded, picture


def read_metadata(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A metadata table; a timestamp in text becomes a timestamp without zone. Positions stay two plain columns."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if dict(df.dtypes).get("timestamp") == "string":
        df = df.withColumn("timestamp", F.to_timestamp_ntz("timestamp"))
    return df


def read_points(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", schema: str | None = None) -> DataFrame:
    """Query points from CSV with a header (columns Latitude, Longitude and others)."""
    reader = spark.read.option("header", True).option("encoding", encoding)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def parquet_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, size of the Parquet files of a folder, by name; lists files, reads none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    return found.select("path", F.col("length").alias("size")).orderBy("path")


def archive(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of image archives with their address: file path as parquet_url, ordinal in the file as parquet_row.

    Only the named columns are read; a filter on parquet_url prunes files.
    """
    return spark.read.parquet(path).select(F.col("_metadata.file_path").alias("parquet_url"), F.col("_metadata.row_index").cast("int").alias("parquet_row"), *columns)


def rows_of(meta: DataFrame, images: DataFrame) -> DataFrame:
    """The archive rows that metadata rows point to, each with its metadata."""
    return meta.join(images, ["parquet_url", "parquet_row"])


def band_columns(names: list[str], extra: str = "cloud_mask") -> list[str]:
    """Optical band columns (those starting with B) and the cloud mask where there is one."""
    return [n for n in names if n.startswith("B")] + [extra] * (extra in names)


def read_samples(meta: DataFrame, images: DataFrame, rasters: list[str], pictures: list[str] = ["thumbnail"], raster: Callable = decoded, image: Callable = picture) -> DataFrame:  # noqa: B006
    """Metadata rows with the decoded bands and pictures of the archive rows they point to (images as `archive` or `archive_rows.read_rows` reads them).

    Rows meet by address first; only those that are wanted are decoded.
    """
    met = rows_of(meta, images.select("parquet_url", "parquet_row", *rasters, *pictures))
    return met.withColumns({b: raster(F.col(b)) for b in rasters} | {p: image(F.col(p)) for p in pictures})


def rows_one_by_one(df: DataFrame) -> Iterator[Row]:
    """The rows, fetched a partition at a time as they are asked for."""
    return df.toLocalIterator(prefetchPartitions=True)


def row_at(df: DataFrame, ordinal: int, order: list[str]) -> DataFrame:
    """The row at a position of a total order, counted from 0, without a global sort on one task.

    Only the ordering columns are sorted; counts of range partitions tell which of them holds the position. Rows that
    agree in all of them are told apart by nothing, so the order has to be total.
    """
    keys = df.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).persist()
    try:
        before = 0
        for p, n in sorted((r._p, r.n) for r in keys.groupBy("_p").agg(F.count("*").alias("n")).collect()):  # one row a partition
            if ordinal < before + n:
                rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
                found = keys.where(F.col("_p") == p).withColumn("_k", rank).where(F.col("_k") == ordinal - before + 1).drop("_p", "_k").first()
                return df.where(reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(found[c])) for c in order])).limit(1)
            before += n
        raise IndexError(f"there is no row {ordinal}; the table has {before}")
    finally:
        keys.unpersist()


@dataclass
class SampleTable:
    """Samples of an unpacked tree by their metadata: `len`, one by position, or all as a table.

    `raster_transform` and `picture_transform` take and return columns: a raster struct and a picture struct.
    """

    meta: DataFrame
    root: str
    rasters: list[str] = field(default_factory=lambda: ["B04", "B03", "B02"])
    pictures: list[str] = field(default_factory=lambda: ["thumbnail"])
    raster_transform: Callable[[Column], Column] = lambda column: column
    picture_transform: Callable[[Column], Column] = lambda column: column
    order: tuple[str, ...] = ("grid_cell", "product_id")

    def __len__(self) -> int:
        return self.meta.count()

    def samples(self, meta: DataFrame | None = None) -> DataFrame:
        """Metadata rows with a column for each band and picture; null where the tree lacks the file."""
        out = self.meta if meta is None else meta
        for names, decode, change in ((self.rasters, decoded, self.raster_transform), (self.pictures, picture, self.picture_transform)):
            for name in names:
                files = unpacked_files(out.sparkSession, self.root, name)
                out = out.join(files.select("grid_cell", "product_id", F.col("content").alias(name)), ["grid_cell", "product_id"], "left")
                out = out.withColumn(name, change(decode(F.col(name))))
        return out

    def __getitem__(self, ordinal: int) -> Row:
        """The sample at a position; of the tree only its own folder is listed, if it has one."""
        if ordinal < 0:
            raise IndexError("positions count from 0")
        found = row_at(self.meta, ordinal, list(self.order))
        cell, product = found.select("grid_cell", "product_id").first()
        own = replace(self, root=f"{self.root}/{cell.split('_')[0]}/{cell}/{product}")
        try:
            return own.samples(found).first()
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.samples(found).first()


def unpacked_files(spark: SparkSession, root: str, band: str | None = None) -> DataFrame:
    """row, grid_cell, product_id, band, content of the files of an unpacked tree root/row/cell/product/band.ext, or of a
    folder below; of one band, only its files are listed and read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", f"{band}.*") if band else reader).load(root)
    part = lambda i: F.element_at(F.split("path", "/"), F.lit(i))
    return files.select(part(-4).alias("row"), part(-3).alias("grid_cell"), part(-2).alias("product_id"), F.regexp_replace(part(-1), r"\.[^.]*$", "").alias("band"), "content")

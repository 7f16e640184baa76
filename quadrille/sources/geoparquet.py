"""GeoParquet: well-known binary in a column, and the `geo` key of the specification in the footer of every file.

`write_geoparquet` writes a file a task through the sink that commits (`file_sink`); the bounding box and the kinds of geometry
in a footer are those of the file's own rows. `geo_metadata` reads the footers as a table, by tasks; `read_in_box` opens only the
files whose box meets a given one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quadrille.sources.archive_rows import opened
from quadrille.sources.file_sink import Staging, StagedWriter, write_staged
from quadrille.sources.wkb import parsed

VERSION = "1.1.0"  # fixed value of the format
METADATA = "path string, version string, primary_column string, encoding string, geometry_types array<string>, crs string, xmin double, ymin double, xmax double, ymax double"


class GeoWriter(StagedWriter):
    def __init__(self, schema: StructType, options):
        super().__init__(options)
        self.schema, self.geometry = to_arrow_schema(schema), options["geometry"]
        self.crs, self.group = options.get("crs"), int(options["rows"])

    def stage(self, batches: Iterator[pa.RecordBatch], to: Staging) -> None:
        kinds, box, file, held, n = set(), [float("inf"), float("inf"), -float("inf"), -float("inf")], None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                out = to.stream(f"part-{to.attempt}.parquet")
                file = pq.ParquetWriter(out, self.schema, compression="zstd")
            for content in batch.column(self.geometry).to_pylist():
                if content is not None:
                    kind, parts = parsed(content)
                    kinds.add(kind)
                    for x, y in (p for rings in parts for ring in rings for p in ring):
                        if x == x and y == y:  # empty points hold no numbers
                            box = [min(box[0], x), min(box[1], y), max(box[2], x), max(box[3], y)]
            held.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, self.schema)], schema=self.schema))
            n += batch.num_rows
            if n >= self.group:
                file.write_table(pa.Table.from_batches(held), row_group_size=self.group)
                held, n = [], 0
        if file is None:
            return
        if held:
            file.write_table(pa.Table.from_batches(held), row_group_size=self.group)
        column = {"encoding": "WKB", "geometry_types": sorted(kinds)}
        if self.crs is not None:
            column["crs"] = json.loads(self.crs)
        if box[0] <= box[2]:
            column["bbox"] = box
        file.add_key_value_metadata({"geo": json.dumps({"version": VERSION, "primary_column": self.geometry, "columns": {self.geometry: column}})})
        file.close()
        out.close()


class GeoFiles(DataSource):
    """The format "geoparquet_files"; options job, geometry, rows and crs. `write_geoparquet` uses it."""

    @classmethod
    def name(cls) -> str:
        return "geoparquet_files"

    def writer(self, schema: StructType, overwrite: bool) -> GeoWriter:
        return GeoWriter(schema, self.options)


def write_geoparquet(df: DataFrame, path: str, geometry: str = "geometry", crs: dict | None = None, rows: int = 65_536) -> int:
    """Add the rows to a GeoParquet folder, a file for each task that has rows; how many files.

    geometry: the column of well-known binary (null: no geometry). crs: as PROJJSON; none means longitude and latitude.
    rows: of a row group. Rows near each other should lie together (`operators/layout.py`), so that boxes are small.
    """
    if dict(df.dtypes).get(geometry) != "binary":
        raise ValueError(f"{geometry} has to be a column of well-known binary")
    return write_staged(df, path, GeoFiles, geometry=geometry, rows=str(rows), **({} if crs is None else {"crs": json.dumps(crs)}))


def geo_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row for each Parquet file of a folder: what its `geo` key says of the primary column; nulls where there is none.

    crs is PROJJSON, "null" where the file says it is unknown, and null where the file leaves it out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column("path").to_pylist():
                with opened(url) as source:
                    geo = json.loads((pq.read_metadata(source).metadata or {}).get(b"geo", b"{}"))
                name = geo.get("primary_column")
                own = geo.get("columns", {}).get(name, {})
                box = own.get("bbox") or []
                low, high = box[: len(box) // 2], box[len(box) // 2 :]  # with heights: six numbers
                rows.append({
                    "path": url, "version": geo.get("version"), "primary_column": name, "encoding": own.get("encoding"), "geometry_types": own.get("geometry_types"),
                    "crs": json.dumps(own["crs"]) if "crs" in own else None, **dict(zip(("xmin", "ymin"), low)), **dict(zip(("xmax", "ymax"), high)),
                })
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = to_arrow_schema(StructType.fromDDL(METADATA))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return files.mapInArrow(run, METADATA)


def read_geoparquet(spark: SparkSession, path: str) -> DataFrame:
    """The rows; geometries stay well-known binary (`wkb.shape` reads them)."""
    return spark.read.parquet(path)


def read_in_box(spark: SparkSession, path: str, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """The rows of the files whose box meets the given one, or that state none; rows are not filtered.

    The driver gets the names of these files, as it does to list any folder. Boxes do not cross the antimeridian.
    """
    apart = (F.col("xmin") > xmax) | (F.col("xmax") < xmin) | (F.col("ymin") > ymax) | (F.col("ymax") < ymin)
    files = [r.path for r in geo_metadata(spark, path).where(~F.coalesce(apart, F.lit(False))).select("path").collect()]
    return spark.read.parquet(*files) if files else spark.read.parquet(path).where(F.lit(False))

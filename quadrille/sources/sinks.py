"""Sinks: unpacked samples, embedding tables, GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.text import sample_path
from quadrille.sources.file_sink import write_files


def unpack(samples: DataFrame, path: str, source: str) -> None:
    """Samples as Parquet by grid row, each with the path it has in an unpacked tree; a large row is written by several tasks."""
    placed = samples.withColumn("path", sample_path(F.lit(source), F.col("grid_cell"), F.col("product_id"))).withColumn("grid_row", F.split_part("grid_cell", F.lit("_"), F.lit(1)))
    placed.hint("rebalance", "grid_row").write.mode("overwrite").partitionBy("grid_row").parquet(path)


def unpack_files(samples: DataFrame, root: str, source: str, bands: list[str], thumbnail: str = "thumbnail") -> int:
    """Writes source/row/cell/product/{band}.tif and thumbnail.png under a folder that all executors share, whole or not at all
    (`file_sink`); how many files. A missing band gives no file; two samples of one cell and product are an error."""
    folder = sample_path(F.lit(source), F.col("grid_cell"), F.col("product_id"))
    names = {b: "thumbnail.png" if b == thumbnail else f"{b}.tif" for b in [*bands, thumbnail] if b in samples.columns}
    each = F.array(*[F.struct(F.concat_ws("/", folder, F.lit(n)).alias("path"), F.col(b).alias("content")) for b, n in names.items()])
    return write_files(samples.select(F.inline(each)), root)


def write_embeddings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def geojson_feature(geometry_type: str, coordinates: Column, **properties: Column) -> Column:
    """A GeoJSON feature as text."""
    geometry = F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties")))


def write_geojson_lines(df: DataFrame, path: str, feature: Column) -> None:
    """One feature a line."""
    df.select(feature.alias("value")).write.mode("overwrite").text(path)

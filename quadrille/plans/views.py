"""Inputs of the registered queries: tables of metadata, tiles, rasters and points derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Regions as minx, miny, maxx, maxy in degrees; fixed values of the documented examples.
REGIONS = {
    "switzerland": (5.9559111595, 45.8179931641, 10.4920501709, 47.808380127),
    "gabon": (8.1283659854, -4.9213919841, 15.1618722208, 2.7923006325),
    "napoli": (14.091710578, 40.7915558593, 14.3723765416, 40.9819258062),
    "pacific": (-153.3922893485, 39.6170415622, -152.0423077748, 40.7090892316),
}
EUROPE = (-25.0, 30.0, 45.0, 72.0)

META_SQL = """SELECT event_id, ((event_id*7919) % 168001)/1000.0 - 84.0 AS centre_lat, ((event_id*104729) % 359981)/1000.0 - 179.99 AS centre_lon,
  ts AS timestamp, value/4.9021 AS cloud_cover, (event_id % 11)/10.0 AS nodata, 'P' || (event_id % 997) AS product_id,
  CAST(event_id % 40 AS INTEGER) AS parquet_row, event_type AS modality,
  'https://host/Core/' || event_type || '/part_' || (event_id % 7) || '.parquet' AS parquet_url FROM events"""
POINTS_SQL = "SELECT c_custkey AS point_id, ((c_custkey*7919) % 168001)/1000.0 - 84.0 + 0.01 AS lat, ((c_custkey*104729) % 359981)/1000.0 - 179.99 + 0.01 AS lon FROM customer"


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per event, spread over the globe."""
    e = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", ((e * 7919 % 168001).cast("double") / 1000.0 - 84.0).alias("centre_lat"), ((e * 104729 % 359981).cast("double") / 1000.0 - 179.99).alias("centre_lon"),
        F.col("ts").alias("timestamp"), (F.col("value") / 4.9021).alias("cloud_cover"), ((e % 11).cast("double") / 10.0).alias("nodata"), F.concat(F.lit("P"), e % 997).alias("product_id"),
        (e % 40).cast("int").alias("parquet_row"), F.col("event_type").alias("modality"),
        F.concat(F.lit("https://host/Core/"), "event_type", F.lit("/part_"), e % 7, F.lit(".parquet")).alias("parquet_url"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query point per customer."""
    c = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        c.alias("point_id"), ((c * 7919 % 168001).cast("double") / 1000.0 - 84.0 + 0.01).alias("lat"), ((c * 104729 % 359981).cast("double") / 1000.0 - 179.99 + 0.01).alias("lon")
    )


def tiles(spark: SparkSession) -> DataFrame:
    """A lattice of hexagonal tiles, 10 degrees wide, over two years: tile_id, year, path, ring."""
    t, x, y = F.col("id"), (F.col("id") % 36).cast("double") * 10 - 180, F.floor(F.col("id") % 648 / 36).cast("double") * 10 - 90
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return spark.range(1296).select(
        t.alias("tile_id"), (F.lit(2023) + F.floor(t / 648)).cast("int").alias("year"), F.concat(F.lit("tiles/"), t, F.lit(".tif")).alias("path"),
        F.array(corner(2.5, 0), corner(7.5, 0), corner(10, 5), corner(7.5, 10), corner(2.5, 10), corner(0, 5)).alias("ring"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def rasters(spark: SparkSession, sf_dir: str, scale: float = 10000.0, shift: float = 0.0) -> DataFrame:
    """Embeddings as 8 x 8 rasters: vec_id, px (64 doubles)."""
    return vectors(spark, sf_dir).select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * scale + shift).alias("px"))

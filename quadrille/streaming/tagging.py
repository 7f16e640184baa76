"""Streams of samples: the cell expressions and filters run on them unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.grid import GridSpec, with_cell


def tagged_stream(stream: DataFrame, spec: GridSpec, lat: str, lon: str, timestamp: str = "timestamp", delay: str = "1 hour") -> DataFrame:
    """Samples with their cell, each (cell, product) once within the delay that late rows are waited for."""
    tagged = with_cell(stream.withWatermark(timestamp, delay), lat, lon, spec)
    return tagged.dropDuplicatesWithinWatermark(["grid_cell", "product_id"])


def cell_counts(stream: DataFrame, spec: GridSpec, lat: str, lon: str, timestamp: str = "timestamp", delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Samples per cell and time window."""
    tagged = with_cell(stream.withWatermark(timestamp, delay), lat, lon, spec)
    return tagged.groupBy(F.window(timestamp, window), "grid_cell").agg(F.count("*").alias("samples"))

"""Hillshade of elevation rasters: needs each pixel's neighbours, so it runs on whole arrays in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def shade(dem: np.ndarray, azimuth: float = 315.0, altitude: float = 45.0, exaggeration: float = 1.0) -> np.ndarray:
    """Light on a surface from an azimuth and altitude in degrees, stretched to 0..1; a flat surface keeps the plain sine."""
    dy, dx = np.gradient(dem.astype(np.float64) * exaggeration) if min(dem.shape) > 1 else (np.zeros(dem.shape), np.zeros(dem.shape))
    az, alt = np.radians(90 - azimuth), np.radians(altitude)
    light = np.array([np.cos(az) * np.cos(alt), np.sin(az) * np.cos(alt), np.sin(alt)])
    normal = np.stack([-dx, dy, np.ones(dem.shape)])  # rows go south, so dy changes sign
    out = np.tensordot(light, normal / np.sqrt((normal**2).sum(0)), 1)
    low, high = out.min(), out.max()
    return np.clip((out - low) / (high - low) if high - low > 1e-6 else out, 0, 1)


def hillshade(dem: Column, height: int, width: int) -> Column:
    """Flat raster to uint8 shades; null stays null."""

    @F.pandas_udf("array<int>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else (255 * shade(np.asarray(x, np.float64).reshape(height, width))).astype(int).ravel().tolist() for x in v], dtype=object)

    return run(dem)

"""False-colour composites: the first principal components of a raster's channels as red, green and blue."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NODATA = 65535  # fixed value: a pixel whose channels all have it has no data


def components_rgb(pixels: np.ndarray, nodata: float = NODATA) -> np.ndarray:
    """Pixels (n x channels) to n x 3 shades: three components, each stretched to 0..255 over the raster.

    A component's largest loading is positive; a component without spread is 0, and so are pixels without data.
    """
    centred = pixels - pixels.mean(0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :3]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    pc = np.zeros((len(pixels), 3))
    pc[:, : axes.shape[1]] = centred @ axes
    low, span = pc.min(0), np.ptp(pc, axis=0)
    out = np.where(span > 0, 255 * (pc - low) / np.where(span > 0, span, 1), 0).astype(np.uint8)
    return out * (pixels.sum(1) != pixels.shape[1] * nodata)[:, None]


def pca_rgb(pixels: Column, channels: int, nodata: float = NODATA) -> Column:
    """array<array<int>> of shades from a raster as a flat array, channel by channel within each pixel; null stays null."""

    @F.pandas_udf("array<array<int>>")
    def run(v: pd.Series) -> pd.Series:
        shades = lambda x: components_rgb(np.asarray(x, np.float64).reshape(-1, channels), nodata).astype(int).tolist() if len(x) else []
        return pd.Series([None if x is None else shades(x) for x in v], dtype=object)

    return run(pixels.cast("array<double>"))

"""From a row with the binary bands of a sample to a column with its thumbnail as a picture file.

Each takes columns of raster files and gives a binary column, null if a band is missing. `decoder` and `encoder` are the hooks of
`sources/images.py`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions import raster
from quadrille.operators.hillshade import shade
from quadrille.sources.images import tiff, write_png


def _file(bands: list[Column], pixels: Callable[..., np.ndarray], decoder: Callable, encoder: Callable) -> Column:
    """One pass from files to a file in Arrow batches: pixels never become columns."""

    @F.pandas_udf("binary")
    def run(*files: pd.Series) -> pd.Series:
        made = []
        for row in zip(*files):
            if any(content is None for content in row):
                made.append(None)
                continue
            read = [decoder(bytes(content)) for content in row]
            made.append(encoder(pixels(*[np.asarray(r["data"], np.float64).reshape(r["height"], r["width"]) for r in read])))
        return pd.Series(made, dtype=object)

    return run(*bands)


def optical(red: Column, green: Column, blue: Column, gain: float = 1.3, gamma: float = 0.6, decoder: Callable = tiff, encoder: Callable = write_png) -> Column:
    """Three bands of reflectance to a colour picture, each as `raster.optical_thumbnail`."""
    def pixels(*bands: np.ndarray) -> np.ndarray:
        return (255 * np.clip(gain * (np.maximum(np.stack(bands, -1), 0) / 10_000) ** gamma, 0, 1)).astype(np.uint8)

    return _file([red, green, blue], pixels, decoder, encoder)


def radar(vv: Column, vh: Column, nodata: float = raster.NODATA, decoder: Callable = tiff, encoder: Callable = write_png) -> Column:
    """Two bands of backscatter to a colour picture, as `raster.radar_thumbnail`."""
    return _file([vv, vh], lambda a, b: raster.radar_pixels(a, b, nodata), decoder, encoder)


def elevation(dem: Column, decoder: Callable = tiff, encoder: Callable = write_png) -> Column:
    """Heights to a hill-shaded picture of one channel."""
    return _file([dem], lambda d: (255 * shade(d)).astype(np.uint8)[..., None], decoder, encoder)

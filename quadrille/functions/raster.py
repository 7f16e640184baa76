"""Pixel expressions over rasters held as flat row-major arrays: normalisers, thumbnails, statistics, resampling."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.binding import let

# Mean and standard deviation of the two radar bands in decibels.
S1_MEAN = {"vv": -12.54847273, "vh": -20.19237134}
S1_STD = {"vv": 5.25697717, "vh": 5.91150917}
NODATA = -32768.0


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def true_colour(band: Column) -> Column:
    """Optical reflectance to 0..1 for display: clip(2.5 x / 10000, 0, 1)."""
    return F.transform(band, lambda x: clipped(2.5 * x / 1e4, 0.0, 1.0))


def reflectance(band: Column) -> Column:
    return F.transform(band, lambda x: x / 1e4)


def decibels(band: Column) -> Column:
    return F.transform(band, lambda x: 10 * F.log10(F.greatest(x, F.lit(1e-10))))


def s1_normalised(band_db: Column, band: str, scale: float = 1.0) -> Column:
    """Decibels to 0..scale over two standard deviations around the band's mean."""
    low, span = S1_MEAN[band] - 2 * S1_STD[band], 4 * S1_STD[band]
    return F.transform(band_db, lambda x: clipped((x - F.lit(low)) / F.lit(span) * scale, 0.0, scale))


def display_scaled(band: Column, scaling: float = 2e3) -> Column:
    return F.transform(band, lambda x: x / scaling)


def optical_thumbnail(band: Column, gain: float = 1.3, gamma: float = 0.6) -> Column:
    """uint8 of 255 clip(gain (x/10000)^gamma, 0, 1), cut off, not rounded."""
    return F.transform(band, lambda x: F.floor(255 * clipped(gain * F.pow(F.greatest(x, F.lit(0.0)) / 10000, F.lit(gamma)), 0.0, 1.0)).cast("int"))


def _between(values: Column, low: Column, high: Column) -> Column:
    return F.transform(values, lambda x: F.when(high > low, 255 * (x - low) / (high - low)).otherwise(F.lit(0.0)))


def _span(values: Column) -> Column:
    return F.struct(F.array_min(values).alias("low"), F.array_max(values).alias("high"))


def stretched(values: Column, valid: Column | None = None) -> Column:
    """Min-max stretch to 0..255 over the valid values (all by default); a constant raster gives 0."""
    return let(values, lambda v: let(_span(v if valid is None else valid), lambda s: _between(v, s["low"], s["high"])))


def grayscale(dem: Column) -> Column:
    """Elevation to uint8 shades between its least and greatest value."""
    return F.transform(stretched(dem), lambda x: F.floor(x).cast("int"))


def radar_pixels(vv: np.ndarray, vh: np.ndarray, nodata: float = NODATA) -> np.ndarray:
    """Two radar bands to r, g, b of uint8 in a last axis: red vv, blue vh, green their sum over its maximum.

    In each band negatives become the least non-negative value, then decibels and min-max over valid pixels; pixels without
    data are 0. Zero and unknown (NaN) pixels have no logarithm: they count as the floor of the decibel scale. Logarithms are
    the C library's, as in SQL engines: others differ in the last bit of some, which decides whether the brightest
    pixel is cut off to 255 or to 254.
    """
    def channel(x: np.ndarray) -> np.ndarray:
        valid = x != nodata
        least = x[x >= 0].min(initial=np.inf)
        power = np.where(np.isnan(x), 1e-10, np.maximum(np.where(x < 0, least if least < np.inf else 1e-10, x), 1e-10))
        db = 10 * np.array([math.log10(p) for p in power.ravel().tolist()]).reshape(x.shape)
        low, high = db[valid].min(initial=np.inf), db[valid].max(initial=-np.inf)
        return np.where(valid, 255 * (db - low) / (high - low), 0.0) if low < high < np.inf else np.zeros_like(x)

    r, b = channel(vv), channel(vh)
    top = (r + b).max(initial=0)
    return np.stack([r, 255 * (r + b) / top if top > 0 else np.zeros_like(r), b], -1).astype(np.uint8)


def radar_thumbnail(vv: Column, vh: Column, nodata: float = NODATA) -> Column:
    """Pixels as struct<r,g,b> of uint8, by `radar_pixels`; null if a band is. Bands of one row have one size."""
    names = ["r", "g", "b"]

    @F.arrow_udf("array<struct<r:int,g:int,b:int>>")
    def run(first: pa.Array, second: pa.Array) -> pa.Array:
        bands = [(a.to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)) for a in (first, second)]
        known = pc.and_(first.is_valid(), second.is_valid()).to_numpy(zero_copy_only=False)
        sizes = np.where(known, bands[0][1], 0)
        shades = [radar_pixels(np.asarray(a, np.float64), np.asarray(b, np.float64), nodata) for a, b, k in zip(bands[0][0], bands[1][0], known) if k]
        flat = np.concatenate([np.zeros((0, 3), np.uint8), *shades]).astype(np.int32)
        pixels = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pixels, mask=pa.array(~known))

    return run(vv.cast("array<double>"), vh.cast("array<double>"))


def dequantised(values: Column) -> Column:
    """Signed bytes of a quantised embedding to floats: (x / 127.5)^2 with the sign of x."""
    return F.transform(values, lambda x: F.pow(x / 127.5, F.lit(2.0)) * F.signum(x.cast("double")))


def resampled(band: Column, height: Column | int, width: Column | int, to_height: int, to_width: int) -> Column:
    """Nearest neighbour to another size: target pixel i takes source pixel floor(i * source / target)."""
    h, w = (x if isinstance(x, Column) else F.lit(x) for x in (height, width))
    places = F.sequence(F.lit(0), F.lit(to_height * to_width - 1))
    source = lambda i: (F.floor(F.floor(i / to_width) * h / to_height) * w + F.floor(i % to_width * w / to_width)).cast("int")
    return let(band, lambda v: F.transform(places, lambda i: F.get(v, source(i))))


def flipped(band: Column, height: int, width: int) -> Column:
    """Rows in reverse order (bottom-up rasters)."""
    return let(band, lambda v: F.flatten(F.transform(F.sequence(F.lit(height - 1), F.lit(0), F.lit(-1)), lambda r: F.slice(v, r * width + 1, width))))


def cropped(band: Column, width: Column | int, top: Column, left: Column, rows: Column, cols: Column) -> Column:
    """The window of rows x cols pixels from (top, left)."""
    return let(band, lambda v: F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.slice(v, (top + r) * width + left + 1, cols))))


def pixel_window(left: Column, bottom: Column, right: Column, top: Column, height: Column, width: Column, box: dict[str, Column], y_up: bool = False) -> dict[str, Column]:
    """row, col, rows, cols of the pixels within map bounds (left, bottom, right, top), cut off at the raster's edges.

    `y_up`: the file's first row is its southernmost; counted from there.
    """
    dx, dy = (right - left) / width, (top - bottom) / height
    edge = lambda x, most: F.greatest(F.lit(0), F.least(F.rint(x).cast("int"), most))
    low, high = (box["bottom"] - bottom, box["top"] - bottom) if y_up else (top - box["top"], top - box["bottom"])
    row, end = edge(low / dy, height), edge(high / dy, height)
    col, stop = edge((box["left"] - left) / dx, width), edge((box["right"] - left) / dx, width)
    return {"row": row, "col": col, "rows": end - row, "cols": stop - col}


def read_window(raster: Column, box: dict[str, Column], y_up: bool = False) -> Column:
    """The part of a raster struct (sources/images.py) within map bounds, north up, with its own bounds; null if there is none."""
    def part(r: Column, w: Column) -> Column:
        dx, dy = (r["right"] - r["left"]) / r["width"], (r["top"] - r["bottom"]) / r["height"]
        rows = F.sequence(w["row"] + w["rows"] - 1, w["row"], F.lit(-1)) if y_up else F.sequence(w["row"], w["row"] + w["rows"] - 1)
        data = F.flatten(F.transform(rows, lambda k: F.slice(r["data"], k * r["width"] + w["col"] + 1, w["cols"])))
        bottom = r["bottom"] + w["row"] * dy if y_up else r["top"] - (w["row"] + w["rows"]) * dy
        west = r["left"] + w["col"] * dx
        fields = {"height": w["rows"], "width": w["cols"], "left": west, "bottom": bottom, "right": west + w["cols"] * dx, "top": bottom + w["rows"] * dy, "data": data}
        return F.when((w["rows"] > 0) & (w["cols"] > 0), F.struct(*[c.alias(n) for n, c in fields.items()]))

    def window(r: Column) -> Column:
        found = pixel_window(r["left"], r["bottom"], r["right"], r["top"], r["height"], r["width"], box, y_up)
        return F.struct(*[c.alias(n) for n, c in found.items()])

    return let(raster, lambda r: let(window(r), lambda w: part(r, w)))


def dem_thumbnail(dem: Column, height: int, width: int, shaded: bool = True) -> Column:
    """Elevation to uint8 shades: hillshade, or grayscale."""
    from quadrille.operators.hillshade import hillshade

    return hillshade(dem, height, width) if shaded else grayscale(dem)

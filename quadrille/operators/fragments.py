"""Fragments of a square image with an overlap that fits: offsets, pixel boxes and footprints in closed form."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geo import affine_x, affine_y


@dataclass(frozen=True)
class FragmentPlan:
    """Fragments of `size` pixels over an image of `height` pixels with about `overlap` (a share of the size) in common.

    The overlap is adjusted so that fragments spread evenly; it may be negative (gaps). What a last whole stride would
    leave at the border is covered by shifting the last fragment inwards.
    """

    height: int
    size: int
    overlap: float = 0.1
    border_shift: bool = True

    def __post_init__(self):
        if self.height < self.size:
            raise ValueError("the image is smaller than a fragment")

    @property
    def segments(self) -> int:
        return 0 if self.height == self.size else max(1, round((self.height - self.size) / (self.size - self.overlap * self.size)))

    @property
    def overlap_pixels(self) -> int:
        return 0 if not self.segments else math.ceil(self.size - (self.height - self.size) / self.segments)

    @property
    def stride(self) -> int:
        return self.size - self.overlap_pixels

    @property
    def offsets(self) -> list[int]:
        out = [i * self.stride for i in range(self.segments + 1)]
        if self.border_shift and out[-1] < self.height - self.size:
            out[-1] = self.height - self.size
        return out


def with_fragments(df: DataFrame, plan: FragmentPlan, transposed: bool = True) -> DataFrame:
    """One row a fragment: frag_row, frag_col, y_offset, x_offset, pixel_bbox [x0, y0, x1, y1].

    `transposed` keeps the customary boxes, whose x comes from the row offset and y from the column offset.
    """
    offsets = F.array(*map(F.lit, plan.offsets))
    out = df.select("*", F.posexplode(offsets).alias("frag_row", "y_offset"))
    out = out.select("*", F.posexplode(offsets).alias("frag_col", "x_offset"))
    x, y = (F.col("y_offset"), F.col("x_offset")) if transposed else (F.col("x_offset"), F.col("y_offset"))
    return out.withColumn("pixel_bbox", F.array(x, y, x + plan.size, y + plan.size))


def unfolded(df: DataFrame, bands: list[str], height: int, width: int, window: tuple[int, int], stride: tuple[int, int]) -> DataFrame:
    """One row for each window of `window` (height, width) at every `stride` (down, across) that lies wholly inside the image:
    frag_row, frag_col and `pixels`, the window's pixels of all bands, band after band and row after row.

    Bands are arrays of height x width pixels; a window of a null band is null. An image smaller than a window has none.
    """
    (h, w), (down, across) = window, stride
    if min(h, w, down, across) < 1:
        raise ValueError("windows and strides count from one pixel")
    out = df.select("*", F.explode(F.expr(f"if({height} < {h}, array(), sequence(0, {max(height - h, 0) // down}))")).alias("frag_row"))
    out = out.select("*", F.explode(F.expr(f"if({width} < {w}, array(), sequence(0, {max(width - w, 0) // across}))")).alias("frag_col"))
    at = F.col("frag_row") * down * width + F.col("frag_col") * across + 1

    def lines(band: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda r: F.slice(F.col(band), at + r * width, w))

    return out.withColumn("pixels", F.flatten(F.concat(*map(lines, bands))))


def crop_footprint(left: Column, bottom: Column, right: Column, top: Column, height: int, width: int, bbox: Column) -> dict[str, Column]:
    """The map box of a pixel box [x0, y0, x1, y1] within a raster's footprint."""
    w, h = F.lit(width), F.lit(height)
    return {
        "left": affine_x(left, right, w, bbox[0]), "bottom": affine_y(bottom, top, h, bbox[3]),
        "right": affine_x(left, right, w, bbox[2]), "top": affine_y(bottom, top, h, bbox[1]),
    }

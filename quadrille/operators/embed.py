"""From images to one embedding row for each fragment, by any model with `bands`, `size` and a call on a batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.fragments import FragmentPlan
from quadrille.operators.metadata import with_metadata


class EmbeddingModel(Protocol):
    """`bands`: names of the input columns; `size`: (height, width) of a fragment; called on (n, bands, height, width)."""

    bands: list[str]
    size: tuple[int, int]

    def __call__(self, batch: np.ndarray) -> np.ndarray: ...


@dataclass
class LoadedModel:
    """A model that a partition loads once, when its first image comes: `load` runs in the task, so only it has to be sent there."""

    bands: list[str]
    size: tuple[int, int]
    load: Callable[[], Callable[[np.ndarray], np.ndarray]]


class BandStatistics:
    """A model without weights: mean, standard deviation and gradients of each band. For tests and dry runs."""

    def __init__(self, bands: list[str], size: int):
        self.bands, self.size = bands, (size, size)

    def __call__(self, batch: np.ndarray) -> np.ndarray:
        parts = [batch.mean((2, 3)), batch.std((2, 3)), np.abs(np.diff(batch, axis=2)).mean((2, 3)), np.abs(np.diff(batch, axis=3)).mean((2, 3))]
        return np.concatenate(parts, 1).astype(np.float32)


EMBEDDINGS = (
    "unique_id string, embedding array<float>, timestamp timestamp_ntz, product_id string, grid_cell string, grid_row_u smallint, grid_col_r smallint, "
    "geometry string, centre_lat float, centre_lon float, utm_footprint string, utm_crs string, pixel_bbox array<int>"
)


def _stacked(r: dict, bands: list[str]) -> np.ndarray | None:
    """Bands of an image at the size of the finest, bands first; None if one is missing."""
    if any(r[b] is None for b in bands):
        return None
    side = max(int(r[f"{b}_size"]) for b in bands)
    out = np.empty((len(bands), side, side), np.float32)
    for k, b in enumerate(bands):
        n = int(r[f"{b}_size"])
        at = np.arange(side) * n // side
        out[k] = np.asarray(r[b], np.float32).reshape(n, n)[np.ix_(at, at)]
    return out


def embed(images: DataFrame, model: EmbeddingModel | LoadedModel, overlap: float = 0.1, transposed: bool = True, batch: int = 64) -> DataFrame:
    """One row for each fragment of each image.

    images: a flat row-major array for each band, with {band}_size pixels a side, grid_cell, grid_row_u, grid_col_r,
    product_id, timestamp, crs and the footprint left, bottom, right, top in metres of crs. Bands of lower resolution
    are brought to that of the finest by nearest neighbour. Images stream through in Arrow batches; an image that
    lacks a band gives no rows.

    The model sees `batch` fragments a call, gathered across images; only the last call of a partition has fewer. A task
    holds one image and one batch of fragments beside the rows of an Arrow batch.
    """
    from quadrille.functions.geo_numpy import ring_centroid, tm_inverse

    (f, _), columns = model.size, [c.split()[0] for c in EMBEDDINGS.split(", ")]

    def row(r: dict, side: int, y: int, x: int, e: np.ndarray) -> tuple:
        zone, south = int(str(r["crs"])[-2:]), str(r["crs"])[-3:-2] == "7"
        px, py = (y, x) if transposed else (x, y)
        left, right = (r["left"] + p * (r["right"] - r["left"]) / side for p in (px, px + f))
        top, bottom = (r["top"] - p * (r["top"] - r["bottom"]) / side for p in (py, py + f))
        ring = [(right, bottom), (right, top), (left, top), (left, bottom), (right, bottom)]
        globe = [tm_inverse(a, b, zone, south)[::-1] for a, b in ring]
        wkt = lambda pts, d: "POLYGON ((" + ", ".join(f"{a:.{d}f} {b:.{d}f}" for a, b in pts) + "))"
        shape = wkt(globe, 6)
        lon, lat = ring_centroid(globe)
        shown = " ".join(f"{v:.6f}" for v in e.tolist())
        digest = hashlib.sha256(f"{shape}_{r['timestamp']}_{r['product_id']}_[{shown}]".encode()).hexdigest()
        return (digest, e.tolist(), r["timestamp"], r["product_id"], r["grid_cell"], r["grid_row_u"], r["grid_col_r"], shape, lat, lon, wkt(ring, 3), r["crs"], [px, py, px + f, py + f])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, held, places, n = None, None, [], 0

        def settled() -> pd.DataFrame:
            return pd.DataFrame([row(*place, e) for place, e in zip(places, net(held[:n]))], columns=columns)

        for pdf in batches:
            for i in range(len(pdf)):
                r = {c: pdf[c].iat[i] for c in pdf.columns}
                image = _stacked(r, model.bands)
                if image is None:
                    continue
                if net is None:
                    net = model.load() if isinstance(model, LoadedModel) else model
                    held = np.empty((batch, len(model.bands), f, f), np.float32)
                known, side = {c: v for c, v in r.items() if c not in model.bands}, image.shape[1]
                offsets = FragmentPlan(side, f, overlap).offsets
                for y in offsets:
                    for x in offsets:
                        held[n] = image[:, y : y + f, x : x + f]
                        places.append((known, side, y, x))
                        n += 1
                        if n == batch:
                            yield settled()
                            held, places, n = np.empty_like(held), [], 0
        if n:
            yield settled()

    needed = [*model.bands, *[f"{b}_size" for b in model.bands], "grid_cell", "grid_row_u", "grid_col_r", "product_id", "timestamp", "crs", "left", "bottom", "right", "top"]
    return images.select(*map(F.col, needed)).mapInPandas(run, EMBEDDINGS)


def embed_archive(images: DataFrame, meta: DataFrame, model: EmbeddingModel | LoadedModel, path: str, overlap: float = 0.1) -> None:
    """Images of an archive (decoded bands, grid_cell, product_id) with their first metadata row, embedded and written to `path`."""
    keys = ["grid_cell", "product_id"]
    own = images.drop(*[c for c in meta.columns if c not in keys])
    embed(with_metadata(own, meta), model, overlap).write.mode("overwrite").parquet(path)

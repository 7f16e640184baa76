"""Queries that have no SQL, held over whole tables against plain versions."""

import math

import numpy as np
import pytest

from quadrille.operators.fragments import FragmentPlan
from quadrille.plans import queries as plans

QUERIES = plans.queries()


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    return {r.vec_id: np.array(r.embedding, np.float64) for r in rows}


def slope(line: list[float], i: int) -> float:
    """Difference quotient at i: between the two neighbours, and one-sided at the ends."""
    a, b = max(i - 1, 0), min(i + 1, len(line) - 1)
    return (line[b] - line[a]) / (b - a)


def lit(dem: list[list[float]]) -> list[float]:
    """The light on each pixel from the north-west, 45 degrees up, stretched to 0..255."""
    sun = (math.cos(math.radians(135)) * math.cos(math.radians(45)), math.sin(math.radians(135)) * math.cos(math.radians(45)), math.sin(math.radians(45)))
    out = []
    for y in range(8):
        for x in range(8):
            east, south = slope(dem[y], x), slope([row[x] for row in dem], y)
            out.append((-east * sun[0] + south * sun[1] + sun[2]) / math.sqrt(east**2 + south**2 + 1))
    return [255 * (v - min(out)) / (max(out) - min(out)) for v in out]


def test_hillshade(spark, sf_dir, vectors):
    found = {r.vec_id: r.shades for r in QUERIES["dem_hillshade"](spark, sf_dir).collect()}
    assert found.keys() == vectors.keys()
    for k, shades in found.items():
        assert np.abs(np.array(shades) - np.array(lit((vectors[k] * 1000).reshape(8, 8).tolist()))).max() <= 1


def test_components_of_the_table(spark, sf_dir, vectors):
    found = {r.vec_id: (r.r, r.g, r.b) for r in QUERIES["pca_composite"](spark, sf_dir).collect()}
    assert found.keys() == vectors.keys()
    ids = sorted(vectors)
    x = np.stack([vectors[k] for k in ids])
    pc = (x - x.mean(0)) @ np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:3].T
    own, got = 255 * (pc - pc.min(0)) / np.ptp(pc, axis=0), np.array([found[k] for k in ids])
    for k in range(3):  # a component is free in sign
        assert min(np.abs(got[:, k] - own[:, k]).max(), np.abs(got[:, k] - (255 - own[:, k])).max()) <= 1.01


def test_embedded_fragments(spark, sf_dir, vectors):
    offsets = FragmentPlan(8, 4, 0.1).offsets
    found = {(int(r.product_id[1:]), *r.pixel_bbox): r.embedding for r in QUERIES["embedded_fragments"](spark, sf_dir).collect()}
    assert found.keys() == {(k, y, x, y + 4, x + 4) for k in vectors for y in offsets for x in offsets}
    for (k, y, x, _, _), embedding in found.items():
        fine, coarse = (vectors[k] * 10000).reshape(8, 8), (vectors[k][:16] * 10000).reshape(4, 4)
        bands = [[[fine[y + i][x + j] for j in range(4)] for i in range(4)], [[coarse[(y + i) // 2][(x + j) // 2] for j in range(4)] for i in range(4)]]
        want = [np.mean(b) for b in bands] + [np.std(b) for b in bands]
        want += [np.mean([abs(b[i + 1][j] - b[i][j]) for i in range(3) for j in range(4)]) for b in bands] + [np.mean([abs(b[i][j + 1] - b[i][j]) for i in range(4) for j in range(3)]) for b in bands]
        assert np.allclose(embedding, want, rtol=1e-4, atol=1e-2)

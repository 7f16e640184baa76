"""Inverse transverse Mercator and ring centroids on numbers, for code that already runs in Python; same series as in `geo`."""

from __future__ import annotations

import math

from quadrille.functions.geo import BETA, DELTA, EASTING, NORTHING_SOUTH, RADIUS, SCALE


def tm_inverse(east: float, north: float, zone: int, south: bool) -> tuple[float, float]:
    """Latitude and longitude in degrees."""
    xi, eta = (north - (NORTHING_SOUTH if south else 0.0)) / (SCALE * RADIUS), (east - EASTING) / (SCALE * RADIUS)
    xi1 = xi - sum(b * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, b in enumerate(BETA, 1))
    eta1 = eta - sum(b * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, b in enumerate(BETA, 1))
    chi = math.asin(math.sin(xi1) / math.cosh(eta1))
    lat = chi + sum(d * math.sin(2 * j * chi) for j, d in enumerate(DELTA, 1))
    return math.degrees(lat), 6 * zone - 183 + math.degrees(math.atan2(math.sinh(eta1), math.cos(xi1)))


def ring_centroid(ring: list[tuple[float, float]]) -> tuple[float, float]:
    """Centroid (x, y) of the area of a closed ring, summed around its first point; a flat ring's is the mean of its points."""
    x0, y0 = ring[0]
    parts = [((a - x0) * (d - y0) - (c - x0) * (b - y0), a + c - 2 * x0, b + d - 2 * y0) for (a, b), (c, d) in zip(ring, ring[1:])]
    area = sum(w for w, _, _ in parts)
    if not area:
        return sum(p[0] for p in ring) / len(ring), sum(p[1] for p in ring) / len(ring)
    return x0 + sum(w * x for w, x, _ in parts) / (3 * area), y0 + sum(w * y for w, _, y in parts) / (3 * area)

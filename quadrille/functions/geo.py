"""Geographic column expressions: UTM zones, transverse Mercator, boxes, polygons and their text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.binding import let

# Fixed values of the ellipsoid (WGS 84) and of the projection (UTM).
A_AXIS, FLATTENING, SCALE, EASTING, NORTHING_SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
N3 = FLATTENING / (2 - FLATTENING)
RADIUS = A_AXIS / (1 + N3) * (1 + N3**2 / 4 + N3**4 / 64)
# Krüger's series in the third flattening, to its fourth power.
ALPHA = (N3 / 2 - 2 * N3**2 / 3 + 5 * N3**3 / 16 + 41 * N3**4 / 180, 13 * N3**2 / 48 - 3 * N3**3 / 5 + 557 * N3**4 / 1440, 61 * N3**3 / 240 - 103 * N3**4 / 140, 49561 * N3**4 / 161280)
BETA = (N3 / 2 - 2 * N3**2 / 3 + 37 * N3**3 / 96 - N3**4 / 360, N3**2 / 48 + N3**3 / 15 - 437 * N3**4 / 1440, 17 * N3**3 / 480 - 37 * N3**4 / 840, 4397 * N3**4 / 161280)
DELTA = (2 * N3 - 2 * N3**2 / 3 - 2 * N3**3 + 116 * N3**4 / 45, 7 * N3**2 / 3 - 8 * N3**3 / 5 - 227 * N3**4 / 45, 56 * N3**3 / 15 - 136 * N3**4 / 35, 4279 * N3**4 / 630)


def utm_zone(lat: Column, lon: Column) -> Column:
    """UTM zone number, with the exceptions of western Norway and Svalbard; longitudes wrap round, NaN gives null."""
    plain = F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    svalbard = (lat >= 72) & (lat < 84)
    zone = (
        F.when(norway, 32)
        .when(svalbard & (lon >= 0) & (lon < 9), 31)
        .when(svalbard & (lon >= 9) & (lon < 21), 33)
        .when(svalbard & (lon >= 21) & (lon < 33), 35)
        .when(svalbard & (lon >= 33) & (lon < 42), 37)
        .otherwise(plain)
    )
    return F.when(~F.isnan(lat) & ~F.isnan(lon), zone.cast("int"))


def utm_epsg(lat: Column, lon: Column) -> Column:
    """`326zz` in the north, `327zz` in the south."""
    return F.concat(F.when(lat < 0, "327").otherwise("326"), F.lpad(utm_zone(lat, lon).cast("string"), 2, "0"))


def tm_forward(lat: Column, lon: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing in metres; null at the poles."""
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    c = 2 * math.sqrt(N3) / (1 + N3)
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    sound = F.abs(lat) < 90
    return F.when(sound, EASTING + SCALE * RADIUS * east), F.when(sound, F.when(south, NORTHING_SOUTH).otherwise(0.0) + SCALE * RADIUS * north)


def tm_inverse(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    xi = (north - F.when(south, NORTHING_SOUTH).otherwise(0.0)) / (SCALE * RADIUS)
    eta = (east - EASTING) / (SCALE * RADIUS)
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), (6 * zone - 183) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))


def product_window(east: Column, north: Column, dist_km: float = 10.0, box: float = 10680.0) -> dict[str, Column]:
    """The square of `box` metres around a cell whose bottom left corner is given in UTM metres."""
    margin = (box - dist_km * 1000) / 2
    return {"left": east - margin, "bottom": north - margin, "right": east - margin + box, "top": north - margin + box}


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Within minx, miny, maxx, maxy, the edges included."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def ring_edges(ring: Column) -> Column:
    """west and south of a ring's box, and its edges (a to b) counted from that corner: what `within` takes; null for a null ring."""
    n = F.size(ring)
    corner = F.struct(F.array_min(F.transform(ring, lambda p: p.x)).alias("west"), F.array_min(F.transform(ring, lambda p: p.y)).alias("south"))

    def edges(o: Column) -> Column:
        local = lambda p: F.struct((p.x - o.west).alias("x"), (p.y - o.south).alias("y"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(local(F.get(ring, i)).alias("a"), local(F.get(ring, (i + 1) % n)).alias("b")))

    return F.when(n > 0, let(corner, lambda o: F.struct(o.west.alias("west"), o.south.alias("south"), edges(o).alias("edges"))))


def within(x: Column, y: Column, own: Column) -> Column:
    """Strictly inside the ring of `ring_edges`; the boundary is outside.

    Counts the edges that a ray to the right crosses. On which side of an edge the point lies is told by the sign of a cross
    product of differences from the corner of the ring's box: a quotient's rounding would move points that lie on a
    slanting edge off it.
    """
    def inside(p: Column) -> Column:
        cross = lambda e: (e.b.x - e.a.x) * (p.y - e.a.y) - (e.b.y - e.a.y) * (p.x - e.a.x)
        crossed = F.filter(own.edges, lambda e: ((e.a.y > p.y) != (e.b.y > p.y)) & ((cross(e) > 0) == (e.b.y > e.a.y)))
        beside = lambda e: p.x.between(F.least(e.a.x, e.b.x), F.greatest(e.a.x, e.b.x)) & p.y.between(F.least(e.a.y, e.b.y), F.greatest(e.a.y, e.b.y))
        return (F.size(crossed) % 2 == 1) & ~F.exists(own.edges, lambda e: beside(e) & (cross(e) == 0))

    return F.coalesce(let(F.struct((x - own.west).alias("x"), (y - own.south).alias("y")), inside), F.lit(False))


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Strictly inside a ring, array<struct<x,y>> with or without the closing point; see `within`."""
    return let(ring_edges(ring), lambda own: within(x, y, own))


def ring_centroid(ring: Column) -> Column:
    """Centroid of the area of a ring as struct<x,y>."""
    n = F.size(ring)
    parts = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            (F.get(ring, i).x * F.get(ring, (i + 1) % n).y - F.get(ring, (i + 1) % n).x * F.get(ring, i).y).alias("w"),
            (F.get(ring, i).x + F.get(ring, (i + 1) % n).x).alias("x"), (F.get(ring, i).y + F.get(ring, (i + 1) % n).y).alias("y"),
        ),
    )
    total = lambda f: F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + f(p))
    area = total(lambda p: p.w)
    return F.struct((total(lambda p: p.w * p.x) / (3 * area)).alias("x"), (total(lambda p: p.w * p.y) / (3 * area)).alias("y"))


def box_ring(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """The closed ring of a box, beginning bottom right and going round by the top, as box constructors do."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(right, bottom), corner(right, top), corner(left, top), corner(left, bottom), corner(right, bottom))


def polygon_wkt(ring: Column, digits: int = 6) -> Column:
    """`POLYGON ((x y, ...))` with a fixed number of digits."""
    pattern = f"%.{digits}f %.{digits}f"
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(ring, lambda p: F.format_string(pattern, p.x, p.y)), ", "), F.lit("))"))


def point_wkt(x: Column, y: Column, digits: int = 6) -> Column:
    return F.format_string(f"POINT (%.{digits}f %.{digits}f)", x, y)


def affine_x(left: Column, right: Column, width: Column, col: Column) -> Column:
    """Map x of a pixel column's left edge."""
    return left + col * (right - left) / width


def affine_y(bottom: Column, top: Column, height: Column, row: Column) -> Column:
    """Map y of a pixel row's upper edge."""
    return top - row * (top - bottom) / height

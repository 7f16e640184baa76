"""DuckDB SQL that the registered queries are held against; written with other algorithms than the queries where
there is one (a generated grid and as-of joins in place of closed forms, all pairs in place of hashed bins)."""

from __future__ import annotations

import math

from quadrille.functions import geo
from quadrille.plans.views import EUROPE, META_SQL, POINTS_SQL


def grid_sql(dist: float, low: float = -85, high: float = 85) -> str:
    """CTEs gr (row_idx, k, lat, m) and gc (k, c, lon, col_idx): the grid as a table."""
    n = math.ceil(math.pi * 6378.137 / dist)
    return f"""gl AS (SELECT i, CASE WHEN v < 0 THEN v + 180.0 ELSE v END - 90.0 AS lat FROM (SELECT i, i * (180.0::DOUBLE / {n}) - 90.0::DOUBLE AS v FROM range({n}) t(i))),
gz AS (SELECT lat, row_number() OVER (ORDER BY lat) - 1 - (SELECT count(*) FROM gl WHERE lat < 0) AS k FROM gl),
gr AS (SELECT row_number() OVER (ORDER BY lat) - 1 AS row_idx, k, lat, CAST(ceil((2 * pi()) * (6378.137::DOUBLE * cos(lat * pi() / 180)) / {float(dist)!r}::DOUBLE) AS BIGINT) AS m FROM gz WHERE lat BETWEEN {low} AND {high}),
gv AS (SELECT k, m, j * (360.0::DOUBLE / m) - 180.0::DOUBLE AS v FROM gr, unnest(range(m)) t(j)),
go AS (SELECT k, CASE WHEN v < 0 THEN v + 360.0 ELSE v END - 180.0 AS lon FROM gv),
gn AS (SELECT k, count(*) FILTER (lon < 0) AS west FROM go GROUP BY k),
gc AS (SELECT k, lon, row_number() OVER (PARTITION BY k ORDER BY lon) - 1 AS col_idx, row_number() OVER (PARTITION BY k ORDER BY lon) - 1 - west AS c FROM go JOIN gn USING (k))"""


def name(k: str = "k", c: str = "c") -> str:
    return f"abs({k}) || CASE WHEN {k} >= 0 THEN 'U' ELSE 'D' END || '_' || abs({c}) || CASE WHEN {c} >= 0 THEN 'R' ELSE 'L' END"


def located(source: str, lat: str = "centre_lat", lon: str = "centre_lon") -> str:
    """CTE loc: the source's rows with k, c, row_idx, col_idx by as-of joins (`>` is strict, as the lookup is)."""
    return f"""lr AS (SELECT s.*, coalesce(g.k, (SELECT max(k) FROM gr)) AS k, coalesce(g.row_idx, (SELECT max(row_idx) FROM gr)) AS row_idx FROM {source} s ASOF LEFT JOIN gr g ON s.{lat} > g.lat),
ll AS (SELECT k, max(c) AS c, max(col_idx) AS col_idx FROM gc GROUP BY k),
loc AS (SELECT lr.*, coalesce(g.c, ll.c) AS c, coalesce(g.col_idx, ll.col_idx) AS col_idx FROM lr ASOF LEFT JOIN gc g ON lr.k = g.k AND lr.{lon} > g.lon JOIN ll ON lr.k = ll.k)"""


META, POINTS = f"meta AS ({META_SQL})", f"pts AS ({POINTS_SQL})"
ZONE = """CASE WHEN {lat} >= 56 AND {lat} < 64 AND {lon} >= 3 AND {lon} < 12 THEN 32 WHEN {lat} >= 72 AND {lat} < 84 AND {lon} >= 0 AND {lon} < 42 THEN
  CASE WHEN {lon} < 9 THEN 31 WHEN {lon} < 21 THEN 33 WHEN {lon} < 33 THEN 35 ELSE 37 END ELSE CAST(floor(({lon} + 180) / 6) AS BIGINT) % 60 + 1 END"""
EPSG = "CASE WHEN {lat} < 0 THEN '327' ELSE '326' END || lpad(CAST(" + ZONE + " AS VARCHAR), 2, '0')"


def located_meta(dist: float, more: str = "") -> str:
    return f"WITH {META}, {grid_sql(dist)}, {located('meta')}{more}"


def sampled(dist: float) -> str:
    """CTEs n (k, c, samples) and nr (k, samples): how many samples of meta lie in a cell and in a row."""
    return located_meta(dist, ", n AS (SELECT k, c, count(*) AS samples FROM loc GROUP BY k, c), nr AS (SELECT k, count(*) AS samples FROM loc GROUP BY k)")


def filtered(region=EUROPE) -> str:
    return f"timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND centre_lon BETWEEN {region[0]} AND {region[2]} AND centre_lat BETWEEN {region[1]} AND {region[3]} AND cloud_cover BETWEEN 0 AND 60 AND nodata BETWEEN 0 AND 0.8"


def vec(expression: str, table: str = "embeddings") -> str:
    """SELECT over embeddings with v (double array)."""
    return f"WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM {table}) {expression}"


def pixels(scale: float = 10000.0, shift: float = 0.0) -> str:
    return f"WITH r AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * {scale!r}::DOUBLE + {shift!r}::DOUBLE) AS px FROM embeddings)"


def pixel_sums(px: str, scale: float = 10000.0, shift: float = 0.0) -> str:
    return f"{pixels(scale, shift)}, o AS (SELECT vec_id, {px} AS q FROM r) SELECT vec_id, round(list_sum(q), 5) AS total, round(q[1], 6) AS first_px, round(q[64], 6) AS last_px FROM o"


def tm_forward(lat: str, lon: str, zone: str, south: str) -> tuple[str, str]:
    c = 2 * math.sqrt(geo.N3) / (1 + geo.N3)
    t = f"sinh(atanh(sin(radians({lat}))) - {c!r} * atanh({c!r} * sin(radians({lat}))))"
    lam = f"radians({lon} - (6 * ({zone}) - 183))"
    return f"{t} AS t, {lam} AS lam", f"CASE WHEN {south} THEN 10000000.0 ELSE 0.0 END AS n0"


SERIES_EAST = " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geo.ALPHA, 1))
SERIES_NORTH = " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geo.ALPHA, 1))


def utm(source: str, lat: str = "centre_lat", lon: str = "centre_lon", keep: str = "event_id") -> str:
    """CTE utm (keep, zone, east, north)."""
    zone = ZONE.format(lat=lat, lon=lon)
    first, second = tm_forward(lat, lon, zone, f"{lat} < 0")
    k = geo.SCALE * geo.RADIUS
    return f"""u0 AS (SELECT {keep}, {zone} AS zone, {first}, {second} FROM {source}),
u1 AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM u0),
utm AS (SELECT {keep}, zone, 500000.0 + {k!r} * (eta + {SERIES_EAST}) AS east, n0 + {k!r} * (xi + {SERIES_NORTH}) AS north FROM u1)"""


def tiles_sql() -> str:
    corners = ((2.5, 0), (7.5, 0), (10, 5), (7.5, 10), (2.5, 10), (0, 5))
    half_planes = " AND ".join(
        f"({bx - ax}) * (lat - y - ({ay})) - ({by - ay}) * (lon - x - ({ax})) > 0" for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1])
    )
    return f"""tiles AS (SELECT t AS tile_id, CAST(2023 + t // 648 AS INTEGER) AS year, 'tiles/' || t || '.tif' AS path, (t % 36)::DOUBLE * 10 - 180 AS x, (t % 648 // 36)::DOUBLE * 10 - 90 AS y FROM range(1296) r(t)),
hits AS (SELECT point_id, tile_id, path FROM pts, tiles WHERE year = 2024 AND lon > x AND lon < x + 10 AND lat > y AND lat < y + 10 AND {half_planes})"""


def fragments_sql(height: int, size: int, keep: str, source: str, overlap: float = 0.1) -> str:
    """CTE frag: the number of steps, the overlap that fits and the offsets, worked out in SQL from the two sizes."""
    axis = f"""(SELECT i, CASE WHEN i = steps AND i * stride < {height} - {size} THEN {height} - {size} ELSE i * stride END AS o
  FROM (SELECT steps, {size} - ceil({size} - ({height} - {size})::DOUBLE / steps) AS stride, unnest(range(CAST(steps AS BIGINT) + 1)) AS i
    FROM (SELECT greatest(1.0, round_even(({height} - {size}) / ({size} - {overlap} * {size})::DOUBLE, 0)) AS steps)))"""
    return f"frag AS (SELECT {keep}, CAST(a.i AS INTEGER) AS frag_row, CAST(b.i AS INTEGER) AS frag_col, CAST(a.o AS INTEGER) AS y_offset, CAST(b.o AS INTEGER) AS x_offset FROM {source} s, {axis} a, {axis} b)"

"""The quasi-equal-distance grid as closed-form column expressions; no grid table is ever needed for a lookup.

Rows are about `dist` km apart, and each row is cut into cells as near to `dist` as a whole number allows. Cells are
named `{row}_{col}`: rows nU (up from the equator) or nD, columns nR (right of Greenwich) or nL; as signed numbers U
and R count from 0, D and L from -1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.binding import let
from quadrille.functions.geo import utm_epsg

RADIUS_KM = 6378.137
METRES_PER_DEGREE = 111_120.0


@dataclass(frozen=True)
class GridSpec:
    """Distance in km, ranges of latitude and longitude, and where in a cell its UTM zone is taken.

    `wrap_rows`: points south of the lowest row go to the top row (and points north of it, too); else they get null.
    """

    dist: float
    latitude_range: tuple[float, float] = (-85.0, 85.0)
    longitude_range: tuple[float, float] = (-180.0, 180.0)
    utm_definition: str = "bottomleft"
    wrap_rows: bool = True

    def __post_init__(self):
        if self.utm_definition not in ("bottomleft", "center"):
            raise ValueError(f"utm_definition is bottomleft or center, not {self.utm_definition!r}")

    @property
    def n(self) -> int:
        return math.ceil(math.pi * RADIUS_KM / self.dist)

    @property
    def step(self) -> float:
        return 180.0 / self.n

    def latitude(self, k: int) -> float:
        v = (k + self.n if k < 0 else k) * self.step - 90.0
        return (v + 180.0 if v < 0 else v) - 90.0

    @property
    def rows(self) -> tuple[int, int]:
        """First and last signed row within the latitude range."""
        low, high = self.latitude_range
        within = [k for k in range(-(self.n // 2), (self.n + 1) // 2) if low <= self.latitude(k) <= high]
        return within[0], within[-1]


def row_label(k: Column) -> Column:
    return F.concat(F.abs(k).cast("string"), F.when(k >= 0, "U").otherwise("D"))


def col_label(c: Column) -> Column:
    return F.concat(F.abs(c).cast("string"), F.when(c >= 0, "R").otherwise("L"))


def cell_name(k: Column, c: Column) -> Column:
    """Signed row and column to `{row}_{col}`; null if either is."""
    return F.concat(row_label(k), F.lit("_"), col_label(c))


def signed(label: Column) -> Column:
    """A row or column label to its signed number."""
    number = F.regexp_extract(label, r"^(\d+)[UDRL]$", 1)
    return F.when(number != "", number.cast("int") * F.when(F.right(label, F.lit(1)).isin("U", "R"), 1).otherwise(-1))


def cell_ints(cell: Column) -> tuple[Column, Column]:
    """`{row}_{col}` to signed row and column; null if the name is none."""
    return signed(F.split_part(cell, F.lit("_"), F.lit(1))), signed(F.split_part(cell, F.lit("_"), F.lit(2)))


def row_latitude(k: Column, spec: GridSpec) -> Column:
    """Latitude of the row's lower edge."""
    v = F.pmod(k, F.lit(spec.n)) * F.lit(spec.step) - 90.0
    return v + F.when(v < 0, 180.0).otherwise(0.0) - 90.0


def cells_in_row(lat: Column, spec: GridSpec) -> Column:
    """Number of cells in the row at a latitude: the circle there over the distance, rounded up."""
    circle = F.lit(2 * math.pi) * (F.lit(RADIUS_KM) * F.cos(lat * math.pi / 180))
    return F.ceil(circle / F.lit(float(spec.dist)))


def col_longitude(c: Column, cells: Column) -> Column:
    """Longitude of a column's left edge in a row of so many cells."""
    v = F.pmod(c, cells) * (F.lit(360.0) / cells) - 180.0
    return v + F.when(v < 0, 360.0).otherwise(0.0) - 180.0


def first_col(cells: Column) -> Column:
    """The leftmost signed column of a row of so many cells; in a few even rows the -180 meridian falls on +180."""
    half = F.floor(cells / 2)
    return -half + F.when((cells % 2 == 0) & (half * (F.lit(360.0) / cells) - 180.0 < 0), 1).otherwise(0)


@lru_cache(maxsize=64)
def _row_tables(spec: GridSpec, gateway) -> tuple[Column, Column, Column]:
    low, high = spec.rows
    lat = np.array([spec.latitude(k) for k in range(low, high + 1)])
    cells = np.ceil(2 * math.pi * (RADIUS_KM * np.cos(lat * math.pi / 180)) / spec.dist).astype(np.int32)
    half = cells // 2
    left = -half + ((cells % 2 == 0) & (half * (360.0 / cells) - 180.0 < 0))
    return F.lit(lat), F.lit(cells), F.lit(left.astype(np.int32))


def row_tables(spec: GridSpec) -> tuple[Column, Column, Column]:
    """Latitude, number of cells and leftmost column of each row, from the lowest row on: literals of a few KB.

    A lookup names its row once, where the closed form would name it several times.
    """
    return _row_tables(spec, SparkContext._gateway)


def _corrected(guess: Column, edge, point: Column) -> Column:
    """The guess, moved by one where rounding put the point on the wrong side of an edge."""
    at = lambda k: F.coalesce(k, F.lit(False)).cast("int")
    return guess - at(edge(guess) >= point) + at(edge(guess + 1) < point)


def _place(y: Column, x: Column, spec: GridSpec) -> Column:
    """Signed row and column of a point, and the row's leftmost column, as struct<row,col,left>.

    Each step's value is bound once: a filter on a cell that Spark pushes below the lookup repeats the whole
    expression, and written out it would name the point's latitude thousands of times.
    """
    low, high = spec.rows
    lats, cells, lefts = row_tables(spec)

    def column(row: Column, m: Column, left: Column) -> Column:
        return let(F.ceil(x / (F.lit(360.0) / m)).cast("int") - 1, lambda c0: let(
            _corrected(c0, lambda c: col_longitude(c, m), x),
            lambda c: F.struct(row.alias("row"), F.when((c < left) | (c >= left + m), left + m - 1).otherwise(c).alias("col"), left.alias("left")),
        ))

    def in_row(row: Column) -> Column:
        return let(F.struct(F.get(cells, row - low).alias("m"), F.get(lefts, row - low).alias("left")), lambda r: column(row, r["m"], r["left"]))

    def of_row(row: Column) -> Column:
        return let(F.when(row.between(low, high), row).when(row.isNotNull(), F.lit(high if spec.wrap_rows else None)).cast("int"), in_row)

    sound = ~F.isnan(y) & ~F.isnan(x) & x.isNotNull()
    return let(F.when(sound, F.ceil(y / spec.step).cast("int") - 1), lambda r0: let(_corrected(r0, lambda k: F.get(lats, k - low), y), of_row))


def with_cell(df: DataFrame, lat: str, lon: str, spec: GridSpec, index: bool = False) -> DataFrame:
    """Adds grid_row_u, grid_col_r and grid_cell of the points; with `index` also row_idx and col_idx.

    A cell holds the points strictly above and right of its corner, so a point on a grid line belongs to the cell
    below or left. Null and NaN coordinates give null.
    """
    out = df.withColumn("_p", _place(F.col(lat), F.col(lon), spec))
    row, col = F.col("_p.row"), F.col("_p.col")
    added = {"grid_row_u": row, "grid_col_r": col, "grid_cell": cell_name(row, col)}
    if index:
        added |= {"row_idx": row - spec.rows[0], "col_idx": col - F.col("_p.left")}
    return out.withColumns(added).drop("_p")


def with_corner(df: DataFrame, spec: GridSpec, row: str = "grid_row_u", col: str = "grid_col_r") -> DataFrame:
    """Adds corner_lat and corner_lon of a cell (bottom left); null for cells that the grid doesn't have."""
    low, _ = spec.rows
    lats, cells, lefts = (F.get(table, F.col(row) - low) for table in row_tables(spec))
    c = F.col(col)
    out = df.withColumn("_m", cells).withColumn("_left", lefts).withColumn("_inside", c.between(F.col("_left"), F.col("_left") + F.col("_m") - 1))
    out = out.withColumn("corner_lat", F.when(F.col("_inside"), lats)).withColumn("corner_lon", F.when(F.col("_inside"), col_longitude(c, F.col("_m"))))
    return out.drop("_m", "_left", "_inside")


def with_footprint(df: DataFrame, spec: GridSpec, buffer_ratio: float = 0.0, row: str = "grid_row_u", col: str = "grid_col_r") -> DataFrame:
    """Adds left, bottom, right and top of the cells, widened by a share of their size on every side.

    The top row has the height of the row below it and the rightmost cell the width of its left neighbour; the one
    cell of a single-cell row has no width.
    """
    low, high = spec.rows
    out = with_corner(df, spec, row, col)
    k = F.col(row)
    below = F.when(k == high, k - 1).otherwise(k)
    out = out.withColumn("_m", cells_in_row(F.col("corner_lat"), spec))
    m, c = F.col("_m"), F.col(col)
    own = F.when(c == first_col(m) + m - 1, c - 1).otherwise(c)
    out = out.withColumn("_h", row_latitude(below + 1, spec) - row_latitude(below, spec)).withColumn("_w", F.when(m > 1, col_longitude(own + 1, m) - col_longitude(own, m)).otherwise(0.0))
    y, x, h, w = (F.col(n) for n in ("corner_lat", "corner_lon", "_h", "_w"))
    sides = {"left": x - buffer_ratio * w, "bottom": y - buffer_ratio * h, "right": x + w + buffer_ratio * w, "top": y + h + buffer_ratio * h}
    return out.select("*", *[e.alias(n) for n, e in sides.items()]).drop("_m", "_h", "_w")


def grid_rows(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """row_idx, k (signed), row, lat, cells for every row."""
    low, high = spec.rows
    rows = spark.range(low, high + 1).select(F.col("id").alias("k")).withColumn("lat", row_latitude(F.col("k"), spec))
    return rows.select((F.col("k") - low).cast("int").alias("row_idx"), F.col("k").cast("int").alias("k"), row_label(F.col("k")).alias("row"), "lat", cells_in_row(F.col("lat"), spec).alias("cells"))


def grid_points(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """All cells: name, row, col, row_idx, col_idx, utm_zone, epsg, lat, lon; generated in parallel, row by row."""
    rows = grid_rows(spark, spec).withColumn("_left", first_col(F.col("cells")))
    cells = rows.select("*", F.explode(F.sequence(F.col("_left"), F.col("_left") + F.col("cells") - 1)).alias("c")).withColumn("lon", col_longitude(F.col("c"), F.col("cells")))
    low, high = spec.longitude_range
    cells = cells.where(F.col("lon").between(low, high))
    skipped = F.size(F.filter(F.sequence(F.col("_left"), F.col("c")), lambda x: ~col_longitude(x, F.col("cells")).between(low, high))) if (low, high) != (-180.0, 180.0) else F.lit(0)
    y, x = F.col("lat"), F.col("lon")
    if spec.utm_definition == "center":
        half = 1000 * spec.dist / 2
        y = y + half / METRES_PER_DEGREE
        x = x + half / (METRES_PER_DEGREE * F.cos(y * math.pi / 180))
    zone = utm_epsg(y, x)
    return cells.select(
        cell_name(F.col("k"), F.col("c")).alias("name"), "row", col_label(F.col("c")).alias("col"), "row_idx",
        (F.col("c") - F.col("_left") - skipped).cast("int").alias("col_idx"), zone.alias("utm_zone"), F.concat(F.lit("EPSG:"), zone).alias("epsg"), "lat", "lon",
    )

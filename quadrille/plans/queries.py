"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quadrille.functions import geo, raster, text
from quadrille.functions import vectors as vx
from quadrille.functions.rounding import rounded
from quadrille.operators import composite, coverage, embed, fragments, grid, hillshade, metadata, vector_index
from quadrille.operators.grid import GridSpec
from quadrille.plans import oracles as o
from quadrille.plans import views
from quadrille.plans.views import EUROPE
from quadrille.sources import archive_rows as archives
from quadrille.sources import readers
from quadrille.sources.shared import shared_path

COARSE, MEDIUM, FINE = GridSpec(1000), GridSpec(100), GridSpec(10)
REGISTERED: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""
    def keep(f):
        REGISTERED[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def located(spark, sf_dir, spec=COARSE, index=False) -> DataFrame:
    return grid.with_cell(views.metadata(spark, sf_dir), "centre_lat", "centre_lon", spec, index)


def filtered(df: DataFrame) -> DataFrame:
    return metadata.filter_metadata(df, EUROPE, ("2024-01-05", "2024-01-25"), (0, 60), (0, 0.8))


# Metadata filters

@query(f"WITH {o.META} SELECT event_id, product_id, modality FROM meta WHERE {o.filtered()}")
def metadata_filter(spark, sf_dir):
    return filtered(views.metadata(spark, sf_dir)).select("event_id", "product_id", "modality")


@query(f"WITH {o.META} SELECT event_id FROM meta WHERE centre_lon BETWEEN -153.3922893485 AND -152.0423077748 AND centre_lat BETWEEN 39.6170415622 AND 40.7090892316 AND cloud_cover BETWEEN 0 AND 10 AND nodata BETWEEN 0 AND 0")
def metadata_filter_pacific(spark, sf_dir):
    return metadata.filter_metadata(views.metadata(spark, sf_dir), views.REGIONS["pacific"], None, (0, 10), (0.0, 0.0)).select("event_id")


@query(o.located_meta(1000) + f" SELECT {o.name()} AS grid_cell, count(*) AS samples FROM loc WHERE {o.filtered()} GROUP BY ALL")
def filtered_cell_counts(spark, sf_dir):
    found = grid.with_cell(filtered(views.metadata(spark, sf_dir)), "centre_lat", "centre_lon", COARSE)
    return found.groupBy("grid_cell").agg(F.count("*").alias("samples"))


@query(f"WITH {o.META} SELECT event_id FROM meta WHERE modality = 'view' AND parquet_row = 7")
def equality_filter(spark, sf_dir):
    return views.metadata(spark, sf_dir).where("modality = 'view' AND parquet_row = 7").select("event_id")


@query(f"WITH {o.META} SELECT event_id, (nodata <= 0.5) AS has_data FROM meta WHERE NOT (nodata > 0.5)")
def nodata_exclusion(spark, sf_dir):
    return views.metadata(spark, sf_dir).where(coverage.has_data()).select("event_id", (F.col("nodata") <= 0.5).alias("has_data"))


# Grid: every row or point, with the number of samples that lie in it

def sampled(df: DataFrame, spark, sf_dir, spec: GridSpec, cell: str | None = "name") -> DataFrame:
    """Adds `samples`: those of the cell that the column names, or of the row `k`."""
    of = F.col("grid_cell").alias(cell) if cell else F.col("grid_row_u").alias("k")
    counts = located(spark, sf_dir, spec).groupBy(of).agg(F.count("*").alias("samples"))
    return df.join(counts, cell or "k", "left").withColumn("samples", F.coalesce("samples", F.lit(0)))


@query(f"{o.sampled(10)} SELECT row_idx, k, abs(k) || CASE WHEN k >= 0 THEN 'U' ELSE 'D' END AS row, round(lat, 9) AS lat, m AS cells, coalesce(samples, 0) AS samples FROM gr LEFT JOIN nr USING (k)")
def grid_rows_10km(spark, sf_dir):
    return sampled(grid.grid_rows(spark, FINE).withColumn("lat", rounded(F.col("lat"), 9)), spark, sf_dir, FINE, None)


@query(f"{o.sampled(100)} SELECT {o.name()} AS name, row_idx, col_idx, round(lat, 9) AS lat, round(lon, 9) AS lon, {o.EPSG.format(lat='lat', lon='lon')} AS utm_zone, 'EPSG:' || {o.EPSG.format(lat='lat', lon='lon')} AS epsg, coalesce(samples, 0) AS samples FROM gc JOIN gr USING (k) LEFT JOIN n USING (k, c)")
def grid_points_100km(spark, sf_dir):
    return sampled(grid.grid_points(spark, MEDIUM), spark, sf_dir, MEDIUM).select("samples", "name", "row_idx", "col_idx", rounded(F.col("lat"), 9).alias("lat"), rounded(F.col("lon"), 9).alias("lon"), "utm_zone", "epsg")


@query()
def grid_points_10km(spark, sf_dir):
    """The reference's default grid, 5,094,350 points; tested by counts, names and a band of rows."""
    return sampled(grid.grid_points(spark, FINE), spark, sf_dir, FINE).select("samples", "name", "row_idx", "col_idx", rounded(F.col("lat"), 9).alias("lat"), rounded(F.col("lon"), 9).alias("lon"), "utm_zone", "epsg")


@query(f"{o.sampled(1000)} SELECT coalesce(samples, 0) AS samples, {o.name()} AS name, {o.EPSG.format(lat='(lat + 500000/111120.0)', lon='(lon + 500000/(111120.0*cos((lat + 500000/111120.0)*pi()/180)))')} AS utm_zone FROM gc JOIN gr USING (k) LEFT JOIN n USING (k, c)")
def grid_points_utm_centre(spark, sf_dir):
    return sampled(grid.grid_points(spark, GridSpec(1000, utm_definition="center")), spark, sf_dir, COARSE).select("samples", "name", "utm_zone")


@query(f"{o.sampled(100)} SELECT {o.name()} AS name, coalesce(samples, 0) AS samples FROM gc LEFT JOIN n USING (k, c) WHERE gc.lon BETWEEN 5 AND 15")
def grid_longitude_range(spark, sf_dir):
    return sampled(grid.grid_points(spark, GridSpec(100, longitude_range=(5.0, 15.0))), spark, sf_dir, MEDIUM).select("name", "samples")


@query(f"{o.sampled(10)} SELECT gc.k, count(*) AS cells, round(min(lon), 9) AS west, round(max(lon), 9) AS east, coalesce(any_value(samples), 0) AS samples FROM gc LEFT JOIN nr ON gc.k = nr.k GROUP BY gc.k")
def grid_row_extents_10km(spark, sf_dir):
    c = grid.first_col(F.col("cells"))
    rows = sampled(grid.grid_rows(spark, FINE), spark, sf_dir, FINE, None)
    return rows.select("samples", "k", "cells", rounded(grid.col_longitude(c, F.col("cells")), 9).alias("west"), rounded(grid.col_longitude(c + F.col("cells") - 1, F.col("cells")), 9).alias("east"))


@query(o.located_meta(1000) + f" SELECT event_id, {o.name()} AS grid_cell, k AS grid_row_u, c AS grid_col_r FROM loc")
def cell_of_point_1000km(spark, sf_dir):
    return located(spark, sf_dir).select("event_id", "grid_cell", F.col("grid_row_u").cast("long").alias("grid_row_u"), F.col("grid_col_r").cast("long").alias("grid_col_r"))


@query(o.located_meta(100) + f" SELECT event_id, {o.name()} AS grid_cell, row_idx, col_idx FROM loc")
def cell_of_point_100km_idx(spark, sf_dir):
    return located(spark, sf_dir, MEDIUM, True).select("event_id", "grid_cell", F.col("row_idx").cast("long").alias("row_idx"), F.col("col_idx").cast("long").alias("col_idx"))


@query(o.located_meta(50) + f" SELECT event_id, {o.name()} AS grid_cell FROM loc")
def cell_of_point_50km(spark, sf_dir):
    return located(spark, sf_dir, GridSpec(50)).select("event_id", "grid_cell")


@query(o.located_meta(10) + f" SELECT event_id, {o.name()} AS grid_cell FROM loc")
def cell_of_point_10km(spark, sf_dir):
    return located(spark, sf_dir, FINE).select("event_id", "grid_cell")


@query(o.located_meta(100) + f" SELECT DISTINCT {o.name()} AS grid_cell, CAST(k AS INTEGER) AS row_u, CAST(c AS INTEGER) AS col_r, abs(k) || CASE WHEN k >= 0 THEN 'U' ELSE 'D' END AS row FROM loc")
def cell_name_codec(spark, sf_dir):
    cells = located(spark, sf_dir, MEDIUM).select("grid_cell").distinct()
    row, col = grid.cell_ints(F.col("grid_cell"))
    return cells.select("grid_cell", row.alias("row_u"), col.alias("col_r"), F.split_part("grid_cell", F.lit("_"), F.lit(1)).alias("row"))


@query(o.located_meta(100) + " SELECT event_id, round(gr.lat, 9) AS corner_lat, round(gc.lon, 9) AS corner_lon FROM loc JOIN gr USING (k) JOIN gc USING (k, c)")
def cell_corner(spark, sf_dir):
    return grid.with_corner(located(spark, sf_dir, MEDIUM), MEDIUM).select("event_id", rounded(F.col("corner_lat"), 9).alias("corner_lat"), rounded(F.col("corner_lon"), 9).alias("corner_lon"))


FOOTPRINT = f"""WITH {o.grid_sql(1000)}, h AS (SELECT k, lat, coalesce(lead(lat) OVER (ORDER BY k) - lat, lat - lag(lat) OVER (ORDER BY k)) AS h FROM gr),
w AS (SELECT k, c, lon, coalesce(lead(lon) OVER (PARTITION BY k ORDER BY c) - lon, lon - lag(lon) OVER (PARTITION BY k ORDER BY c), 0) AS w FROM gc)
SELECT {o.name()} AS name, round(lon - 0.1 * w, 8) AS "left", round(lat - 0.1 * h, 8) AS bottom, round(lon + 1.1 * w, 8) AS "right", round(lat + 1.1 * h, 8) AS top FROM w JOIN h USING (k)"""


@query(f"WITH foot AS ({FOOTPRINT}), {o.sampled(1000)[5:]}, nn AS (SELECT {o.name()} AS name, samples FROM n) SELECT foot.*, coalesce(samples, 0) AS samples FROM foot LEFT JOIN nn USING (name)")
def cell_footprints(spark, sf_dir):
    rows, cols = grid.cell_ints(F.col("name"))
    cells = grid.grid_points(spark, COARSE).select("name", rows.alias("grid_row_u"), cols.alias("grid_col_r"))
    return sampled(grid.with_footprint(cells, COARSE, 0.1), spark, sf_dir, COARSE).select("name", "samples", *[rounded(F.col(c), 8).alias(c) for c in ("left", "bottom", "right", "top")])


@query(f"{o.sampled(1000)} SELECT {o.name()} AS name, lead({o.name()}) OVER (PARTITION BY k ORDER BY c) AS east_of, coalesce(samples, 0) AS samples FROM gc LEFT JOIN n USING (k, c)")
def east_neighbours(spark, sf_dir):
    row, col = grid.cell_ints(F.col("name"))
    cells = grid.grid_points(spark, COARSE).select("name", row.alias("k"), col.alias("c"))
    return sampled(cells.select("name", F.lead("name").over(Window.partitionBy("k").orderBy("c")).alias("east_of")), spark, sf_dir, COARSE)


@query(f"WITH {o.META} SELECT event_id, {o.EPSG.format(lat='centre_lat', lon='centre_lon')} AS utm FROM meta")
def utm_zones(spark, sf_dir):
    return views.metadata(spark, sf_dir).select("event_id", geo.utm_epsg(F.col("centre_lat"), F.col("centre_lon")).alias("utm"))


VIEWPORT = f"WITH b AS (SELECT label, avg(vec_id) AS a, min(vec_id) % 80 AS south, max(vec_id) % 80 + 3.3 AS north FROM embeddings GROUP BY label), pts AS (SELECT label, (south + north) / 2.0 AS lat, (south - 50 + north) / 2.0 AS lon FROM b), {o.grid_sql(100)}, {o.located('pts', 'lat', 'lon')} SELECT label, {o.name()} AS grid_cell FROM loc"


@query(VIEWPORT)
def viewport_cell(spark, sf_dir):
    boxes = views.vectors(spark, sf_dir).groupBy("label").agg((F.min("vec_id") % 80).cast("double").alias("south"), ((F.max("vec_id") % 80).cast("double") + 3.3).alias("north"))
    centres = boxes.select("label", ((F.col("south") + F.col("north")) / 2).alias("lat"), ((F.col("south") - 50 + F.col("north")) / 2).alias("lon"))
    return grid.with_cell(centres, "lat", "lon", MEDIUM).select("label", "grid_cell")


# Transverse Mercator

@query(f"WITH {o.META}, {o.utm('meta')} SELECT event_id, CAST(zone AS INTEGER) AS zone, round(east, 3) AS east, round(north, 3) AS north FROM utm")
def utm_forward(spark, sf_dir):
    y, x = F.col("centre_lat"), F.col("centre_lon")
    zone = geo.utm_zone(y, x)
    df = views.metadata(spark, sf_dir).withColumn("zone", zone)
    east, north = geo.tm_forward(y, x, F.col("zone"), y < 0)
    return df.select("event_id", "zone", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query(f"WITH {o.META} SELECT event_id, round(centre_lat, 6) AS lat, round(centre_lon, 6) AS lon FROM meta WHERE centre_lat BETWEEN -80 AND 80")
def utm_round_trip(spark, sf_dir):
    """Forward and back again gives the point itself, so the SQL is just the points."""
    y, x = F.col("centre_lat"), F.col("centre_lon")
    df = views.metadata(spark, sf_dir).where(y.between(-80, 80)).withColumn("zone", geo.utm_zone(y, x))
    east, north = geo.tm_forward(y, x, F.col("zone"), y < 0)
    df = df.withColumn("east", east).withColumn("north", north)
    lat, lon = geo.tm_inverse(F.col("east"), F.col("north"), F.col("zone"), y < 0)
    return df.select("event_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


WINDOW = o.located_meta(10, f", cor AS (SELECT event_id, gr.lat, gc.lon FROM loc JOIN gr USING (k) JOIN gc USING (k, c)), {o.utm('cor', 'lat', 'lon')}")


@query(WINDOW + ' SELECT event_id, round(east - 340, 2) AS "left", round(north - 340, 2) AS bottom, round(east + 10340, 2) AS "right", round(north + 10340, 2) AS top FROM utm')
def product_windows(spark, sf_dir):
    """The default 10 km lookup over every sample."""
    df = grid.with_corner(grid.with_cell(views.metadata(spark, sf_dir), "centre_lat", "centre_lon", FINE), FINE)
    y, x = F.col("corner_lat"), F.col("corner_lon")
    east, north = geo.tm_forward(y, x, geo.utm_zone(y, x), y < 0)
    df = df.withColumn("east", east).withColumn("north", north)
    return df.select("event_id", *[F.round(c, 2).alias(n) for n, c in geo.product_window(F.col("east"), F.col("north")).items()])


# Joins

POINT_CELLS = f"WITH {o.META}, {o.POINTS}, {o.grid_sql(1000)}, {o.located('meta')}, lp AS (SELECT s.*, coalesce(g.k, (SELECT max(k) FROM gr)) AS k FROM pts s ASOF LEFT JOIN gr g ON s.lat > g.lat), locp AS (SELECT lp.*, coalesce(g.c, ll.c) AS c FROM lp ASOF LEFT JOIN gc g ON lp.k = g.k AND lp.lon > g.lon JOIN ll ON lp.k = ll.k)"


@query(POINT_CELLS + " SELECT event_id FROM loc WHERE modality = 'error' AND EXISTS (SELECT 1 FROM locp WHERE locp.k = loc.k AND locp.c = loc.c)")
def samples_in_point_cells(spark, sf_dir):
    meta = located(spark, sf_dir).where("modality = 'error'")
    return metadata.in_cells_of(meta, views.points(spark, sf_dir), COARSE, "lat", "lon").select("event_id")


@query(POINT_CELLS + " SELECT point_id FROM locp WHERE NOT EXISTS (SELECT 1 FROM loc WHERE locp.k = loc.k AND locp.c = loc.c AND modality = 'signup' AND nodata = 0)")
def points_without_sample(spark, sf_dir):
    meta = located(spark, sf_dir).where("modality = 'signup' AND nodata = 0")
    return metadata.points_without_sample(views.points(spark, sf_dir), meta, COARSE, "lat", "lon").select("point_id")


@query(POINT_CELLS + " SELECT point_id, event_id FROM locp JOIN loc ON locp.k = loc.k AND locp.c = loc.c")
def samples_at_points(spark, sf_dir):
    meta = located(spark, sf_dir).select("grid_cell", "event_id")
    return metadata.samples_at(views.points(spark, sf_dir), meta, COARSE, "lat", "lon").select("point_id", "event_id")


FIRST = o.located_meta(1000, f", img AS (SELECT DISTINCT k, c, product_id FROM loc WHERE modality = 'purchase'), ranked AS (SELECT *, row_number() OVER (PARTITION BY k, c, product_id ORDER BY timestamp, event_id) AS r FROM loc)")


@query(FIRST + f" SELECT {o.name('img.k', 'img.c')} AS grid_cell, img.product_id, event_id FROM img LEFT JOIN ranked ON img.k = ranked.k AND img.c = ranked.c AND img.product_id = ranked.product_id AND r = 1")
def image_with_first_metadata(spark, sf_dir):
    meta = located(spark, sf_dir)
    images = meta.where("modality = 'purchase'").select("grid_cell", "product_id").distinct()
    return metadata.with_metadata(images, meta.select("grid_cell", "product_id", "timestamp", "event_id")).select("grid_cell", "product_id", "event_id")


@query(o.located_meta(1000) + f" SELECT modality AS dataset, {o.name()} AS grid_cell, min_by(event_id, (timestamp, event_id)) AS event_id FROM loc GROUP BY k, c, modality")
def cell_across_datasets(spark, sf_dir):
    meta = located(spark, sf_dir).select("grid_cell", "timestamp", "event_id", "modality")
    kinds = ("click", "error", "purchase", "signup", "view")
    return metadata.across_datasets({m: meta.where(F.col("modality") == m).drop("modality") for m in kinds}, ["timestamp", "event_id"]).select("dataset", "grid_cell", "event_id")


@query(f"WITH {o.POINTS}, {o.tiles_sql()} SELECT * FROM hits")
def points_in_tiles(spark, sf_dir):
    return metadata.tiles_of(views.points(spark, sf_dir), views.tiles(spark).where("year = 2024"), "lon", "lat").select("point_id", "tile_id", "path")


@query(f"WITH {o.META} SELECT parquet_url, list_sort(list(DISTINCT parquet_row)) AS rows, CAST(count(DISTINCT parquet_row) AS INTEGER) AS n_rows FROM meta WHERE cloud_cover < 20 GROUP BY parquet_url")
def archive_rows(spark, sf_dir):
    return metadata.archive_rows(views.metadata(spark, sf_dir).where("cloud_cover < 20"))


@query(f"WITH {o.META} SELECT a.event_id, b.event_id AS archived FROM meta a JOIN meta b ON a.parquet_url = b.parquet_url AND a.parquet_row = b.parquet_row WHERE b.nodata = 0")
def archive_row_join(spark, sf_dir):
    meta = views.metadata(spark, sf_dir)
    images = meta.where("nodata = 0").select("parquet_url", "parquet_row", F.col("event_id").alias("archived"))
    return metadata.crowded_join(meta.select("parquet_url", "parquet_row", "event_id"), images, ["parquet_url", "parquet_row"]).select("event_id", "archived")


@query(o.vec("SELECT event_id, vec_id, round(list_sum(v), 5) AS total FROM events JOIN e ON event_id % (SELECT count(*) FROM e) = vec_id WHERE event_type IN ('purchase', 'signup')"))
def archive_point_read(spark, sf_dir):
    """Metadata rows of two modalities point into an archive of one raster a row group; only their groups are opened."""
    path, places = shared_path(spark, "archive"), shared_path(spark, "addresses")
    vectors = views.vectors(spark, sf_dir)
    px = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("px"), F.lit("never read").alias("other"))
    # a row group is a row, so the footer grows with the file: files of 1,024 rows keep it small
    px.repartition("vec_id").write.option("parquet.block.row.count.limit", 1).option("maxRecordsPerFile", 1024).parquet(path)
    archives.addresses(spark, path, ["vec_id"]).write.parquet(places)
    spots = spark.read.parquet(places)
    meta = views.metadata(spark, sf_dir).where(F.col("modality").isin("purchase", "signup")).withColumn("vec_id", F.col("event_id") % vectors.count())
    meta = meta.select("event_id", "vec_id").join(spots, "vec_id")
    images = archives.read_rows(meta, StructType([StructField("px", ArrayType(DoubleType()))]))
    return readers.rows_of(meta, images).select("event_id", "vec_id", rounded(F.aggregate("px", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


# Coverage and sets

@query(o.located_meta(1000) + " SELECT DISTINCT CAST(21 - (k + 10) - 1 AS INTEGER) AS y, CAST(c + 21 AS INTEGER) AS x, 255 AS value FROM loc WHERE NOT nodata > 0.5")
def coverage_mask(spark, sf_dir):
    return coverage.coverage_mask(located(spark, sf_dir), COARSE)


@query(o.located_meta(1000) + " SELECT k AS grid_row_u, c AS grid_col_r, CASE WHEN count(*) FILTER (modality = 'click') = 0 THEN 'second' WHEN count(*) FILTER (modality = 'view') = 0 THEN 'first' ELSE 'both' END AS status FROM loc WHERE modality IN ('click', 'view') GROUP BY k, c")
def coverage_comparison(spark, sf_dir):
    meta = located(spark, sf_dir).select(F.col("grid_row_u").cast("long").alias("grid_row_u"), F.col("grid_col_r").cast("long").alias("grid_col_r"), "modality")
    return coverage.compare_coverage(meta.where("modality = 'click'"), meta.where("modality = 'view'"))


@query(o.located_meta(1000) + ", seen AS (SELECT CAST(21 - (k + 10) - 1 AS INTEGER) AS y, CAST(c + 21 AS INTEGER) AS x, bool_or(modality = 'click') AS a, bool_or(modality = 'view') AS b FROM loc WHERE modality IN ('click', 'view') AND NOT nodata > 0.5 GROUP BY ALL) SELECT y, x, CASE WHEN a AND b THEN 255 ELSE 0 END AS r, CASE WHEN a THEN 255 ELSE 0 END AS g, CASE WHEN b THEN 255 ELSE 0 END AS b FROM seen")
def coverage_colour_mix(spark, sf_dir):
    meta = located(spark, sf_dir)
    return coverage.mixed_coverage(*[coverage.coverage_mask(meta.where(F.col("modality") == m), COARSE) for m in ("click", "view")])


@query(o.located_meta(1000) + f" SELECT k AS grid_row_u, modality, count(*) AS samples, count(DISTINCT {o.name()}) AS cells FROM loc GROUP BY ROLLUP (k, modality)")
def coverage_statistics(spark, sf_dir):
    return coverage.coverage_stats(located(spark, sf_dir).withColumn("grid_row_u", F.col("grid_row_u").cast("long")), ["grid_row_u", "modality"])


@query(o.located_meta(500) + f" SELECT {o.name()} AS grid_cell FROM loc WHERE modality = 'error' INTERSECT SELECT {o.name()} FROM loc WHERE modality = 'signup'")
def coverage_intersection(spark, sf_dir):
    meta = located(spark, sf_dir, GridSpec(500)).select("grid_cell", "modality")
    return meta.where("modality = 'error'").select("grid_cell").intersect(meta.where("modality = 'signup'").select("grid_cell"))


@query(o.located_meta(500) + f" SELECT {o.name()} AS grid_cell FROM loc WHERE modality = 'error' EXCEPT SELECT {o.name()} FROM loc WHERE modality = 'signup'")
def coverage_difference(spark, sf_dir):
    meta = located(spark, sf_dir, GridSpec(500)).select("grid_cell", "modality")
    return meta.where("modality = 'error'").select("grid_cell").subtract(meta.where("modality = 'signup'").select("grid_cell"))


@query(f"WITH {o.META} SELECT DISTINCT parquet_url FROM (SELECT parquet_url FROM meta WHERE nodata = 0 UNION ALL SELECT parquet_url FROM meta WHERE nodata = 1)")
def union_distinct_urls(spark, sf_dir):
    meta = views.metadata(spark, sf_dir)
    return meta.where("nodata = 0").select("parquet_url").unionByName(meta.where("nodata = 1").select("parquet_url")).distinct()


@query(f"WITH {o.META} SELECT event_id, row_number() OVER (PARTITION BY parquet_url ORDER BY event_id) - 1 AS row_idx, count(*) OVER (PARTITION BY parquet_url ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM meta")
def row_ordinals(spark, sf_dir):
    w = Window.partitionBy("parquet_url").orderBy("event_id")
    n = F.row_number().over(w).cast("long") - 1
    return views.metadata(spark, sf_dir).select("event_id", n.alias("row_idx"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))


# Vectors

QUERY_VECTOR = [((i * 37 + 11) % 64 - 31.5) / 150 for i in range(64)]
QV = "[" + ", ".join(map(repr, QUERY_VECTOR)) + "]::DOUBLE[]"
DIST = f"list_sum(list_transform(range(1, 65), lambda i: (v[i] - ({QV})[i]) * (v[i] - ({QV})[i])))"


@query(o.vec(f"SELECT vec_id, round({DIST}, 6) AS score FROM e ORDER BY {DIST}, vec_id LIMIT 10"))
def exact_top_k(spark, sf_dir):
    return vector_index.exact_search(views.vectors(spark, sf_dir), QUERY_VECTOR, 10).select("vec_id", rounded(F.col("score"), 6).alias("score"))


@query(o.vec(f"SELECT vec_id, label, round({DIST}, 6) AS score FROM e WHERE {DIST} <= 2.9"))
def within_radius(spark, sf_dir):
    return vector_index.within_radius(views.vectors(spark, sf_dir), QUERY_VECTOR, 2.9).select("vec_id", "label", rounded(F.col("score"), 6).alias("score"))


@query(o.vec("SELECT vec_id, round(norm, 6) AS norm, list_transform(v, lambda x: round(x / norm, 6)) AS unit FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e)"))
def l2_normalise(spark, sf_dir):
    v = F.col("embedding")
    return views.vectors(spark, sf_dir).select("vec_id", rounded(vx.l2_norm(v), 6).alias("norm"), F.transform(vx.l2_normalised(v), lambda x: rounded(x, 6)).alias("unit"))


@query(o.vec("SELECT label, i, round(avg(v[i]), 6) AS mean FROM e, range(1, 65) t(i) GROUP BY label, i"))
def label_centroids(spark, sf_dir):
    parts = views.vectors(spark, sf_dir).select("label", F.posexplode(vx.doubles(F.col("embedding"))).alias("p", "x"))
    return parts.groupBy("label", (F.col("p") + 1).cast("long").alias("i")).agg(rounded(F.avg("x"), 6).alias("mean"))


CENTROIDS = [[((i * (31 + 2 * c) + 7 * c) % 64 - 31.5) / 150 for i in range(64)] for c in range(8)]


@query(o.vec("SELECT vec_id, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS list_id FROM (SELECT vec_id, list_transform([" + ", ".join("[" + ", ".join(map(repr, c)) + "]" for c in CENTROIDS) + "]::DOUBLE[][], lambda c: round(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))), 12)) AS d FROM e)"))
def centroid_assignment(spark, sf_dir):
    return vector_index.nearest_centroid(views.vectors(spark, sf_dir), np.array(CENTROIDS)).select("vec_id", "list_id")


@query(o.vec("SELECT label AS file, least(count(*), 30) AS picked FROM e GROUP BY label"))
def sample_sizes(spark, sf_dir):
    df = views.vectors(spark, sf_dir).withColumnRenamed("label", "file")
    return vector_index.sample_per_file(df, "file", "vec_id", 30, None).groupBy("file").agg(F.count("*").alias("picked"))


@query(o.vec(f"SELECT s.vec_id, round(s.d, 6) AS score, (s.vec_id % 7) AS file FROM (SELECT vec_id, {DIST} AS d FROM e ORDER BY {DIST}, vec_id LIMIT 5) s"))
def top_k_with_metadata(spark, sf_dir):
    df = views.vectors(spark, sf_dir)
    meta = df.select("vec_id", (F.col("vec_id") % 7).alias("file"))
    found = vector_index.exact_search(df, QUERY_VECTOR, 5).select("vec_id", rounded(F.col("score"), 6).alias("score"))
    return vector_index.search_with_metadata(found, meta).select("vec_id", "score", "file")


def _index(df: DataFrame, k: int) -> tuple[vector_index.VectorIndex, DataFrame, DataFrame, int, int]:
    """An index with 4 sqrt(n) lists, trained on a bounded sample, with the codes of all rows in the shared folder; a twentieth
    of all rows as queries; and the lists to probe and the factor to rerank by, fitted on 128 of the queries to a recall of 0.95."""
    lists = max(16, round(4 * df.count() ** 0.5))
    sample = vector_index.sample_per_file(df.withColumn("file", F.input_file_name()), "file", "vec_id")
    index, path = vector_index.VectorIndex.train(sample, lists, 16), shared_path(df.sparkSession, "codes")
    index.encode(df.select("vec_id", "embedding")).write.parquet(path)
    codes, asks = df.sparkSession.read.parquet(path), df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return index, codes, asks, *index.fitted(codes, df, asks, k)


@query()
def ivf_pq_search(spark, sf_dir):
    """Approximate: its recall is held against the exact search in tests/test_vector_index.py."""
    df = views.vectors(spark, sf_dir)
    index, codes, _, probes, factor = _index(df, 10)
    return index.search(codes, QUERY_VECTOR, 10, probes, rerank=(df, factor))


@query()
def ivf_pq_batch(spark, sf_dir):
    """A twentieth of all vectors as queries; held against single searches and brute force in tests/test_vector_index.py."""
    df = views.vectors(spark, sf_dir)
    index, codes, asks, probes, factor = _index(df, 10)
    return index.search_many(codes, asks, 10, probes, rerank=(df, factor)).select("query_id", "vec_id", "score", "rank")


@query()
def pca_composite(spark, sf_dir):
    """Components are free in sign, so there is no SQL; held against a singular value decomposition in tests/test_brute_force.py."""
    found = vector_index.rgb_of_components(vector_index.pca_composite(views.vectors(spark, sf_dir), "embedding"))
    return found.select("vec_id", "r", "g", "b")


@query()
def raster_pca_composite(spark, sf_dir):
    """Each raster by components of its own; held against a singular value decomposition in tests/test_reference.py."""
    px = views.rasters(spark, sf_dir)
    return px.select("vec_id", composite.pca_rgb(F.col("px"), 4).alias("shades"))


# Rasters

def pixel_sums(df: DataFrame, px) -> DataFrame:
    out = df.select("vec_id", px.alias("q"))
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", rounded(total, 5).alias("total"), rounded(F.get("q", F.lit(0)), 6).alias("first_px"), rounded(F.get("q", F.lit(63)), 6).alias("last_px"))


@query(o.pixel_sums("list_transform(px, lambda x: greatest(0.0, least(1.0, 2.5 * x / 10000.0)))"))
def s2_true_colour(spark, sf_dir):
    return pixel_sums(views.rasters(spark, sf_dir), raster.true_colour(F.col("px")))


@query(o.pixel_sums("list_transform(px, lambda x: x / 10000.0)"))
def s2_reflectance(spark, sf_dir):
    return pixel_sums(views.rasters(spark, sf_dir), raster.reflectance(F.col("px")))


@query(o.pixel_sums("list_transform(px, lambda x: 10 * log10(greatest(x, 1e-10)))", 1.0))
def s1_decibels(spark, sf_dir):
    return pixel_sums(views.rasters(spark, sf_dir, 1.0), raster.decibels(F.col("px")))


@query(o.pixel_sums("list_transform(px, lambda x: greatest(0.0, least(1.0, (10 * log10(greatest(x, 1e-10)) - (-12.54847273 - 2 * 5.25697717)) / (4 * 5.25697717))))", 1.0))
def s1_normalised(spark, sf_dir):
    return pixel_sums(views.rasters(spark, sf_dir, 1.0), raster.s1_normalised(raster.decibels(F.col("px")), "vv"))


@query(o.pixels(20000.0, 1500.0) + " SELECT vec_id, list_transform(px, lambda x: CAST(floor(255 * greatest(0.0, least(1.0, 1.3 * pow(greatest(x, 0.0) / 10000, 0.6)))) AS INTEGER)) AS shades FROM r")
def s2_thumbnail(spark, sf_dir):
    return views.rasters(spark, sf_dir, 20000.0, 1500.0).select("vec_id", raster.optical_thumbnail(F.col("px")).alias("shades"))


@query(o.pixels(1000.0) + " SELECT vec_id, list_transform(px, lambda x: CAST(floor(255 * (x - list_min(px)) / (list_max(px) - list_min(px))) AS INTEGER)) AS shades FROM r")
def dem_grayscale(spark, sf_dir):
    return views.rasters(spark, sf_dir, 1000.0).select("vec_id", raster.grayscale(F.col("px")).alias("shades"))


def _radar_sql() -> str:
    clean = lambda p: f"list_transform({p}, lambda x: 10 * log10(greatest(CASE WHEN x < 0 THEN list_min(list_filter({p}, lambda y: y >= 0)) ELSE x END, 1e-10)))"
    stretch = lambda d: f"list_transform({d}, lambda x: 255 * (x - list_min({d})) / (list_max({d}) - list_min({d})))"
    return f"""{o.pixels(1.0)}, d AS (SELECT vec_id, {clean('px')} AS a, {clean('list_reverse(px)')} AS b FROM r),
s AS (SELECT vec_id, {stretch('a')} AS r, {stretch('b')} AS b FROM d), t AS (SELECT *, list_transform(range(1, 65), lambda i: r[i] + b[i]) AS g FROM s)
SELECT vec_id, list_transform(r, lambda x: CAST(floor(x) AS INTEGER)) AS red, list_transform(g, lambda x: CAST(floor(255 * x / list_max(g)) AS INTEGER)) AS green, list_transform(b, lambda x: CAST(floor(x) AS INTEGER)) AS blue FROM t"""


@query(_radar_sql())
def s1_thumbnail(spark, sf_dir):
    df = views.rasters(spark, sf_dir, 1.0).withColumn("px2", F.reverse("px"))
    df = df.withColumn("rgb", raster.radar_thumbnail(F.col("px"), F.col("px2")))
    return df.select("vec_id", *[F.col(f"rgb.{c}").alias(n) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))])


@query(o.pixels(127.0) + " SELECT vec_id, round(list_sum(list_transform(px, lambda x: pow(trunc(x) / 127.5, 2) * sign(trunc(x)))), 6) AS total FROM r")
def dequantise(spark, sf_dir):
    df = views.rasters(spark, sf_dir, 127.0).withColumn("q", F.transform("px", lambda x: x.cast("int")))
    values = raster.dequantised(F.col("q"))
    return df.select("vec_id", rounded(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(o.pixels(1.0) + " SELECT vec_id, round(list_min(px), 6) AS low, round(list_max(px), 6) AS high, round(list_min(list_filter(px, lambda x: x >= 0)), 6) AS least, CAST(len(list_filter(px, lambda x: x > 0)) AS INTEGER) AS valid FROM r")
def raster_statistics(spark, sf_dir):
    px = F.col("px")
    low = [F.array_min(px).alias("low"), F.array_max(px).alias("high"), F.array_min(F.filter(px, lambda x: x >= 0)).alias("least")]
    df = views.rasters(spark, sf_dir, 1.0).select("vec_id", *low, F.size(F.filter(px, lambda x: x > 0)).alias("valid"))
    return df.select("vec_id", *[rounded(F.col(c), 6).alias(c) for c in ("low", "high", "least")], "valid")


@query(o.pixels(1.0) + " SELECT vec_id, round(list_sum(list_transform(range(400), lambda i: px[(i // 20) * 8 // 20 * 8 + (i % 20) * 8 // 20 + 1] * (i + 1))), 5) AS weighted FROM r")
def nearest_resample(spark, sf_dir):
    big = raster.resampled(F.col("px"), 8, 8, 20, 20)
    df = views.rasters(spark, sf_dir, 1.0).select("vec_id", big.alias("q"))
    weighted = F.aggregate(F.zip_with("q", F.sequence(F.lit(1), F.lit(400)), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return df.select("vec_id", rounded(weighted, 5).alias("weighted"))


@query(o.pixels(1.0) + " SELECT vec_id, list_transform(range(64), lambda i: round(px[(7 - i // 8) * 8 + i % 8 + 1], 6)) AS flipped, list_transform(range(6), lambda i: round(px[(2 + i // 3) * 8 + 4 + i % 3 + 1], 6)) AS crop FROM r")
def flip_and_crop(spark, sf_dir):
    px = F.col("px")
    six = lambda a: F.transform(a, lambda x: rounded(x, 6))
    return views.rasters(spark, sf_dir, 1.0).select("vec_id", six(raster.flipped(px, 8, 8)).alias("flipped"), six(raster.cropped(px, 8, F.lit(2), F.lit(4), F.lit(2), F.lit(3))).alias("crop"))


@query(o.pixels(10000.0) + " SELECT vec_id, list_transform(range(1, 65), lambda i: round((px[i] / 2000.0 + px[65 - i] / 2000.0 + px[i] / 2000.0) / 3, 6)) AS pooled FROM r")
def composite_mean_pool(spark, sf_dir):
    band = raster.display_scaled(F.col("px"))
    bands = F.array(band, F.reverse(band), band)
    return views.rasters(spark, sf_dir).select("vec_id", F.transform(vx.mean_pool(bands), lambda x: rounded(x, 6)).alias("pooled"))


@query()
def dem_hillshade(spark, sf_dir):
    """Needs neighbours in two directions; held against plain loops in tests/test_brute_force.py."""
    return views.rasters(spark, sf_dir, 1000.0).select("vec_id", hillshade.hillshade(F.col("px"), 8, 8).alias("shades"))


# Fragments and embeddings

@query(f"WITH {o.META}, {o.fragments_sql(1068, 224, 'event_id', 'meta')} SELECT * FROM frag")
def fragment_offsets(spark, sf_dir):
    df = views.metadata(spark, sf_dir).select("event_id")
    return fragments.with_fragments(df, fragments.FragmentPlan(1068, 224)).select("event_id", "frag_row", "frag_col", "y_offset", "x_offset")


@query(f"WITH {o.META}, {o.fragments_sql(120, 32, 'event_id', 'meta')} SELECT event_id, frag_row, frag_col, [y_offset, x_offset, y_offset + 32, x_offset + 32] AS pixel_bbox FROM frag")
def fragment_pixel_boxes(spark, sf_dir):
    df = views.metadata(spark, sf_dir).select("event_id")
    return fragments.with_fragments(df, fragments.FragmentPlan(120, 32)).select("event_id", "frag_row", "frag_col", "pixel_bbox")


@query(f"""WITH {o.META}, u AS (SELECT event_id, 500000.0 + event_id * 10 AS e, 4000000.0 - event_id * 5 AS n FROM meta), {o.fragments_sql(1068, 384, 'event_id, e, n', 'u')}
SELECT event_id, frag_row, frag_col, round(e + x_offset * 10680.0 / 1068, 3) AS "left", round(n + 10680.0 - (y_offset + 384) * 10680.0 / 1068, 3) AS bottom, round(e + (x_offset + 384) * 10680.0 / 1068, 3) AS "right", round(n + 10680.0 - y_offset * 10680.0 / 1068, 3) AS top FROM frag""")
def fragment_footprints(spark, sf_dir):
    df = views.metadata(spark, sf_dir).select("event_id", (500000.0 + F.col("event_id") * 10).alias("e"), (4000000.0 - F.col("event_id") * 5).alias("n"))
    df = fragments.with_fragments(df, fragments.FragmentPlan(1068, 384), transposed=False)
    e, n = F.col("e"), F.col("n")
    sides = fragments.crop_footprint(e, n, e + 10680.0, n + 10680.0, 1068, 1068, F.col("pixel_bbox"))
    return df.select("event_id", "frag_row", "frag_col", *[F.round(c, 3).alias(s) for s, c in sides.items()])


@query()
def embedded_fragments(spark, sf_dir):
    """A Python model runs on each fragment; held against plain arithmetic in tests/test_brute_force.py."""
    px = views.rasters(spark, sf_dir)
    images = px.select(
        F.col("px").alias("B04"), F.lit(8).alias("B04_size"), F.slice("px", 1, 16).alias("B03"), F.lit(4).alias("B03_size"), F.lit("10U_5R").alias("grid_cell"), F.lit(10).cast("smallint").alias("grid_row_u"), F.lit(5).cast("smallint").alias("grid_col_r"),
        F.concat(F.lit("P"), "vec_id").alias("product_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("timestamp"), F.lit("EPSG:32633").alias("crs"),
        (F.lit(425008.0) + F.col("vec_id")).alias("left"), F.lit(4514199.0).alias("bottom"), (F.lit(435688.0) + F.col("vec_id")).alias("right"), F.lit(4524879.0).alias("top"),
    )
    return embed.embed(images, embed.BandStatistics(["B04", "B03"], 4))


# Text and geometry

@query(f"WITH {o.META} SELECT event_id, split_part(split_part(parquet_url, 'Core/', 2), '/', 1) AS dataset FROM meta")
def url_tags(spark, sf_dir):
    return views.metadata(spark, sf_dir).select("event_id", text.dataset_tag(F.col("parquet_url"), "Core").alias("dataset"))


@query(o.located_meta(1000) + f" SELECT event_id, 'L2A/' || split_part({o.name()}, '_', 1) || '/' || {o.name()} || '/' || product_id AS path FROM loc")
def sample_paths(spark, sf_dir):
    return located(spark, sf_dir).select("event_id", text.sample_path(F.lit("L2A"), F.col("grid_cell"), F.col("product_id")).alias("path"))


@query(f"WITH {o.META} SELECT event_id, printf('POINT (%.6f %.6f)', centre_lon, centre_lat) AS wkt, printf('POLYGON ((%.3f %.3f, %.3f %.3f, %.3f %.3f, %.3f %.3f, %.3f %.3f))', centre_lon + 1, centre_lat, centre_lon + 1, centre_lat + 2, centre_lon, centre_lat + 2, centre_lon, centre_lat, centre_lon + 1, centre_lat) AS box FROM meta")
def geometry_text(spark, sf_dir):
    y, x = F.col("centre_lat"), F.col("centre_lon")
    return views.metadata(spark, sf_dir).select("event_id", geo.point_wkt(x, y).alias("wkt"), geo.polygon_wkt(geo.box_ring(x, y, x + 1, y + 2), 3).alias("box"))


@query(f"WITH {o.META} SELECT event_id, round(centre_lon + 0.5, 6) AS x, round(centre_lat + 1, 6) AS y FROM meta")
def box_centroids(spark, sf_dir):
    y, x = F.col("centre_lat"), F.col("centre_lon")
    df = views.metadata(spark, sf_dir).select("event_id", F.slice(geo.box_ring(x, y, x + 1, y + 2), 1, 4).alias("ring"))
    df = df.select("event_id", geo.ring_centroid(F.col("ring")).alias("c"))
    return df.select("event_id", rounded(F.col("c.x"), 6).alias("x"), rounded(F.col("c.y"), 6).alias("y"))


CHECK = "sha256('POINT (0 0)' || '_' || '2024-01-01 00:00:00' || '_' || 'P' || vec_id || '_' || '[' || array_to_string(list_transform(v, lambda x: printf('%.4f', x)), ' ') || ']')"


@query(o.vec(f"SELECT vec_id, {CHECK} AS checksum FROM e"))
def sample_checksums(spark, sf_dir):
    when = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return views.vectors(spark, sf_dir).select("vec_id", text.sample_checksum(F.lit("POINT (0 0)"), when, F.concat(F.lit("P"), "vec_id"), F.col("embedding"), 4).alias("checksum"))


def queries():
    from quadrille.plans import table_queries  # noqa: F401  registers its own

    return dict(REGISTERED)


def oracle_sql():
    from quadrille.plans import table_queries  # noqa: F401

    return dict(SQL)

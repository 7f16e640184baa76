"""More registered queries: layout, as-of look-up, windows of pixels and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import table_functions
from quadrille.functions.rounding import rounded
from quadrille.operators import asof, fragments, layout
from quadrille.plans import oracles as o
from quadrille.plans import views
from quadrille.plans.queries import query
from quadrille.plans.views import EUROPE
from quadrille.sources.shared import shared_path


@query(f"WITH {o.META} SELECT event_id, round(centre_lat, 6) AS lat, round(centre_lon, 6) AS lon FROM meta WHERE centre_lon BETWEEN {EUROPE[0]} AND {EUROPE[2]} AND centre_lat BETWEEN {EUROPE[1]} AND {EUROPE[3]}")
def box_by_layout(spark, sf_dir):
    """The samples of a box from a table along the curve; tests/test_layout.py counts the files that are opened."""
    path = shared_path(spark, "layout")
    layout.write_clustered(views.metadata(spark, sf_dir), path, "centre_lat", "centre_lon")
    return layout.read_box(spark, path, EUROPE, "centre_lat", "centre_lon").select("event_id", rounded(F.col("centre_lat"), 6).alias("lat"), rounded(F.col("centre_lon"), 6).alias("lon"))


@query(f"WITH {o.META}, {o.POINTS}, b AS (SELECT lat, max(point_id) AS point_id FROM pts GROUP BY lat) SELECT event_id, b.point_id FROM meta ASOF LEFT JOIN b ON centre_lat > b.lat")
def samples_above_points(spark, sf_dir):
    """Each sample with the point next below it, by latitudes that are a table."""
    bounds = views.points(spark, sf_dir).select("lat", "point_id")
    return asof.asof(views.metadata(spark, sf_dir).select("event_id", "centre_lat"), "centre_lat", bounds, "lat", "point_id", "point_id").select("event_id", "point_id")


@query(o.pixels() + ", w AS (SELECT vec_id, px, list_transform(px, lambda v: v + 1) AS up, fr, fc, fr * 2 * 8 + fc * 3 AS a FROM r, range(3) t(fr), range(2) u(fc)), p AS (SELECT vec_id, fr, fc, flatten([px[a + 8 * i + 1 : a + 8 * i + 5] FOR i IN range(3)]) || flatten([up[a + 8 * i + 1 : a + 8 * i + 5] FOR i IN range(3)]) AS q FROM w) SELECT vec_id, CAST(fr AS INTEGER) AS frag_row, CAST(fc AS INTEGER) AS frag_col, CAST(len(q) AS INTEGER) AS n, round(list_sum(q), 5) AS total, round(q[1], 6) AS first_px, round(q[16], 6) AS second_band FROM p")
def pixel_windows(spark, sf_dir):
    """Windows of 3 x 5 pixels of two bands, two rows and three columns apart."""
    px = views.rasters(spark, sf_dir).withColumn("up", F.transform("px", lambda v: v + 1))
    q = fragments.unfolded(px, ["px", "up"], 8, 8, (3, 5), (2, 3))
    total = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x)
    return q.select("vec_id", "frag_row", "frag_col", F.size("pixels").alias("n"), rounded(total, 5).alias("total"), rounded(F.get("pixels", F.lit(0)), 6).alias("first_px"), rounded(F.get("pixels", F.lit(15)), 6).alias("second_band"))


@query(f"WITH s AS (SELECT p_partkey, CAST(p_size + 60 AS INTEGER) AS height FROM part), {', '.join(f'f{h} AS (WITH ' + o.fragments_sql(h, 40, 'p_partkey', f'(SELECT p_partkey FROM s WHERE height = {h})', 0.25) + ' SELECT * FROM frag)' for h in range(61, 111))} {' UNION ALL '.join(f'SELECT *, 40 AS size FROM f{h}' for h in range(61, 111))}")
def fragments_in_sql(spark, sf_dir):
    """The table function over images of several sizes, from SQL."""
    table_functions.register(spark)
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("quadrille_part")
    return spark.sql("SELECT p_partkey, f.* FROM quadrille_part, LATERAL fragments(CAST(p_size + 60 AS INT), 40, 0.25D) f")

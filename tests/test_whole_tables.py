"""The queries that run over whole tables: every id is there, and each agrees with its SQL (tests/test_queries.py)."""

import pytest
from pyspark.sql import functions as F

from quadrille.plans import oracles as o
from quadrille.plans import queries as plans

from .compare import duck, same

QUERIES = plans.queries()


@pytest.mark.parametrize(
    "name, table, key, each",
    [("product_windows", "events", "event_id", 1), ("fragment_offsets", "events", "event_id", 25), ("fragment_pixel_boxes", "events", "event_id", 16),
     ("fragment_footprints", "events", "event_id", 9), ("geometry_text", "events", "event_id", 1), ("sample_checksums", "embeddings", "vec_id", 1)],
)
def test_every_id(spark, sf_dir, name, table, key, each):
    ids = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key)
    found = QUERIES[name](spark, sf_dir).groupBy(key).count()
    assert found.where(F.col("count") != each).isEmpty() and sorted(found.select(key).collect()) == sorted(ids.collect())


def test_grid_points_10km(spark, sf_dir):
    points = QUERIES["grid_points_10km"](spark, sf_dir)
    n, names = points.agg(F.count("*"), F.countDistinct("name")).first()
    assert n == names == 5094350
    band = f"WITH {o.grid_sql(10)} SELECT {o.name()} AS name, row_idx, col_idx, round(lat, 9) AS lat, round(lon, 9) AS lon, {o.EPSG.format(lat='lat', lon='lon')} AS utm_zone, 'EPSG:' || {o.EPSG.format(lat='lat', lon='lon')} AS epsg FROM gc JOIN gr USING (k) WHERE k BETWEEN 452 AND 454"
    assert points.agg(F.sum("samples")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert same(points.drop("samples").where(F.split_part("name", F.lit("_"), F.lit(1)).isin("452U", "453U", "454U")), duck(sf_dir), band) is None

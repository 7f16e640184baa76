"""Queries against their SQL bit by bit (-0.0 is not 0.0), on rows where the last bit decides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions.geo import in_polygon
from quadrille.functions.rounding import rounded
from quadrille.plans import queries as plans

from .compare import duck

QUERIES, SQL = plans.queries(), plans.oracle_sql()


def bits(df, own, sql):
    """Rows as text, of Spark and of the SQL; equal only if signs of zeros are, too."""
    mine = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    found = own.execute(sql)
    order = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
    return mine, sorted(repr([r[i] for i in order]) for r in found.fetchall())


@pytest.fixture
def folder(spark, tmp_path):
    """Vectors with components so small that they round to a zero with a sign, and random ones."""
    x = np.random.default_rng(5).normal(0, 0.12, (600, 64)).astype(np.float32)
    x[:50, ::3] *= np.float32(1e-6)
    rows = [(i, [float(c) for c in v], i % 10) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["composite_mean_pool", "flip_and_crop", "l2_normalise", "s2_reflectance", "raster_statistics", "dequantise"])
def test_signs_of_zeros(spark, folder, name):
    mine, theirs = bits(QUERIES[name](spark, folder), duck(folder), SQL[name])
    assert mine == theirs


def test_rounded(spark):
    values = [0.1234565, -0.1234565, 2.5e-7, -2.5e-7, 1e-6 * 0.5, 1e-6 * 1.5, -0.0, 0.0, 1e300, float("inf"), float("nan"), 1.0000005, 4503599627370497.5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x"), 6)).collect()]
    want = [duck("/nowhere").execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert list(map(repr, got)) == list(map(repr, want))


def test_points_on_slanting_edges(spark):
    """A hexagon of the lattice, and points whose decimals lie on its edges: the cross product's sign decides, as in the SQL."""
    west, south = -150.0, -40.0
    ring = [(west + a, south + b) for a, b in ((2.5, 0), (7.5, 0), (10, 5), (7.5, 10), (2.5, 10), (0, 5))]
    points = [(-148.711, -32.422000000000004), (-148.711, -32.43), (-148.711, -32.41)] + [(west + i / 1000, south + 5 + 2 * i / 1000) for i in range(1, 2500, 7)]

    def side(p, a, b):
        return (b[0] - a[0]) * (p[1] - south - (a[1] - south)) - (b[1] - a[1]) * (p[0] - west - (a[0] - west))

    want = [all(side(p, a, b) > 0 for a, b in zip(ring, ring[1:] + ring[:1])) for p in points]
    df = spark.createDataFrame([(i, *p, ring) for i, p in enumerate(points)], "i int, x double, y double, ring array<struct<x:double,y:double>>")
    assert [r[0] for r in df.orderBy("i").select(in_polygon(F.col("x"), F.col("y"), F.col("ring"))).collect()] == want and 0 < sum(want) < len(want)
    closed = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]), (2, None), (3, [])], "i int, ring array<struct<x:double,y:double>>")
    assert [r[0] for r in closed.orderBy("i").select(in_polygon(F.lit(1.0), F.lit(1.0), F.col("ring"))).collect()] == [True, False, False]


def test_brightest_pixels(spark, tmp_path):
    """Decibels of random pixels: the brightest of a raster is cut off to 255 or 254 by the last bit of its logarithm."""
    x = np.abs(np.random.default_rng(1).normal(0, 0.12, (20000, 64))).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    mine, theirs = bits(QUERIES["s1_thumbnail"](spark, str(tmp_path)), duck(str(tmp_path)), SQL["s1_thumbnail"])
    assert mine == theirs

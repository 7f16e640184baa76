"""Layout along a curve, as-of look-up, windows of pixels and table functions on small cases."""

import bisect

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import table_functions
from quadrille.operators import asof, fragments, layout


def key(lat, lon):
    x, y = min(int((lon + 180) / 360 * 65536), 65535), min(int((lat + 90) / 180 * 65536), 65535)
    return sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(16))


def test_morton_keys(spark):
    rng = np.random.default_rng(0)
    at = [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300))] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0)]
    got = spark.createDataFrame(at, "lat double, lon double").select("lat", "lon", layout.morton(F.col("lat"), F.col("lon")).alias("k")).collect()
    assert all(r.k == key(r.lat, r.lon) for r in got)
    odd = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0)], "lat double, lon double").select(layout.morton(F.col("lat"), F.col("lon")).alias("k"))
    assert [r.k for r in odd.collect()] == [None, None]


@pytest.mark.parametrize("box", [(-25.0, 30.0, 45.0, 72.0), (-180.0, -90.0, 180.0, 90.0), (14.09, 40.79, 14.37, 40.98), (5.0, 5.0, 5.0, 5.0)])
def test_ranges_cover_the_box(box):
    spans = layout.ranges(box)
    assert len(spans) <= 64 and spans == sorted(spans)
    rng = np.random.default_rng(1)
    for x, y in zip(rng.uniform(box[0], box[2], 300), rng.uniform(box[1], box[3], 300)):
        k = key(y, x)
        assert any(a <= k <= b for a, b in spans)


def test_box_opens_few_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 4000), rng.uniform(-180, 180, 4000)))] + [(5000, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    layout.write_clustered(df, f"{tmp_path}/t", "lat", "lon")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4001
    box = (5.9, 45.8, 10.5, 47.9)
    found = layout.read_box(spark, f"{tmp_path}/t", box, "lat", "lon")
    assert sorted(r.id for r in found.collect()) == sorted(i for i, y, x in rows if y is not None and box[0] <= x <= box[2] and box[1] <= y <= box[3])
    assert sorted(found.columns) == ["id", "lat", "lon"]
    every = len(set(spark.read.parquet(f"{tmp_path}/t").inputFiles()))
    opened = found.select(F.input_file_name().alias("f")).distinct().count()
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "block" in text and "morton" in text and opened <= every / 20


@pytest.mark.parametrize("strict", [True, False])
def test_asof(spark, strict):
    rng = np.random.default_rng(3)
    bounds = sorted({float(x) for x in rng.integers(0, 500, 120)})
    at = [float(x) for x in rng.integers(-20, 520, 1500)] + [7.0] * 700  # a third at one key
    df = spark.createDataFrame([(i, x) for i, x in enumerate(at)] + [(9000, None)], "id long, x double")
    table = spark.createDataFrame([(b, f"v{b}") for b in bounds] + [(None, "no"), (3.0, None)], "b double, v string").repartition(5)
    found = {r.id: r.found for r in asof.asof(df, "x", table, "b", "v", "found", strict).collect()}
    place = bisect.bisect_left if strict else bisect.bisect_right
    want = {i: (f"v{bounds[n - 1]}" if (n := place(bounds, x)) else None) for i, x in enumerate(at)} | {9000: None}
    assert found == want
    assert asof.asof(df.limit(0), "x", table, "b", "v", "found").count() == 0
    assert {r.found for r in asof.asof(df, "x", table.limit(0), "b", "v", "found").collect()} == {None}


@pytest.mark.parametrize("window, stride", [((3, 5), (2, 3)), ((1, 1), (1, 1)), ((6, 7), (4, 4)), ((7, 2), (1, 1))])
def test_unfolded(spark, window, stride):
    a, b = np.arange(42).reshape(6, 7), np.arange(42).reshape(6, 7) * -1
    df = spark.createDataFrame([(1, a.ravel().tolist(), b.ravel().tolist()), (2, None, b.ravel().tolist())], "id int, a array<int>, b array<int>")
    got = {(r.id, r.frag_row, r.frag_col): r.pixels for r in fragments.unfolded(df, ["a", "b"], 6, 7, window, stride).collect()}
    want = {}
    for i, y in enumerate(range(0, 6 - window[0] + 1, stride[0])):
        for j, x in enumerate(range(0, 7 - window[1] + 1, stride[1])):
            part = np.s_[y : y + window[0], x : x + window[1]]
            want[1, i, j], want[2, i, j] = np.concatenate([a[part].ravel(), b[part].ravel()]).tolist(), None
    assert got == want


def test_fragments_in_sql(spark):
    table_functions.register(spark)
    got = spark.sql("SELECT h, f.* FROM VALUES (100), (40), (30), (CAST(NULL AS INT)) t(h), LATERAL fragments(h, 40, 0.1D) f").collect()
    plan = fragments.FragmentPlan(100, 40)
    assert {(r.h, r.frag_row, r.frag_col, r.y_offset, r.x_offset) for r in got} == {(100, i, j, y, x) for i, y in enumerate(plan.offsets) for j, x in enumerate(plan.offsets)} | {(40, 0, 0, 0, 0)}
    with pytest.raises(Exception, match="whole number"):
        spark.sql("SELECT * FROM VALUES ('a') t(h), LATERAL fragments(h, 40, 0.1D) f").collect()

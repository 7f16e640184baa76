"""Golden values, sources, sinks, streams and the vector index, on small fixtures of their own."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import geo, raster
from quadrille.functions.geo_numpy import ring_centroid
from quadrille.operators import composite, embed, fragments, grid, hillshade, metadata, vector_index
from quadrille.operators.grid import GridSpec
from quadrille.sources import images, readers, sinks, wkb
from quadrille.streaming import tagging


def test_utm_zones(spark):
    cases = [(-1.0, -174.34, "32701"), (48.0, -4.0, "32630"), (78.0, 13.0, "32633"), (-34.0, 19.7, "32734"), (-36.0, 175.7, "32760")]
    df = spark.createDataFrame(cases, "lat double, lon double, want string")
    assert df.where(geo.utm_epsg(F.col("lat"), F.col("lon")) != F.col("want")).isEmpty()


def test_golden_cells(spark):
    cases = [(40.85, 14.27, "454U_120R"), (51.5, -0.12, "573U_1L"), (-33.9, 18.4, "378D_169R"), (0.0, 0.0, "1D_1L"), (1e-9, 1e-9, "0U_0R"), (-85.5, 0.5, "946U_0R"), (89.0, 10.0, "946U_9R"), (0.05, 180.0, "0U_2003R"), (0.05, -180.0, "0U_2003R"), (None, 1.0, None), (float("nan"), 1.0, None)]
    df = grid.with_cell(spark.createDataFrame(cases, "lat double, lon double, want string"), "lat", "lon", GridSpec(10))
    assert [(r.grid_cell, r.want) for r in df.collect() if r.grid_cell != r.want] == []
    corners = spark.createDataFrame([("454U_119R", 40.778443, 14.115321), ("677D_317L", -60.808383, -58.373402)], "cell string, lat double, lon double")
    row, col = grid.cell_ints(F.col("cell"))
    found = grid.with_corner(corners.select("*", row.alias("grid_row_u"), col.alias("grid_col_r")), GridSpec(10)).collect()
    assert all(abs(r.corner_lat - r.lat) < 1e-6 and abs(r.corner_lon - r.lon) < 1e-6 for r in found)
    for dist, rows, points in ((50, 379, 204034), (100, 189, 51145), (1000, 19, 541)):
        assert (grid.grid_rows(spark, GridSpec(dist)).count(), grid.grid_points(spark, GridSpec(dist)).count()) == (rows, points)


def test_golden_windows(spark):
    cases = [(40.778443, 14.115321, (425008.136, 4514199.060, 435688.136, 4524879.060)), (-60.808383, -58.373402, (424935.144, 3257433.588, 435615.144, 3268113.588))]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "y double, x double")
    y, x = F.col("y"), F.col("x")
    east, north = geo.tm_forward(y, x, geo.utm_zone(y, x), y < 0)
    for r, (_, _, want) in zip(df.select(*[c.alias(n) for n, c in geo.product_window(east, north).items()]).collect(), cases):
        assert np.allclose([r.left, r.bottom, r.right, r.top], want, atol=0.1)


@pytest.mark.parametrize("height, size, overlap, stride, count, last", [(1068, 224, 13, 211, 5, 844), (1068, 384, 42, 342, 3, 684), (100, 32, -2, 34, 3, 68), (120, 32, 3, 29, 4, 88), (32, 32, 0, 32, 1, 0)])
def test_golden_fragments(height, size, overlap, stride, count, last):
    plan = fragments.FragmentPlan(height, size)
    assert (plan.overlap_pixels, plan.stride, len(plan.offsets), plan.offsets[-1]) == (overlap, stride, count, last)


def test_thumbnails(spark):
    rng = np.random.default_rng(0)
    vv, vh = rng.gamma(2, 0.1, 4096), rng.gamma(2, 0.05, 4096)
    vv[:5], vh[7:9] = -32768.0, -1.0

    def channel(x):
        mask, x = x != -32768.0, np.where(x < 0, x[x >= 0].min(), x)
        db = 10 * np.log10(np.maximum(x, 1e-10))
        return np.where(mask, (db - db[mask].min()) / (db[mask].max() - db[mask].min()) * 255, 0)

    r, b = channel(vv), channel(vh)
    want = np.stack([r, 255 * (r + b) / (r + b).max(), b], 1).astype(np.uint8)
    df = spark.createDataFrame([(vv.tolist(), vh.tolist()), (None, None)], "vv array<double>, vh array<double>")
    got, none = (x.rgb for x in df.select(raster.radar_thumbnail(F.col("vv"), F.col("vh")).alias("rgb")).collect())
    assert np.abs(np.array(got) - want.astype(int)).max() <= 1 and none is None
    dem = spark.createDataFrame([(rng.normal(size=64).tolist(),)], "d array<double>")
    shaded, gray = dem.select(raster.dem_thumbnail(F.col("d"), 8, 8), raster.dem_thumbnail(F.col("d"), 8, 8, False)).first()
    assert 0 <= min(shaded) and max(gray) >= 254 and min(gray) == 0


def test_hillshade_of_a_plane():
    flat, slope = hillshade.shade(np.zeros((5, 5))), hillshade.shade(np.add.outer(np.arange(6.0) ** 2, np.arange(6.0)))
    assert np.allclose(flat, np.sin(np.radians(45))) and slope.min() == 0 and slope.max() == 1


def test_composite(spark):
    x = np.random.default_rng(1).normal(size=(50, 5)) * [5, 3, 2, 0.1, 0.1]
    x[3] = composite.NODATA
    got = np.array(spark.createDataFrame([(x.ravel().tolist(),)], "p array<double>").select(composite.pca_rgb(F.col("p"), 5)).first()[0])
    centred = x - x.mean(0)
    pc = centred @ np.linalg.svd(centred, full_matrices=False)[2][:3].T
    for k in range(3):
        own = 255 * (pc[:, k] - pc[:, k].min()) / np.ptp(pc[:, k])
        turned = 255 - own
        others = np.arange(50) != 3
        assert min(np.abs(got[others, k] - own[others]).max(), np.abs(got[others, k] - turned[others]).max()) <= 1.01
    assert (got[3] == 0).all()


def test_pictures_and_rasters(spark):
    data = np.arange(20, dtype=np.float32).reshape(4, 5)
    lines = b"".join(bytes([0]) + bytes(range(6 * y, 6 * y + 6)) for y in range(3))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 3, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    df = spark.createDataFrame([(images.write_tiff(data, 100.0, 40.0, 10.0), png), (None, None)], "tif binary, thumbnail binary")
    r, none = df.select(images.decoded(F.col("tif")).alias("r"), images.picture(F.col("thumbnail")).alias("p")).collect()
    assert (r.r.height, r.r.width, r.r.left, r.r.top, r.r.right) == (4, 5, 100.0, 40.0, 150.0) and r.r.data == data.ravel().tolist()
    assert (r.p.height, r.p.width, r.p.channels) == (3, 2, 3) and r.p.data == list(range(18)) and none.r is None and none.p is None
    box = {"left": F.lit(110.0), "bottom": F.lit(10.0), "right": F.lit(130.0), "top": F.lit(30.0)}
    part, up = df.limit(1).select(raster.read_window(images.decoded(F.col("tif")), box), raster.read_window(images.decoded(F.col("tif")), box, True)).first()
    assert part.data == data[1:3, 1:3].ravel().tolist() and (part.left, part.bottom, part.right, part.top) == (110.0, 10.0, 130.0, 30.0)
    assert up.data == data[1:3, 1:3][::-1].ravel().tolist()


def test_archive_to_tree_and_embeddings(spark, tmp_path):
    tif, rows = images.write_tiff(np.ones((8, 8), np.float32)), []
    for i in range(6):
        rows.append((f"P{i}", f"{i}U_1R", "2024-01-01 00:00:00", tif, tif, b"png"))
    spark.createDataFrame(rows, "product_id string, grid_cell string, timestamp string, B04 binary, cloud_mask binary, thumbnail binary").coalesce(1).write.parquet(f"{tmp_path}/images")
    assert readers.parquet_files(spark, f"{tmp_path}/images").count() == 1
    archive = readers.archive(spark, f"{tmp_path}/images", ["product_id", "grid_cell", "B04", "thumbnail"])
    assert sorted(r.parquet_row for r in archive.collect()) == list(range(6))
    where = archive.select("parquet_url", "parquet_row", "grid_cell", "product_id").withColumns({"grid_row_u": F.split_part("grid_cell", F.lit("U"), F.lit(1)).cast("int"), "grid_col_r": F.lit(1)})
    where.withColumn("timestamp", F.lit("2024-01-01")).write.parquet(f"{tmp_path}/meta")
    meta = readers.read_metadata(spark, f"{tmp_path}/meta")
    assert dict(meta.dtypes)["timestamp"] == "timestamp_ntz"
    assert [r.parquet_row for r in metadata.locate(meta, "3U_1R").collect()] == [3]
    samples = readers.read_samples(meta.where("parquet_row < 2"), archive, ["B04"], [])
    assert samples.count() == 2 and samples.first().B04.data == [1.0] * 64
    assert len(list(readers.rows_one_by_one(meta))) == 6
    sinks.unpack_files(archive, str(tmp_path / "tree"), "L2A", ["B04"])
    assert readers.unpacked_files(spark, f"{tmp_path}/tree/L2A").count() == 12
    table = readers.SampleTable(meta, f"{tmp_path}/tree/L2A", ["B04"], [], raster_transform=lambda c: F.transform(c["data"], lambda x: x * 2))
    assert len(table) == 6 and table[2].product_id == "P2" and table[2].B04 == [2.0] * 64
    with pytest.raises(IndexError):
        table[6]
    sinks.unpack(archive, f"{tmp_path}/rows", "L2A")
    assert spark.read.parquet(f"{tmp_path}/rows").where("grid_row = '3U'").first().path == "L2A/3U/3U_1R/P3"
    decoded = archive.select("product_id", "grid_cell", images.decoded(F.col("B04"))["data"].alias("B04"), F.lit(8).alias("B04_size"))
    full = meta.withColumns({"crs": F.lit("EPSG:32633"), "left": F.lit(425008.0), "bottom": F.lit(4514199.0), "right": F.lit(435688.0), "top": F.lit(4524879.0), "event_id": F.col("parquet_row")})
    embed.embed_archive(decoded, full.drop("parquet_url"), embed.BandStatistics(["B04"], 4), f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 6 * len(fragments.FragmentPlan(8, 4).offsets) ** 2 and out.where("size(embedding) <> 4 OR utm_crs <> 'EPSG:32633'").isEmpty()
    sinks.write_geojson_lines(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), f"{tmp_path}/g", sinks.geojson_feature("Point", F.array("x", "y"), name=F.lit("a")))
    assert '"coordinates":[1.0,2.0]' in spark.read.text(f"{tmp_path}/g").first().value


def test_points_and_wkb(spark, tmp_path):
    (tmp_path / "p.csv").write_bytes("Name,Latitude,Longitude\nM\xfcnchen,48.1,11.6\n".encode("ISO-8859-1"))
    assert readers.read_points(spark, str(tmp_path / "p.csv")).first().Name == "München"
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 0.0)]
    body = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<dd", *p) for p in ring)
    df = spark.createDataFrame([(body,), (struct.pack(">BIdd", 0, 1, 7.0, 8.0),), (None,)], "geometry binary")
    shape, point, none = (r.g for r in df.select(wkb.geometry(F.col("geometry")).alias("g")).collect())
    assert shape.kind == "Polygon" and [(p.x, p.y) for p in shape.points] == ring and (point.kind, point.points[0].y) == ("Point", 8.0) and none is None
    back = spark.createDataFrame([(1.5, 2.5)], "x double, y double").select(wkb.geometry(wkb.point(F.col("x"), F.col("y"))).alias("g")).first().g
    assert (back.points[0].x, back.points[0].y) == (1.5, 2.5)
    assert np.allclose(ring_centroid(ring), (8 / 3, 2 / 3))


def test_stream(spark, tmp_path):
    rows = [(float(i % 3), 1.5, f"P{i % 2}", f"2024-01-01 00:0{i}:00") for i in range(6)] * 2
    spark.createDataFrame(rows, "lat double, lon double, product_id string, t string").withColumn("timestamp", F.to_timestamp("t")).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    for name, df, mode in (("tagged", tagging.tagged_stream(stream(), GridSpec(100), "lat", "lon"), "append"), ("counted", tagging.cell_counts(stream(), GridSpec(100), "lat", "lon"), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.table("tagged").count() == 6 and spark.table("counted").agg(F.sum("samples")).first()[0] == 12


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0]), (1002, [float("nan")] * 16)], "vec_id long, embedding array<double>").cache()
    q = x[7].tolist()
    best = [r.vec_id for r in vector_index.exact_search(df, q, 3).collect()]
    assert best == np.argsort(((x - x[7]) ** 2).sum(1))[:3].tolist()
    index = vector_index.VectorIndex.train(df, 8, 4, 32)
    index.write(index.encode(df), f"{tmp_path}/index")
    loaded, codes = vector_index.VectorIndex.load(spark, f"{tmp_path}/index")
    assert np.array_equal(loaded.centroids, index.centroids) and codes.count() == 600
    unit = x / np.sqrt((x**2).sum(1, keepdims=True))
    hits = []
    for k in (7, 99, 300):
        found = {r.vec_id for r in loaded.search(codes, x[k], 10, 6, rerank=(df, 20)).collect()}
        hits.append(len(found & set(np.argsort(((unit - unit[k]) ** 2).sum(1))[:10].tolist())) / 10)
    assert np.mean(hits) >= 0.9
    meta = df.select("vec_id", (F.col("vec_id") % 5).alias("file"))
    told = vector_index.TextSearch(lambda text: x[int(text)], loaded, codes, meta).search("7", 2).collect()
    assert told[0].vec_id == 7 and told[0].file == 2
    lists = vector_index.nearest_centroid(df, index.centroids).where("vec_id >= 1000").collect()
    assert all(r.list_id is None for r in lists)

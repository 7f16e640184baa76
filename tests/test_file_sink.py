"""The sink that commits, GeoParquet on top of it, and pictures computed from bands."""

import json
import os
import struct
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quadrille.functions import raster
from quadrille.operators import coverage, thumbnails
from quadrille.operators.hillshade import shade
from quadrille.sources import file_sink, geoparquet, images, wkb

ROOT = Path(__file__).resolve().parents[1]


def tree(root, jobs=False) -> dict[str, bytes]:
    return {str(p.relative_to(root)): p.read_bytes() for p in Path(root).rglob("*") if p.is_file() and (jobs or p.relative_to(root).parts[0] != "_jobs")}


def settled(root) -> None:
    """Tasks of a failed job may run on for a moment; then nothing is left that `sweep` does not remove."""
    time.sleep(3)
    file_sink.sweep(str(root), 0)
    assert tree(root, True) == tree(root) and not list((Path(root) / "_jobs").iterdir())


def test_writes_files(spark, tmp_path):
    rows = [(f"a/{i % 7}/{i}.bin", b"%d" % i) for i in range(200)] + [("empty", b""), (None, b"x"), ("nothing", None)]
    df = spark.createDataFrame(rows, "path string, content binary").withColumn("extra", F.lit(1)).repartition(5)
    assert file_sink.write_files(df, str(tmp_path)) == 201
    assert tree(tmp_path) == {p: c for p, c in rows if p and c is not None}
    again = spark.createDataFrame([("a/0/0.bin", b"new"), ("./b", b"1")], "path string, content binary")
    assert file_sink.write_files(again, f"file:{tmp_path}") == 2
    assert tree(tmp_path)["a/0/0.bin"] == b"new" and tree(tmp_path)["b"] == b"1" and len(tree(tmp_path)) == 202
    assert file_sink.write_files(again.limit(0), str(tmp_path)) == 0 and len(tree(tmp_path)) == 202
    for bad in ("../x", "/x", "_jobs/x", "a/../../x", "."):
        with pytest.raises(Exception, match="below the root"):
            file_sink.write_files(spark.createDataFrame([(bad, b"")], "path string, content binary"), str(tmp_path))
    with pytest.raises(ValueError, match="2 rows"):
        file_sink.write_files(spark.createDataFrame([("c//d", b"1"), ("./c/d", b"2")], "path string, content binary"), str(tmp_path))
    assert len(tree(tmp_path)) == 202
    settled(tmp_path)


def test_failed_job_leaves_nothing(spark, tmp_path):
    (tmp_path / "kept").write_bytes(b"1")
    df = spark.range(0, 100, 1, 4).select(F.concat(F.lit("f"), F.col("id")).alias("path"), F.when(F.col("id") == 90, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="lost"):
        file_sink.write_files(df, str(tmp_path))
    assert tree(tmp_path) == {"kept": b"1"}
    settled(tmp_path)


def test_attempts_and_resume(spark, tmp_path):
    """Of two attempts of a task only the accepted one counts; a commit whose moves stopped half-way is finished."""
    batch = pa.record_batch({"path": ["a/x", "a/y", "z"], "content": pa.array([b"1", b"2", b"3"], pa.binary())})
    writer = file_sink.FileWriter({"path": str(tmp_path), "job": "j"})
    (tmp_path / "_jobs/j").mkdir(parents=True)

    def broken():
        yield batch.slice(0, 2)
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    assert tree(tmp_path) == {} and tree(tmp_path, True)  # nothing in place before the commit
    assert file_sink.resume(spark, str(tmp_path)) == 0
    writer.commit([second, None])
    os.makedirs(tmp_path / "a")
    os.rename(tmp_path / "_jobs/j" / second.attempt / "0", tmp_path / "a/x")  # the driver was lost here
    assert first.attempt != second.attempt and file_sink.resume(spark, str(tmp_path)) == 3
    assert tree(tmp_path) == {"a/x": b"1", "a/y": b"2", "z": b"3"}
    assert file_sink.resume(spark, str(tmp_path)) == 0


RETRIED = """
import os, sys
from pyspark.sql import SparkSession, functions as F
from quadrille.sources import file_sink
root, mark = sys.argv[1:]
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
@F.udf("binary")
def content(i):
    if i == 77 and not os.path.exists(mark):
        open(mark, "w").close()
        raise RuntimeError("lost")
    return b"%d" % i
print(file_sink.write_files(spark.range(0, 100, 1, 3).select(F.concat(F.lit("d/"), "id").alias("path"), content("id").alias("content")), root))
"""


def test_retried_task_writes_once(tmp_path):
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", RETRIED, str(tmp_path / "out"), str(tmp_path / "mark")], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip() == "100", done.stderr[-2000:]
    assert (tmp_path / "mark").exists() and tree(tmp_path / "out") == {f"d/{i}": b"%d" % i for i in range(100)}


SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (1.0, 1.0)]
SHAPES = [
    ("Point", [[[(-3.0, 7.5)]]]), ("LineString", [[SQUARE[:3]]]), ("Polygon", [[SQUARE, HOLE]]), ("MultiPoint", [[[(1.0, 2.0)]], [[(3.0, 4.0)]]]),
    ("MultiLineString", [[SQUARE[:2]], [HOLE[:2]]]), ("MultiPolygon", [[SQUARE, HOLE], [[(x + 10, y) for x, y in SQUARE]]]), ("MultiPolygon", []), ("Polygon", [[]]),
]


def test_shapes(spark):
    for kind, parts in SHAPES:
        assert wkb.parsed(wkb.packed(kind, parts)) == (kind, parts)
    high = struct.pack("<BIIIddd", 1, 1003, 1, 1, 5.0, 6.0, 7.0), struct.pack(">BIIdd", 0, 0x20000001, 4326, 8.0, 9.0), struct.pack("<BIddd", 1, 0x80000001, 1.0, 2.0, 3.0)
    assert [wkb.parsed(h) for h in high] == [("Polygon", [[[(5.0, 6.0)]]]), ("Point", [[[(8.0, 9.0)]]]), ("Point", [[[(1.0, 2.0)]]])]
    df = spark.createDataFrame([(i, bytearray(wkb.packed(*s))) for i, s in enumerate(SHAPES)] + [(99, None)], "id int, geometry binary")
    back = df.select("id", "geometry", wkb.shape(F.col("geometry")).alias("s")).withColumn("b", wkb.binary(F.col("s"))).orderBy("id").collect()
    assert all(r.b == r.geometry for r in back) and back[-1].s is None
    assert [(r.s.kind, [[[tuple(p) for p in ring] for ring in rings] for rings in r.s.parts]) for r in back[:-1]] == SHAPES
    with pytest.raises(ValueError, match="kind 7"):
        wkb.parsed(struct.pack("<BII", 1, 7, 0))


def test_geoparquet(spark, tmp_path):
    crs = {"type": "GeographicCRS", "name": "WGS 84", "id": {"authority": "EPSG", "code": 4326}}
    ring = lambda a: F.array(*[F.struct((F.col("x") + p * a).alias("x"), (F.col("y") + q * a).alias("y")) for p, q in ((0, 0), (1, 0), (1, 1), (0, 0))])
    df = spark.range(0, 400, 1, 4).select("id", (F.col("id") % 100 / 10).alias("x"), (F.floor(F.col("id") / 100) * 20).cast("double").alias("y"))
    df = df.withColumn("geometry", F.when(F.col("id") % 50 != 3, wkb.binary(wkb.polygon(ring(1.0), ring(0.5))))).withColumn("tags", F.array(F.col("id")))
    root = f"{tmp_path}/g"
    assert geoparquet.write_geoparquet(df, root, crs=crs, rows=30) == 4
    found = geoparquet.geo_metadata(spark, root).orderBy("ymin").collect()
    assert [(r.xmin, r.ymin, r.xmax, r.ymax) for r in found] == [(0.0, 20.0 * k, 10.9, 20.0 * k + 1) for k in range(4)]
    assert all(json.loads(r.crs) == crs and r.geometry_types == ["Polygon"] and (r.encoding, r.primary_column) == ("WKB", "geometry") for r in found)
    assert sorted(map(tuple, geoparquet.read_geoparquet(spark, root).select("id", "geometry", "x").collect())) == sorted(map(tuple, df.select("id", "geometry", "x").collect()))
    near = geoparquet.read_in_box(spark, root, 2.0, 19.0, 3.0, 20.5)
    assert {r.id // 100 for r in near.collect()} == {1} and near.count() == 100
    assert geoparquet.read_in_box(spark, root, 50.0, 50.0, 51.0, 51.0).count() == 0
    file = found[0].path.removeprefix("file:")
    assert pq.ParquetFile("/" + file.lstrip("/")).num_row_groups == 4
    spark.range(1).write.parquet(f"{tmp_path}/plain")
    assert geoparquet.geo_metadata(spark, f"{tmp_path}/plain").first().version is None
    assert geoparquet.write_geoparquet(df.where("id < 0"), f"{tmp_path}/none") == 0
    with pytest.raises(ValueError, match="column of well-known binary"):
        geoparquet.write_geoparquet(df, root, "x")


def test_thumbnails_of_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    b = [rng.integers(0, 9000, (5, 4)).astype(np.uint16) for _ in range(3)]
    vv, vh = (rng.gamma(2, 0.1, (5, 4)).astype(np.float32) for _ in range(2))
    dem = rng.normal(size=(6, 3)).astype(np.float32)
    rows = [(1, *[bytearray(images.write_tiff(x)) for x in (*b, vv, vh, dem)]), (2, *[None] * 6)]
    df = spark.createDataFrame(rows, "id int, B04 binary, B03 binary, B02 binary, vv binary, vh binary, DEM binary")
    made = df.select("id", thumbnails.optical(*map(F.col, ("B04", "B03", "B02"))).alias("s2"), thumbnails.radar(F.col("vv"), F.col("vh")).alias("s1"), thumbnails.elevation(F.col("DEM")).alias("dem"))
    row, none = made.orderBy("id").collect()
    want = (np.clip(1.3 * (np.stack(b, -1) / 10_000) ** 0.6, 0, 1) * 255).astype(np.uint8)
    assert np.abs(images.png(row.s2).astype(int) - want).max() <= 1 and (none.s2, none.s1, none.dem) == (None,) * 3
    assert np.array_equal(images.png(row.dem)[..., 0], (255 * shade(dem.astype(float))).astype(np.uint8))
    radar, columns = images.png(row.s1), df.where("id = 1").select(raster.radar_thumbnail(images.decoded(F.col("vv"))["data"], images.decoded(F.col("vh"))["data"]).alias("p")).first().p
    assert np.abs(radar.reshape(-1, 3).astype(int) - np.array(columns)).max() <= 1
    assert radar.shape == (5, 4, 3) and radar[..., 0].max() == 255 and radar[..., 1].max() == 255 and radar.min(axis=(0, 1))[2] == 0
    files = made.select(F.concat(F.lit("t/"), "id", F.lit(".png")).alias("path"), F.col("s2").alias("content"))
    assert file_sink.write_files(files, str(tmp_path)) == 1 and tree(tmp_path) == {"t/1.png": row.s2}


def test_mixed_coverage(spark):
    a, b = (spark.createDataFrame(rows, "y int, x int, value int") for rows in ([(0, 0, 255), (0, 1, 255), (0, 1, 255)], [(0, 1, 255), (5, 5, 255)]))
    assert sorted(map(tuple, coverage.mixed_coverage(a, b).collect())) == [(0, 0, 0, 255, 0), (0, 1, 255, 255, 255), (5, 5, 0, 0, 255)]

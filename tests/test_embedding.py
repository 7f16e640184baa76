"""Inference across images: what the model sees, and that rows do not depend on how images lie in partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import embed
from quadrille.operators.fragments import FragmentPlan


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(23):
        side = (20, 12, 8)[i % 3]
        fine, coarse = rng.normal(size=side * side).round(3).tolist(), rng.normal(size=(side // 2) ** 2).round(3).tolist()
        rows.append((fine if i != 5 else None, side, coarse, side // 2, f"{i}U_1R", i, 1, f"P{i}", f"2024-01-{i + 1:02d} 00:00:00", "EPSG:32733" if i % 2 else "EPSG:32633", 4e5, 4.5e6, 4e5 + 10 * side, 4.5e6 + 10 * side))
    df = spark.createDataFrame(rows, "B04 array<double>, B04_size int, B08 array<double>, B08_size int, grid_cell string, grid_row_u int, grid_col_r int, product_id string, timestamp string, crs string, left double, bottom double, right double, top double")
    return df.withColumn("timestamp", F.to_timestamp_ntz("timestamp"))


FRAGMENTS = {n: len(FragmentPlan(n, 8).offsets) ** 2 for n in (20, 12, 8)}


def counting(marks):
    """A loader that notes each load by a file, and a model that tells the size of the call it was part of."""
    def load():
        import uuid

        open(f"{marks}/{uuid.uuid4().hex}", "w").close()
        return lambda batch: np.stack([batch.mean((1, 2, 3)), np.full(len(batch), len(batch))], 1).astype(np.float32)

    return load


def test_fixed_batches_across_images(spark, images, tmp_path):
    (tmp_path / "m").mkdir()
    model = embed.LoadedModel(["B04", "B08"], (8, 8), counting(str(tmp_path / "m")))
    total = sum(FRAGMENTS[(20, 12, 8)[i % 3]] for i in range(23) if i != 5)
    df = images.repartition(3, "product_id")
    found = embed.embed(df, model, batch=7).select(F.spark_partition_id().alias("p"), "embedding").collect()
    assert len(found) == total
    used = df.where("B04 IS NOT NULL").select(F.spark_partition_id().alias("p")).distinct().count()
    assert len(list((tmp_path / "m").iterdir())) == used  # loaded once a partition
    for p in {r.p for r in found}:
        sizes = [int(r.embedding[1]) for r in found if r.p == p]
        last = len(sizes) % 7
        assert sizes == [7] * (len(sizes) - last) + [last] * last
    (tmp_path / "n").mkdir()
    none = embed.embed(images.where("B04 IS NULL"), embed.LoadedModel(["B04", "B08"], (8, 8), counting(str(tmp_path / "n"))))
    assert none.count() == 0 and not list((tmp_path / "n").iterdir())


def test_equal_for_any_partitioning(spark, images):
    model, rows = embed.BandStatistics(["B04", "B08"], 8), []
    for n, batch in ((1, 64), (5, 3), (8, 1)):
        rows.append(sorted((r.unique_id, *r.embedding, *r.pixel_bbox, r.utm_footprint) for r in embed.embed(images.repartition(n), model, batch=batch).collect()))
    assert rows[0] == rows[1] == rows[2]
    own = images.where("product_id = 'P0'").first()
    plain = np.stack([np.array(own.B04).reshape(20, 20), np.repeat(np.repeat(np.array(own.B08).reshape(10, 10), 2, 0), 2, 1)]).astype(np.float32)
    got = {tuple(r.pixel_bbox): r.embedding for r in embed.embed(images, model, transposed=False).where("product_id = 'P0'").collect()}
    for y in FragmentPlan(20, 8).offsets:
        for x in FragmentPlan(20, 8).offsets:
            assert np.allclose(got[x, y, x + 8, y + 8], model(plain[None, :, y : y + 8, x : x + 8])[0], atol=1e-6)

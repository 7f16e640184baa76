"""The residual index: recall, batches, two-level training, blocks, and adds by file."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quadrille.operators import index_files, vector_index
from quadrille.operators.vector_index import VectorIndex
from quadrille.plans import queries

N, D, LISTS, PROBES = 50_000, 32, 160, 16


def clustered(n, width, centres, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    x = middle[rng.integers(0, centres, n)] + 0.35 * rng.normal(size=(n, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def saved(x, path, first=0):
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(first, first + len(x))), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), path)


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """50,000 vectors with an index of them, and the codes."""
    folder = tmp_path_factory.mktemp("large")
    x = clustered(N, D, 400, 1)
    for k in range(4):
        saved(x[k * N // 4 : (k + 1) * N // 4], folder / f"part-{k}.parquet", k * N // 4)
    df = spark.read.parquet(str(folder))
    index = VectorIndex.train(vector_index.sample_per_file(df.withColumn("file", F.input_file_name()), "file", "vec_id", 5000, 20_000), LISTS, 8)
    index.write(index.encode(df), f"{folder}/index")
    return x, df, *VectorIndex.load(spark, f"{folder}/index")


def test_recall_with_a_tenth_of_the_lists(spark, large):
    x, df, index, codes = large
    assert index.centroids.shape == (LISTS, D) and PROBES <= LISTS // 10 and codes.count() == N
    asks = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = index.search_many(codes, asks, 10, PROBES, rerank=(df, 50)).collect()  # 500 reranked: a hundredth of the table
    by = {}
    for r in found:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(by[q] & set(np.argsort(-(x @ x[q]), kind="stable")[:10].tolist())) / 10 for q in range(0, N, 50)]
    print("recall at 10:", np.mean(hits))
    assert len(hits) == 1000 and np.mean(hits) >= 0.9


def test_batch_is_single_searches(spark, large):
    x, df, index, codes = large
    rng = np.random.default_rng(2)
    q = x[rng.integers(0, N, 1000)] + 0.1 * rng.normal(size=(1000, D))
    asks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(5000, None), (5001, [1.0])], "query_id long, embedding array<double>")
    batch = index.search_many(codes, asks, 5, PROBES, code_rows=300, query_rows=40).collect()  # many slices of both
    by = {}
    for r in sorted(batch, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    # all 1,000 by plain arithmetic on the codes, two of them also as searches of their own
    own = codes.toPandas().sort_values("vec_id")
    code, lists, ids = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(N, -1), own["list_id"].to_numpy(), own["vec_id"].to_numpy()
    unit = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32)
    assert set(by) == set(range(1000))
    for i in range(1000):
        near = np.argsort(((index.centroids.astype(np.float64) - unit[i]) ** 2).sum(1), kind="stable")[:PROBES]
        rows = np.flatnonzero(np.isin(lists, near))
        tables = {n: vector_index.distances(unit[i] - index.centroids[n], index.codebooks) for n in near}
        stacked = np.zeros((LISTS, *index.codebooks.shape[:2]))
        for n, t in tables.items():
            stacked[n] = t
        score = stacked[lists[rows][:, None], np.arange(code.shape[1])[None], code[rows]].sum(1)
        best = np.lexsort((ids[rows], score))[:5]
        assert [round(s, 6) for _, s in by[i]] == [round(s, 6) for s in score[best]]
    for i in (3, 700):
        single = index.search(codes, q[i], 5, PROBES).collect()
        assert [(r.vec_id, round(r.score, 6)) for r in single] == by[i]


def test_single_search_reads_probed_lists_only(spark, large):
    x, df, index, codes = large
    plan = index.search(codes, x[0], 5, 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list_id" in plan.replace("isnotnull(", "").replace("#", " ").replace("PartitionFilters: [(", "PartitionFilters: [") or "list_id" in plan.split("PartitionFilters:")[1][:60]


def error(x, c):
    return float(((x - c[vector_index.nearest_rows(x, c)[:, 0]]) ** 2).sum())


def test_two_levels_are_nearly_flat(spark):
    x = clustered(6000, 16, 150, 5)
    x[:2000] = x[0] + 0.01 * x[:2000]  # a third of all vectors in one place
    sample = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    flat = vector_index.kmeans(sample, 100, "v", 0).astype(np.float32)
    two = vector_index.kmeans_two_level(sample, 100)
    print("error, two levels by flat:", error(x, two) / error(x, flat))
    assert two.shape == (100, 16) and error(x, two) <= 1.05 * error(x, flat)


def test_blocks_stay_small():
    rng = np.random.default_rng(0)
    c = rng.normal(size=(32_768, 64)).astype(np.float32)
    x = rng.normal(size=(300, 64)).astype(np.float32)
    got = vector_index.nearest_rows(x, c, 3)
    away = (c.astype(np.float64) ** 2).sum(1) / 2 - x.astype(np.float64) @ c.T.astype(np.float64)
    assert (got == np.argsort(away, axis=1, kind="stable")[:, :3]).all()
    c = np.zeros((32_768, 1152), np.float32)  # the largest index there is: one array of 151 MB, made once
    c[np.arange(32_768), np.arange(32_768) % 1152] = 1 + np.arange(32_768) // 1152
    x = np.eye(1152, dtype=np.float32)[:64]
    tracemalloc.start()
    got = vector_index.nearest_rows(x, c, 32)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:, 0].tolist() == list(range(64)) and most < 256e6


def test_shares():
    counts = np.array([100, 0, 1, 50])
    assert vector_index.shares(counts.astype(float), counts, 10).sum() == 10 and vector_index.shares(counts.astype(float), counts, 10)[1] == 0
    assert vector_index.shares(np.array([1.0, 1.0]), np.array([2, 3]), 50).tolist() == [2, 3]
    assert vector_index.shares(np.array([1000.0, 0.0, 0.0]), np.array([9, 1, 1]), 3).tolist() == [1, 1, 1]
    assert vector_index.shares(np.array([0.0, 0.0]), np.array([5, 5]), 6).tolist() == [3, 3]
    assert vector_index.shares(np.array([9.0, 1.0]), np.array([1000, 1000]), 20).tolist() == [18, 2]


def test_adds_by_file(spark, tmp_path):
    x = clustered(900, 16, 20, 3)
    (tmp_path / "files").mkdir()
    index = VectorIndex.train(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), 8, 4, 16)
    at, files = f"{tmp_path}/grown", str(tmp_path / "files")
    index_files.create(spark, index, at)
    assert index_files.codes(spark, at).count() == 0
    held = lambda path: sorted((r.vec_id, r.file, r.row_idx, r.list_id, bytes(r.code)) for r in index_files.codes(spark, path).collect())
    saved(x[:400], tmp_path / "files/a.parquet")
    saved(x[400:600], tmp_path / "files/b.parquet")
    assert index_files.add(spark, at, files) == 2
    first = held(at)
    assert len(first) == 600 and index_files.add(spark, at, files) == 0 and held(at) == first
    saved(x[600:], tmp_path / "files/c.parquet")
    assert index_files.add(spark, at, files) == 1
    grown = held(at)
    assert set(first) <= set(grown) and len(grown) == 900
    once = f"{tmp_path}/once"
    index_files.create(spark, index, once)
    assert index_files.add(spark, once, files) == 3 and held(once) == grown
    # codes without a manifest, as an add leaves them that fails before its commit, aren't seen, and the add is done again
    spark.read.parquet(f"{at}/codes").limit(5).withColumn("batch", F.lit("broken")).write.mode("append").partitionBy("batch", "list_id").parquet(f"{at}/codes")
    assert held(at) == grown
    found = index.search(index_files.codes(spark, at), x[450], 1, 8).first()
    assert found.vec_id == "b.parquet#50"
    saved(x[:10], tmp_path / "files/a.parquet")
    with pytest.raises(ValueError, match="a.parquet"):
        index_files.add(spark, at, files)


def test_batch_query_recall_on_random_directions(spark, tmp_path):
    """Directions without clusters, as the driver's tables have them: a tenth of the lists isn't enough there."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [*list(x), None, np.full(64, np.nan, np.float32), np.ones(3, np.float32)]
    table = pa.table({"vec_id": pa.array(np.arange(len(rows)) * 5), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array(np.zeros(len(rows), np.int64))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    by = {}
    for r in queries.queries()["ivf_pq_batch"](spark, str(tmp_path)).collect():
        by.setdefault(r.query_id // 5, []).append((r["rank"], r.vec_id // 5, r.score))
    asks = range(0, 4000, 4)
    assert set(by) == set(asks) and all(sorted(t[0] for t in own) == list(range(1, 11)) for own in by.values())
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    away = 2 - 2 * unit @ unit[list(asks)].T
    hits = [len({i for _, i, _ in by[q]} & set(np.argsort(away[:, j], kind="stable")[:10].tolist())) / 10 for j, q in enumerate(asks)]
    assert all(abs(s - away[i, j]) < 1e-9 for j, q in enumerate(asks) for _, i, s in by[q])
    assert np.mean(hits) >= 0.9


def test_copies_tie_by_id_in_any_slices(spark):
    x = clustered(3000, 16, 20, 8)
    x[::3] = x[0]  # 1,000 copies, in one list
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = VectorIndex.train(df, 24, 4, 64)
    codes, asks = index.encode(df).persist(), df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    found = [sorted(map(tuple, index.search_many(codes, asks, 7, 6, code_rows=c, query_rows=q).select("query_id", "rank", "vec_id", "score").collect())) for c, q in ((1 << 16, 1024), (128, 16))]
    assert found[0] == found[1]
    assert [v for q, _, v, _ in found[0] if q == 30] == [0, 3, 6, 9, 12, 15, 18]
    first, slices, total = index.dealt(codes, 128)
    assert slices.max() >= 8 and total < (slices > 0).sum() + slices.max()  # small lists share shards, the crowded one has several
    codes.unpersist()


def test_flat_training(spark):
    x = clustered(6000, 16, 150, 5)
    sample = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    assert error(x, vector_index.kmeans_flat(sample, 100)) <= 1.05 * error(x, vector_index.kmeans(sample, 100, "v", 0).astype(np.float32))
    few = spark.createDataFrame([(v.tolist(),) for v in np.repeat(x[:5], 40, axis=0)], "v array<double>")
    got = vector_index.kmeans_flat(few, 16)
    assert got.shape == (5, 16) and error(x[:5], got) < 1e-9

"""Approximate nearest neighbours by cross-polytope hashing.

A cross-polytope hash turns unit vectors by a pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) and takes the nearest signed axis. Each table concatenates as many hashes, the last ones of fewer axes, as
give buckets of about `bucket` vectors, so the number of buckets grows with the vectors. A query probes the buckets
that it would fall into after the least turn: the cost of an axis is the square of what its coordinate lacks to the
largest one, and costs of the hashes add up. What lies in the probed buckets is ranked exactly by the inner product
of the original vectors in double precision.

The number of probes is fitted: for a sample of `fit_queries` queries, those whose ids hash least, the true nearest
are found by brute force, and so many probes are taken that `recall` of them lie in a probed bucket of some table.

Norms: the largest inner product is wanted, so where norms differ, vectors are hashed with one more coordinate that
brings all candidates to the largest norm (queries get 0 there), which turns it into a question of angles.

Index vectors and queries meet by (table, cell, slice), a cell being some neighbouring buckets; within it each bucket
is multiplied with the queries that probe it. A cell of many vectors (copies of one vector fall into one bucket) is
dealt into slices by id hash, and so are the queries of a cell that very many probe; every slice of the one meets
every slice of the other. A first pass over each query's own buckets gives k scores to beat, so that the whole search
returns only what can still be among the k. The driver sees the sample and its neighbours, never bucket counts.

Edge cases: null and zero vectors, and those with null or non-finite components or another length than most, take no
part, neither as queries nor as candidates; null ids take no part; of rows with one id the least vector counts; ties
go to the smaller id; with fewer than k candidates in the probed buckets all of them are returned, and a table of
`bucket` vectors or fewer is one bucket; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (their length a power of two), scaled to keep norms."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


def axes(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Nearness of the rows to each signed axis of a table's rotation: (rows, 2 x padded dimension)."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), n))
    padded[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, table])
    for _ in range(3):
        padded = hadamard(padded * rng.choice([-1.0, 1.0], n))
    return np.concatenate([padded, -padded], 1)


def _stacked(batch: pa.RecordBatch, name: str = "v") -> tuple[np.ndarray, np.ndarray]:
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return batch.column("id").to_numpy(zero_copy_only=False), flat.reshape(len(batch), -1).astype(np.float64)


def usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, v (array of float, or of double unless the column has floats) of the rows that take part, one a vector id."""
    kind = "array<float>" if dict(df.dtypes)[vector_column] == "array<float>" else "array<double>"
    v = F.col(vector_column).cast(kind)
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(whole)
    rows = written(rows.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (width.n if width else 0))


@dataclass(frozen=True)
class Polytopes:
    """The hashes of all tables. `sizes`: axes of each of a table's concatenated hashes; `top`: the norm that vectors are lifted to, or 0."""

    tables: int
    sizes: tuple[int, ...]
    top: float
    seed: int

    @classmethod
    def of(cls, width: int, vectors: int, bucket: int, tables: int, top: float, seed: int) -> Polytopes:
        """As many axes in all as leave about `bucket` vectors for each combination of signed axes."""
        most, left, sizes = 1 << max(1, (width + (top > 0) - 1).bit_length()), vectors / bucket, []
        while left > 1.5:
            sizes.append(min(most, 1 << max(0, round(np.log2(left / 2)))))
            left /= 2 * sizes[-1]
        return cls(tables, tuple(sizes), top, seed)

    def placed(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors to hash."""
        if self.top:
            last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top**2 - (x**2).sum(1), 0))
            x = np.concatenate([x, last[:, None]], 1)
        return x / np.sqrt((x**2).sum(1, keepdims=True))

    def nearness(self, unit: np.ndarray, table: int, k: int) -> np.ndarray:
        """Coordinates of the rows along the signed axes of a table's k-th hash."""
        n = self.sizes[k]
        turned = axes(unit, 64 * table + k, self.seed)
        half = turned.shape[1] // 2
        return np.concatenate([turned[:, :n], turned[:, half : half + n]], 1)

    def buckets(self, unit: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(unit), np.int64)
        for k, n in enumerate(self.sizes):
            code = code * (2 * n) + self.nearness(unit, table, k).argmax(1)
        return code

    def probes(self, unit: np.ndarray, table: int, most: int) -> np.ndarray:
        """The buckets of least cost for each row, in that order: (rows, at most `most`)."""
        cost, code = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
        for k, n in enumerate(self.sizes):
            near = self.nearness(unit, table, k)
            own = (near.max(1, keepdims=True) - near) ** 2
            best = np.argsort(own, 1, kind="stable")[:, :most]  # a cheap combination has cheap parts only
            own = np.take_along_axis(own, best, 1)
            cost = (cost[:, :, None] + own[:, None, :]).reshape(len(unit), -1)
            code = (code[:, :, None] * (2 * n) + best[:, None, :]).reshape(len(unit), -1)
            first = np.argsort(cost, 1, kind="stable")[:, :most]
            cost, code = np.take_along_axis(cost, first, 1), np.take_along_axis(code, first, 1)
        return code


def exact(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """query_id, vec_id, score, v of the k nearest of a few queries, by brute force over all vectors; at most len(ids) x k rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = _stacked(batch)
            if not len(own):
                continue
            scores = queries @ x.T
            scores[ids[:, None] == own[None, :]] = -np.inf
            best = np.argsort(-scores, 1, kind="stable")[:, :k]
            row, col = np.repeat(np.arange(len(ids)), best.shape[1]), best.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(own[col]), pa.array(scores[row, col]), batch.column("v").take(pa.array(col))], ["query_id", "vec_id", "score", "v"])

    kind = dict(vectors.dtypes)["v"]
    found = vectors.mapInArrow(run, f"query_id long, vec_id long, score double, v {kind}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("score") > float("-inf"))).toPandas()


def fitted_probes(hashes: Polytopes, vectors: DataFrame, queries, k: int, fit_queries: int, recall: float, most: int = 4096) -> int:
    """The number of probes a table with which `recall` of the sample's true neighbours lie in a probed bucket of some table."""
    sample = vectors.where(queries).orderBy(F.xxhash64("id"), "id").limit(fit_queries).toPandas()
    if not len(sample) or not hashes.sizes:
        return 1
    q = np.stack(sample["v"].to_numpy()).astype(np.float64)
    true = exact(vectors, sample["id"].to_numpy(), q, k)
    if not len(true):
        return 1
    asks = {i: n for n, i in enumerate(sample["id"].tolist())}
    row = np.array([asks[i] for i in true["query_id"]])
    near, asked = hashes.placed(np.stack(true["v"].to_numpy()).astype(np.float64), False), hashes.placed(q, True)
    rank = np.full(len(row), most)
    for t in range(hashes.tables):
        hit = hashes.probes(asked, t, most)[row] == hashes.buckets(near, t)[:, None]
        rank = np.minimum(rank, np.where(hit.any(1), hit.argmax(1), most))
    return int(np.quantile(rank, recall, method="higher")) + 1


def search(vectors: DataFrame, queries, k: int = 20, tables: int = 8, bucket: int = 128, recall: float = 0.95, fit_queries: int = 64, cell_rows: int = 8192, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row of vectors (id, v) that the condition `queries` picks."""
    norms = vectors.select(F.size("v").alias("d"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("n"))
    n, width, high, low = norms.agg(F.count("*"), F.max("d"), F.max("n"), F.min("n")).first()
    lifted = high is not None and low < high * (1 - 1e-5)
    hashes = Polytopes.of(width or 1, n, bucket, tables, high if lifted else 0.0, seed)
    probes = fitted_probes(hashes, vectors, queries, k, fit_queries, recall)
    wide = max(1, cell_rows // (2 * bucket))  # buckets in a cell
    kind = dict(vectors.dtypes)["v"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _stacked(batch)
            unit = hashes.placed(x, False) if len(ids) else x
            for t in range(tables if len(ids) else 0):
                b = hashes.buckets(unit, t)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(np.full(len(b), t), pa.int32()), pa.array(b // wide), pa.array(b)], ["id", "v", "t", "cell", "b"])

    def asking(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, len(batch), 256):
                    part = batch.slice(i, 256)
                    _, x = _stacked(part)
                    unit = hashes.placed(x, True)
                    for t in range(tables):
                        b = np.sort(hashes.probes(unit, t, most), 1)
                        row, cell = np.repeat(np.arange(len(b)), b.shape[1]), b.ravel() // wide
                        head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])]))
                        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([head, [len(row)]]), pa.int32()), pa.array(b.ravel()))
                        take = pa.array(row[head])
                        yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("v").take(take), pa.array(np.full(len(head), t), pa.int32()), pa.array(cell[head]), lists], ["id", "v", "t", "cell", "bs"])

        return run

    def dealt(df: DataFrame, name: str, rows: int, salt: int) -> tuple[DataFrame, DataFrame]:
        """df with its slice (`name`) within a crowded cell, and the crowded cells with their number of slices."""
        many = written(df.groupBy("t", "cell").agg(F.ceil(F.count("*") / rows).alias("many")).where("many > 1"), f"crowded-{name}")
        if many.isEmpty():
            return df.withColumn(name, F.lit(0).cast("long")), many
        return df.join(many, ["t", "cell"], "left").withColumn(name, F.coalesce(F.pmod(F.xxhash64("id", F.lit(salt)), F.col("many")), F.lit(0))).drop("many"), many

    def copied(df: DataFrame, name: str, many: DataFrame) -> DataFrame:
        """df once for each slice of the other side."""
        if many.isEmpty():
            return df.withColumn(name, F.lit(0).cast("long"))
        return df.join(many, ["t", "cell"], "left").withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("many", F.lit(1)) - 1))).drop("many")

    def meet(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of the slice's vectors (left) in the buckets that each query (right) probes."""
        rows = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(left) and len(right):
            left = left.sort_values("b", kind="stable")
            own, x, b = left["id"].to_numpy(), np.stack(left["v"].to_numpy()).astype(np.float64), left["b"].to_numpy()
            asks, q, beat = right["id"].to_numpy(), np.stack(right["v"].to_numpy()).astype(np.float64), right["beat"].fillna(-np.inf).to_numpy(np.float64)
            size = right["bs"].map(len).to_numpy()
            wants = np.concatenate(right["bs"].to_numpy())
            order = np.argsort(wants, kind="stable")
            asker, wants = np.repeat(np.arange(len(asks)), size)[order], wants[order]
            starts = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]])
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i, j in zip(starts[:-1], starts[1:]):
                who = asker[np.searchsorted(wants, b[i]) : np.searchsorted(wants, b[i], "right")]
                room = max(1, (1 << 21) // (j - i))
                for w in (who[o : o + room] for o in range(0, len(who), room)):
                    scores = q[w] @ x[i:j].T
                    scores[asks[w][:, None] == own[None, i:j]] = -np.inf
                    count = min(k, j - i)
                    edge = np.maximum(-np.partition(-scores, count - 1, 1)[:, count - 1], beat[w])
                    # all that rounding could put among the k are scored again, in one order of summation for equal vectors
                    r, c = np.nonzero((scores >= (edge - 1e-9 * np.maximum(1, np.abs(edge)))[:, None]) & np.isfinite(scores))
                    found.append((w[r], i + c, np.concatenate([np.zeros(0)] + [(q[w[r[o : o + 65536]]] * x[i + c[o : o + 65536]]).sum(1) for o in range(0, len(r), 65536)])))
            if found:
                r, c, scores = (np.concatenate(z) for z in zip(*found))
                best = np.lexsort((own[c], -scores, r))
                r, c, scores = r[best], c[best], scores[best]
                first = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=1))])[r]
                keep = np.arange(len(r)) - first < k
                rows.append(pd.DataFrame({"query_id": asks[r[keep]], "vec_id": own[c[keep]], "score": scores[keep]}))
        return pd.concat(rows)

    def nearest(own: DataFrame, asks: DataFrame) -> DataFrame:
        keys = ["t", "cell", "s", "u"]
        met = own.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return met.distinct().withColumn("rank", rank).where(F.col("rank") <= k)

    index = vectors.mapInArrow(hashed, f"id long, v {kind}, t int, cell long, b long")
    asked, wanted = vectors.where(queries), f"id long, v {kind}, t int, cell long, bs array<long>"
    index, slices = dealt(index, "s", cell_rows, 0)
    first = asked.mapInArrow(asking(1), wanted).withColumn("s", F.lit(0).cast("long")).withColumn("beat", F.lit(None).cast("double"))
    first, turns = dealt(first, "u", cell_rows, 1)
    tried = nearest(copied(index.where("s = 0"), "u", turns), first)
    beat = written(tried.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("beat")), "beat")
    asks, turns = dealt(asked.mapInArrow(asking(probes), wanted), "u", cell_rows, 1)
    best = nearest(copied(index, "u", turns), copied(asks.join(beat, "id", "left"), "s", slices))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_cross_polytope(spark, sf_dir) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return search(vectors, F.col("id") % 20 == 0)

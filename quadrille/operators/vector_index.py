"""Vector search: exact top-k, inverted lists with product quantisation, k-means training, PCA composites."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions.vectors import doubles, l2_normalised, l2_squared


TASKS = 24  # a step on a small table that is much work for each row is dealt to so many tasks; by the size of its input it would run in one or two


def literal(vector) -> F.Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def sound(vector: Column, width: int) -> Column:
    """A vector of this many finite numbers; others have no distance to anything."""
    return F.coalesce((F.size(vector) == width) & F.forall(doubles(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def common_width(df: DataFrame, vector: str) -> int:
    """The commonest number of components, the smaller of two as common; 0 without vectors."""
    found = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found.n if found else 0


def exact_search(df: DataFrame, query, k: int = 5, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """The k rows nearest to the query by squared L2 distance (`score`), ascending, ties to the smaller id.

    Vectors that are null, of another length than the query or not finite take no part.
    """
    return within_radius(df, query, None, vector).orderBy("score", id_column).limit(k)


def within_radius(df: DataFrame, query, radius2: float | None, vector: str = "embedding") -> DataFrame:
    """Rows with their squared distance to the query as `score`; with `radius2`, those where it is at most that."""
    found = df.where(sound(F.col(vector), len(query))).withColumn("score", l2_squared(F.col(vector), literal(query)))
    return found if radius2 is None else found.where(F.col("score") <= radius2)


def sample_per_file(df: DataFrame, file: str, id_column: str, per_file: int = 30_000, total: int | None = 1_500_000, seed: int = 0) -> DataFrame:
    """At most `per_file` rows of each file, picked by id hash, and of these files' samples so many that `total` is reached.

    A file's rows are thinned by hash before the window ranks them, so a huge file doesn't sort in one task.
    """
    sizes = df.groupBy(file).agg(F.count("*").alias("_n"))
    share = F.least(F.lit(1.0), 2.0 * per_file / F.col("_n") + 100 / F.col("_n"))
    mix = F.xxhash64(id_column, F.lit(seed))
    thin = df.join(sizes, file).where(F.pmod(mix, F.lit(1 << 20)) < F.lit(1 << 20) * share)
    picked = thin.withColumn("_k", F.row_number().over(Window.partitionBy(file).orderBy(mix, id_column))).where(F.col("_k") <= per_file)
    if total is not None:
        taken = picked.groupBy(file).agg(F.count("*").alias("_taken"))
        before = F.coalesce(F.sum("_taken").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a file
        picked = picked.join(taken.withColumn("_before", before).where(F.col("_before") < total).select(file), file, "left_semi")
    return picked.drop("_k", "_n")


def _spread(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values, np.float32).reshape(-1, width)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow column of vectors, all known and of one width."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


def nearest_rows(x: np.ndarray, centroids: np.ndarray, count: int = 1, block: int = 1 << 22) -> np.ndarray:
    """The `count` nearest centroids of each row of x, nearest first, ties to the smaller number.

    Products of a block of rows with a block of centroids hold `block` numbers at most, whatever the sizes.
    """
    out = np.zeros((len(x), count), np.int32)
    wide = max(count, min(len(centroids), 4096))
    step = max(1, block // (wide + count))
    halves = [(centroids[first : first + wide].astype(np.float64) ** 2).sum(1) / 2 for first in range(0, len(centroids), wide)]
    for at in range(0, len(x), step):
        rows = x[at : at + step].astype(np.float64)
        best, which = np.full((len(rows), 0), np.inf), np.zeros((len(rows), 0), np.int32)
        for first in range(0, len(centroids), wide):
            part = halves[first // wide] - rows @ centroids[first : first + wide].T.astype(np.float64)
            here = np.broadcast_to(np.arange(first, first + part.shape[1], dtype=np.int32), part.shape)
            if count == 1:
                least = part.argmin(1)[:, None]
                part, here = np.take_along_axis(part, least, 1), np.take_along_axis(here, least, 1)
            best, which = np.concatenate([best, part], 1), np.concatenate([which, here], 1)
            keep = np.argsort(best, axis=1, kind="stable")[:, :count]  # centroids come in order, so ties keep the smaller number
            best, which = np.take_along_axis(best, keep, 1), np.take_along_axis(which, keep, 1)
        out[at : at + step] = which
    return out


def nearest_centroid(df: DataFrame, centroids: np.ndarray, vector: str = "embedding", name: str = "list_id") -> DataFrame:
    """Adds the number of the nearest centroid (a matrix of bounded size, broadcast), by products of blocks; null for
    vectors that are null, of another length or not finite."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    width = centroids.shape[1]

    @F.pandas_udf("int")
    def assign(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), dtype="Int32")
        known = np.flatnonzero(v.notna())
        for at in range(0, len(known), 4096):
            rows = known[at : at + 4096]
            out.iloc[rows] = nearest_rows(np.stack(v.iloc[rows].to_numpy()).reshape(-1, width), shared.value)[:, 0]
        return out

    x = F.col(vector)
    assign = assign.asNondeterministic()  # so that a filter on the list doesn't repeat the whole expression
    return df.withColumn(name, assign(F.when(sound(x, width), doubles(x))))


def kmeans(df: DataFrame, k: int, vector: str, seed: int = 0, rounds: int = 10) -> np.ndarray:
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_f").fit(df.select(array_to_vector(doubles(F.col(vector))).alias("_f")))
    return np.array(model.clusterCenters())


def kmeans_flat(sample: DataFrame, k: int, seed: int = 0, rounds: int = 10, seeds: int = 16, most_bytes: int = 128 << 20) -> np.ndarray:
    """k centroids of the vectors (column v), at most as many as differ: begun by k-means++ over up to `seeds` vectors a
    centroid and `most_bytes` in all, and trained by rounds over the whole sample, every vector with all centroids."""
    hashed = sample.select(F.col("v").cast("array<float>").alias("v"), F.xxhash64("v", F.lit(seed)).alias("mix"))
    width = common_width(hashed, "v")
    few = hashed.dropDuplicates(["mix"]).orderBy("mix").limit(max(k, min(seeds * k, most_bytes // (4 * width))))

    def begin(own: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(own.sort_values("mix")["v"].to_numpy()).astype(np.float32)
        return pd.DataFrame({"c": [r.tobytes() for r in x[plus_plus(x, k, seed)]]})

    rows = few.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(begin, "c binary").toArrow()["c"].to_pylist()  # k vectors
    centroids = np.frombuffer(b"".join(sorted(rows)), np.float32).reshape(-1, width)
    return lloyd(hashed.select("v"), [centroids], lambda x, g: x, None, rounds)[0]


def shares(worth: np.ndarray, counts: np.ndarray, total: int) -> np.ndarray:
    """`total` dealt in proportion to `worth` (largest remainders), one at least where the count isn't 0, and the count at most."""
    total = int(min(total, counts.sum()))
    out = np.minimum(counts, 1)
    while (left := total - int(out.sum())) > 0:
        able = out < counts
        weight = np.where(able, np.maximum(worth, 1e-12), 0.0)
        more = np.minimum(np.floor(left * weight / weight.sum()).astype(np.int64), counts - out)
        if not more.any():
            want = left * weight / weight.sum()
            more[np.argsort(-want, kind="stable")[: min(left, int(able.sum()))]] = 1
        out = out + more
    return out


def _means(parts: DataFrame) -> list[dict]:
    """Of partial sums (g, e, n, total: bytes of doubles) the mean of each (g, e), as bytes of floats."""
    def merged(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        out = [(key[1], e, (np.sum([np.frombuffer(t) for t in rows["total"]], axis=0) / rows["n"].sum()).astype(np.float32).tobytes()) for e, rows in own.groupby("e")]
        return pd.DataFrame(out, columns=["g", "e", "mean"])

    return parts.groupBy(F.floor(F.col("e") / 256), "g").applyInPandas(merged, "g int, e int, mean binary").toArrow().to_pylist()  # the codebook's own size


def lloyd(df: DataFrame, books: list[np.ndarray], cut: Callable[[np.ndarray, int], np.ndarray], groups: str | None = None, rounds: int = 8, block: int = 4096) -> list[np.ndarray]:
    """Rounds of k-means on many codebooks at once over the vectors (column v: array<float>) of df.

    Without `groups` each vector feeds every codebook by its part cut(rows, g) (product quantisation); with it, only
    the codebook that the column names (the second level of a hierarchy), and df should be sorted by it. A task keeps sums
    of the codebooks it meets and sends one row for each entry; entries without vectors stay.
    """
    spark = df.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, kept = shared.value, {}

            def add(g: int, x: np.ndarray) -> None:
                if g not in kept:
                    kept[g] = np.zeros(len(own[g]), np.int64), np.zeros(own[g].shape)
                which = nearest_rows(x, own[g])[:, 0]
                order = np.argsort(which, kind="stable")
                heads = np.flatnonzero(np.diff(which[order], prepend=-1))
                kept[g][0][which[order][heads]] += np.diff(np.append(heads, len(order)))
                kept[g][1][which[order][heads]] += np.add.reduceat(x[order].astype(np.float64), heads, axis=0)

            def told() -> Iterator[pa.RecordBatch]:
                for g, (n, total) in kept.items():
                    used = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), g, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array([total[e].tobytes() for e in used], pa.binary())], ["g", "e", "n", "total"])
                kept.clear()

            for batch in batches:
                for at in range(0, batch.num_rows, block):
                    part = batch.slice(at, block)
                    column = part.column("v")
                    x = _spread(column.flatten().to_numpy(zero_copy_only=False), len(column.flatten()) // len(column))
                    if groups is None:
                        for g in range(len(own)):
                            add(g, cut(x, g))
                    else:
                        of = part.column(groups).to_numpy(zero_copy_only=False)
                        for g in np.unique(of).tolist():
                            add(g, x[of == g])
                        if len(kept) > 16:  # rows come by group, so what is there is mostly done
                            yield from told()
            yield from told()

        found = _means(df.select("v", *([groups] if groups else [])).mapInArrow(sums, "g int, e int, n long, total binary"))
        books = [b.copy() for b in books]
        for r in found:
            books[r["g"]][r["e"]] = np.frombuffer(r["mean"], np.float32)
        shared.unpersist()
    return books


def kmeans_two_level(sample: DataFrame, k: int, seed: int = 0, rounds: int = 8, polish: int = 2, seeds: int = 16, most_bytes: int = 128 << 20) -> np.ndarray:
    """k centroids of the unit vectors (column v) of a bounded sample, for numbers of lists that flat k-means can't train.

    About sqrt(k) tops are trained flat. Each gets centroids by its share of the error (not of the vectors: a crowd in one
    place needs few), begun by k-means++ over up to `seeds` vectors a centroid and `most_bytes` in all, and trained by
    rounds over the sample where a vector meets only the centroids of its own top; then by `polish` rounds where it
    meets all of them.
    """
    tops = kmeans_flat(sample, max(2, round(k**0.5)), seed)
    shared, width = sample.sparkSession.sparkContext.broadcast(tops), tops.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _spread(_matrix(batch.column("v"), width), width)
            top = nearest_rows(x, shared.value)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(top), batch.column("v"), batch.column("mix"), pa.array(((x - shared.value[top]) ** 2).sum(1).astype(np.float64))], ["top", "v", "mix", "away"])

    hashed = sample.select(F.col("v").cast("array<float>").alias("v"), F.xxhash64("v", F.lit(seed)).alias("mix"))
    placed = hashed.mapInArrow(place, "top int, v array<float>, mix long, away double")
    placed = placed.repartitionByRange(TASKS, "top", "mix").sortWithinPartitions("top", "mix").persist(StorageLevel.DISK_ONLY)  # the sample is bounded; a lost part is made again
    try:
        counts, errors = np.zeros(len(tops), np.int64), np.zeros(len(tops))
        for r in placed.groupBy("top").agg(F.countDistinct("mix").alias("n"), F.sum("away").alias("away")).collect():  # one row a top
            counts[r.top], errors[r.top] = r.n, r.away
        wanted = shares(errors ** (width / (width + 2)), counts, k)
        limits = sample.sparkSession.createDataFrame([(t, int(n)) for t, n in enumerate(wanted)], "top int, most long")
        rank = F.row_number().over(Window.partitionBy("top").orderBy("mix"))
        room = F.greatest(F.col("most"), F.least(seeds * F.col("most"), F.lit(most_bytes // (4 * width))))
        few = placed.dropDuplicates(["top", "mix"]).join(F.broadcast(limits), "top").withColumn("rank", rank).where(F.col("rank") <= room)  # one row a top is broadcast

        def begin(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(own.sort_values("rank")["v"].to_numpy()).astype(np.float32)
            chosen = plus_plus(x, int(own["most"].iloc[0]), seed + key[0])
            return pd.DataFrame({"top": key[0], "c": [r.tobytes() for r in x[chosen]]})

        rows = sorted(few.groupBy("top").applyInPandas(begin, "top int, c binary").toArrow().to_pylist(), key=lambda r: (r["top"], r["c"]))  # k vectors
        own = np.array([r["top"] for r in rows])
        flat = np.frombuffer(b"".join(r["c"] for r in rows), np.float32).reshape(-1, width)
        cuts = np.searchsorted(own, np.arange(len(tops) + 1))
        flat = np.concatenate(lloyd(placed, [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:])], lambda x, g: x, "top", rounds))
        for _ in range(polish):
            flat = lloyd(placed, [flat], lambda x, g: x, None, 1)[0]
        return flat
    finally:
        placed.unpersist()


def plus_plus(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Rows of x that k-means++ begins with: each next one by its squared distance to those before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    away = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        total = np.cumsum(away, dtype=np.float64)
        if total[-1] <= 0:  # all that is left equals a chosen row
            chosen += np.setdiff1d(np.arange(len(x)), chosen)[: k - len(chosen)].tolist()
            break
        chosen.append(min(int(np.searchsorted(total, rng.random() * total[-1], "right")), len(x) - 1))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


@dataclass
class VectorIndex:
    """Inverted lists with product-quantised codes of what is left of a vector after its list's centroid (residuals).

    `lists` coarse cells, `parts` sub-vectors of which each is one of up to 256 codewords. Codes are a table
    (id, list_id, code: a byte a part), written by list so that a search reads the probed lists only. Vectors that are
    null, of another length or not finite are neither learned from nor encoded. Distances are squared, of unit vectors.

    `train` reads the given sample only (bound it by `sample_per_file`). Below `few` lists centroids come from Spark's KMeans,
    whose start takes long with many lists, then from rounds over all of them, and from `flat` lists on from two levels. Workers multiply blocks of rows with blocks of centroids, so no array but the centroids themselves (floats,
    151 MB for 32,768 lists of 1,152 components) grows with the index's size.
    """

    centroids: np.ndarray
    codebooks: np.ndarray  # parts x words x width

    @classmethod
    def train(cls, sample: DataFrame, lists: int, parts: int, words: int = 256, vector: str = "embedding", seed: int = 0, flat: int = 1024, few: int = 64) -> VectorIndex:
        size = common_width(sample, vector)
        if not size or size % parts:
            raise ValueError(f"vectors of {size} components have no {parts} equal parts")
        if words > 256:
            raise ValueError("a codeword's number is a byte")
        unit = sample.where(sound(F.col(vector), size)).select(l2_normalised(F.col(vector)).alias("v"))
        unit = (unit.repartition(TASKS) if lists >= few else unit).persist(StorageLevel.DISK_ONLY)
        try:
            centroids = (kmeans(unit, lists, "v", seed) if lists < few else kmeans_flat(unit, lists, seed) if lists < flat else kmeans_two_level(unit, lists, seed)).astype(np.float32)
            left = _residuals(unit, centroids).persist(StorageLevel.DISK_ONLY)
            try:
                return cls(centroids, _codebooks(left, parts, words, size // parts, seed))
            finally:
                left.unpersist()
        finally:
            unit.unpersist()

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def encode(self, df: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """id, list_id, code of every sound vector; further columns of df go along."""
        shared = df.sparkSession.sparkContext.broadcast((self.centroids, self.codebooks))
        width = self.width
        rest = [c for c in df.columns if c not in (id_column, vector)]
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in [id_column, *rest]) + ", list_id int, code binary"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, books = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    x = _spread(_matrix(part.column("_unit"), width), width)
                    lists = nearest_rows(x, centroids)[:, 0]
                    code = coded(x - centroids[lists], books)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in [id_column, *rest]), pa.array(lists), pa.array([r.tobytes() for r in code], pa.binary())], [id_column, *rest, "list_id", "code"])

        unit = df.where(sound(F.col(vector), width)).select(id_column, *rest, l2_normalised(F.col(vector)).cast("array<float>").alias("_unit"))
        return unit.mapInArrow(run, schema)

    def write(self, codes: DataFrame, path: str) -> None:
        """Centroids, codebooks and the codes, by list; a list of very many codes is written by several tasks."""
        self.write_model(codes.sparkSession, path)
        codes.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/codes")

    def write_model(self, spark: SparkSession, path: str) -> None:
        tables = {"centroids": self.centroids, "codebooks": self.codebooks.reshape(-1, self.codebooks.shape[2])}
        for name, matrix in tables.items():
            rows = pa.table({"number": pa.array(range(len(matrix)), pa.int32()), "vector": pa.array([r.astype(np.float32).tobytes() for r in matrix], pa.binary())})  # of the index's fixed size
            spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([self.codebooks.shape], "parts int, words int, width int").write.mode("overwrite").parquet(f"{path}/shape")

    @classmethod
    def load_model(cls, spark: SparkSession, path: str) -> VectorIndex:
        shape = spark.read.parquet(f"{path}/shape").first()
        found = []
        for name in ("centroids", "codebooks"):
            rows = sorted(spark.read.parquet(f"{path}/{name}").toArrow().to_pylist(), key=lambda r: r["number"])
            found.append(np.frombuffer(b"".join(r["vector"] for r in rows), np.float32))
        width = shape.parts * shape.width
        return cls(found[0].reshape(-1, width), found[1].reshape(shape.parts, shape.words, shape.width))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> tuple[VectorIndex, DataFrame]:
        """The index and its codes as `write` left them."""
        return cls.load_model(spark, path), spark.read.parquet(f"{path}/codes")

    def search(self, codes: DataFrame, query, k: int = 5, probes: int = 32, id_column: str = "vec_id", rerank: tuple[DataFrame, int] | None = None, vector: str = "embedding") -> DataFrame:
        """The k nearest by the codes' distance among the lists nearest to the query; `rerank` as in `search_many`."""
        q = np.asarray(query, np.float64)
        unit = (q / (np.linalg.norm(q) or 1.0)).astype(np.float32)
        near = nearest_rows(unit[None], self.centroids, min(probes, len(self.centroids)))[0]  # on the driver, so that the scan is pruned
        asks = codes.sparkSession.createDataFrame([(0, [float(x) for x in q])], "query_id long, q array<double>")
        found = self.search_many(codes.where(F.col("list_id").isin(near.tolist())), asks, k, probes, id_column, rerank, vector, query="q")
        return found.drop("query_id", "rank").orderBy("score", id_column)

    def dealt(self, codes: DataFrame, code_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each list the first shard and the number of shards, and the number of all. A shard holds whole lists of together
        about `code_rows` codes, or a slice of a list of more; lists without codes have none."""
        counts = np.zeros(len(self.centroids), np.int64)
        found = codes.groupBy("list_id").count().toArrow()  # one row a list
        counts[found["list_id"].to_numpy()] = found["count"].to_numpy()
        slices = -(-counts // code_rows)
        small, large = slices == 1, slices > 1
        first = np.where(small, (np.cumsum(np.where(small, counts, 0)) - 1) // code_rows, 0)
        total = int(first.max()) + 1 if small.any() else 0
        first[large] = total + np.cumsum(slices[large]) - slices[large]
        return first, slices, total + int(slices[large].sum())

    def probed(self, queries: DataFrame, probes: int, first: np.ndarray, slices: np.ndarray, query_id: str = "query_id", query: str = "embedding") -> DataFrame:
        """query_id, s, lists (numbers, 4 bytes each), unit: of the `probes` lists nearest to each query those of each shard."""
        shared = queries.sparkSession.sparkContext.broadcast((self.centroids, first, slices))
        width, count = self.width, min(probes, len(self.centroids))
        kind = queries.select(query_id).schema[0].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, first, slices = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    x, rows, shards, lists = _spread(_matrix(part.column("_unit"), width), width), [], [], []
                    for i, near in enumerate(nearest_rows(x, centroids, count)):
                        n = slices[near]
                        each, shard = np.repeat(near, n), np.repeat(first[near] + n - np.cumsum(n), n) + np.arange(n.sum())
                        order = np.argsort(shard, kind="stable")
                        heads = np.flatnonzero(np.diff(shard[order], prepend=-1))
                        rows += [i] * len(heads)
                        shards.append(shard[order][heads])
                        lists += [own.tobytes() for own in np.split(each[order].astype(np.int32), heads[1:])] if len(heads) else []
                    units = [r.tobytes() for r in x]
                    columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(np.concatenate(shards).astype(np.int32)), pa.array(lists, pa.binary()), pa.array([units[i] for i in rows], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "s", "lists", "unit"])

        unit = queries.where(sound(F.col(query), width)).select(query_id, l2_normalised(F.col(query)).cast("array<float>").alias("_unit"))
        return unit.mapInArrow(run, f"query_id {kind}, s int, lists binary, unit binary")

    def search_many(self, codes: DataFrame, queries: DataFrame, k: int = 5, probes: int = 32, id_column: str = "vec_id", rerank: tuple[DataFrame, int] | None = None, vector: str = "embedding",
                    query_id: str = "query_id", query: str = "embedding", code_rows: int = 1 << 16, query_rows: int = 1024) -> DataFrame:
        """query_id, id, list_id, score, rank: the k nearest of every row of `queries`.

        Lists are dealt into shards of about `code_rows` codes, the queries that probe a shard into blocks of `query_rows` at
        most; shards and blocks meet pair by pair, and a query takes from a shard the best k of the lists it probes there, so
        what is ranked in the end grows with the shards, not with the lists. Scores are products of residuals with decoded
        codes, rounded to 12 digits so that equal codes tie. Counts of codes by list and of queries by shard come first.

        `rerank`: the table of vectors and a factor; the best k x factor by their codes are then ranked by the exact distance
        of their unit vectors. Queries without a sound vector get no rows.
        """
        keep = k * rerank[1] if rerank else k
        spark = codes.sparkSession
        shared = spark.sparkContext.broadcast((self.centroids, self.codebooks))
        first, slices, total = self.dealt(codes, code_rows)
        asks = self.probed(queries, probes, first, slices, query_id, query)
        ask_kind, id_kind = asks.schema["query_id"].dataType.simpleString(), codes.schema[id_column].dataType.simpleString()
        blocks = [(r.s, max(-(-r.n // query_rows), min(-(-TASKS // total), -(-r.n // 16)))) for r in asks.groupBy("s").agg(F.count("*").alias("n")).collect()]  # one row a shard
        tasks = min(2000, max(1, sum(n for _, n in blocks)))
        by_shard = F.broadcast(spark.createDataFrame(blocks, "s int, n_u int"))
        by_list = F.broadcast(spark.createDataFrame([(i, int(f), int(n)) for i, (f, n) in enumerate(zip(first, slices)) if n], "list_id int, first int, slices int"))
        at = codes.select(F.col(id_column).alias("_id"), "list_id", "code").join(by_list, "list_id")
        left = at.withColumn("s", (F.col("first") + F.pmod(F.xxhash64("_id"), F.col("slices"))).cast("int")).drop("first", "slices").join(by_shard, "s")
        left = left.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("n_u") - 1))).drop("n_u")
        right = asks.join(by_shard, "s").withColumn("u", F.pmod(F.xxhash64("query_id"), F.col("n_u")).cast("int")).drop("n_u")

        def meet(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(asked):
                return pd.DataFrame({"query_id": asked["query_id"][:0], "_id": own["_id"][:0], "list_id": np.zeros(0, np.int32), "score": np.zeros(0)})
            own = own.sort_values("_id", kind="stable").reset_index(drop=True).sort_values("list_id", kind="stable")
            rank, of, ids = own.index.to_numpy(), own["list_id"].to_numpy(), own["_id"].to_numpy()  # rank: place by id
            codes, out = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), -1), []
            for start in range(0, len(asked), 128):
                few = asked[start : start + 128]
                units = np.frombuffer(b"".join(few["unit"]), np.float32).reshape(len(few), -1)
                for q, (score, place) in enumerate(_scored(codes, of, units, [np.frombuffer(b, np.int32) for b in few["lists"]], *shared.value)):
                    best, score = _least(score, rank[place], keep)
                    out.append((start + q, place[best], score))
            place = np.concatenate([p for _, p, _ in out])
            asker = np.repeat([q for q, _, _ in out], [len(p) for _, p, _ in out])
            return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[asker], "_id": ids[place], "list_id": of[place], "score": np.concatenate([s for _, _, s in out])})

        keys = ["s", "u"]
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, f"query_id {ask_kind}, _id {id_kind}, list_id int, score double")
        order = Window.partitionBy("query_id").orderBy("score", "_id")
        first = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)  # a query has shards x keep rows at most
        if rerank:
            units = rerank[0].where(sound(F.col(vector), self.width)).select(F.col(id_column).alias("_id"), l2_normalised(F.col(vector)).alias("_unit"))
            own = queries.where(sound(F.col(query), self.width)).select(F.col(query_id).alias("query_id"), l2_normalised(F.col(query)).alias("_ask"))
            exact = units.join(first.drop("score", "rank"), "_id").join(own, "query_id").withColumn("score", l2_squared(F.col("_unit"), F.col("_ask")))
            first = exact.drop("_unit", "_ask").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return first.select("query_id", F.col("_id").alias(id_column), "list_id", "score", "rank")

    def fitted(self, codes: DataFrame, df: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", asked: int = 128, probed: float = 0.97, found: float = 0.95, most: int = 2000) -> tuple[int, int]:
        """The number of lists to probe and the factor to rerank by, from the true k nearest rows of up to `asked` queries
        (query_id, and the vector): so many lists that a share of `probed` of these rows lies in them, and so deep that a share
        of `found` is among the best by code (`most` a query at most, and all that were found if that is a smaller share)."""
        few = queries.where(sound(F.col(vector), self.width)).orderBy(F.xxhash64("query_id"), "query_id").limit(asked).toArrow()  # bounded
        if not few.num_rows:
            return 1, 1
        few = codes.sparkSession.createDataFrame(few)
        true = exact_many(df, few, k, id_column, vector).join(few, "query_id").join(codes.select(F.col(id_column).alias("_id"), "list_id"), "_id")
        true = true.select("query_id", "_id", "list_id", l2_normalised(F.col(vector)).cast("array<float>").alias("v")).toArrow()  # asked x k rows
        if not true.num_rows:
            return 1, 1
        lists, kept = true["list_id"].to_numpy(), codes.sparkSession.createDataFrame(true.select(["query_id", "_id"]))
        order = nearest_rows(np.array(true["v"].to_pylist(), np.float32), self.centroids, len(self.centroids))
        places = np.sort((order == lists[:, None]).argmax(1)) + 1
        probes = int(places[int(np.ceil(probed * len(places))) - 1])
        near = self.search_many(codes, few, most, probes, id_column, query=vector).withColumnRenamed(id_column, "_id")
        ranks = sorted(r["rank"] for r in near.join(F.broadcast(kept), ["query_id", "_id"]).select("rank").collect()) or [most]
        return probes, -(-ranks[min(int(np.ceil(found * len(places))), len(ranks)) - 1] // k)


def exact_many(df: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, _id: the k rows of df nearest to each of a few queries (their vectors are broadcast), by unit vectors."""
    width = common_width(queries, vector)
    asks = queries.where(sound(F.col(vector), width)).select("query_id", l2_normalised(F.col(vector)).alias("v")).toArrow()
    shared = df.sparkSession.sparkContext.broadcast((asks["query_id"].combine_chunks(), np.array(asks["v"].to_pylist())))
    rows = df.where(sound(F.col(vector), width)).select(F.col(id_column).alias("_id"), l2_normalised(F.col(vector)).alias("v"))
    kinds = queries.schema["query_id"].dataType.simpleString(), rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                y = _matrix(part.column("v"), width)
                away = np.round((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 12)
                rank = np.argsort(np.argsort(part.column("_id").to_pandas(), kind="stable"), kind="stable")
                best = [_least(row, rank, k) for row in away]
                asker, place = np.repeat(np.arange(len(x)), [len(b) for b, _ in best]), np.concatenate([b for b, _ in best])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(asker)), part.column("_id").take(pa.array(place)), pa.array(np.concatenate([s for _, s in best]))], ["query_id", "_id", "score"])

    near = rows.mapInArrow(run, f"query_id {kinds[0]}, _id {kinds[1]}, score double")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "_id"))).where(F.col("rank") <= k).select("query_id", "_id")


def _scored(codes: np.ndarray, of: np.ndarray, units: np.ndarray, wanted: list[np.ndarray], centroids: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each query the distances to the codes of the lists it wants, and their places; codes come by their list (`of`)."""
    asker, lists = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted]), np.concatenate(wanted)
    order = np.argsort(lists, kind="stable")
    asker, lists = asker[order], lists[order]
    heads = np.flatnonzero(np.diff(lists, prepend=-1))
    scores, places = [[] for _ in wanted], [[] for _ in wanted]
    for head, end in zip(heads, np.append(heads[1:], len(lists))):
        n, who = lists[head], asker[head:end]
        a, b = np.searchsorted(of, [n, n + 1])
        if a == b:
            continue
        decoded = books[np.arange(len(books)), codes[a:b]].reshape(b - a, -1).astype(np.float64)
        left = (units[who] - centroids[n]).astype(np.float64)
        away = (left * left).sum(1)[:, None] + (decoded * decoded).sum(1) - 2 * (left @ decoded.T)
        place = np.arange(a, b)
        for i, row in zip(who.tolist(), away):
            scores[i].append(row)
            places[i].append(place)
    for score, place in zip(scores, places):
        yield (np.concatenate(score), np.concatenate(place)) if score else (np.zeros(0), np.zeros(0, np.int64))


def _least(score: np.ndarray, rank: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values (of 12 digits) of the `keep` least scores in order, ties to the smaller rank."""
    near = np.flatnonzero(score <= np.partition(score, keep - 1)[keep - 1] + 2e-12) if len(score) > keep else np.arange(len(score))
    value = np.round(np.maximum(score[near], 0), 12)
    order = np.lexsort((rank[near], value))[:keep]
    return near[order], value[order]


def coded(left: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The number of the nearest codeword of each part of each residual, as bytes."""
    parts, _, width = books.shape
    return np.stack([nearest_rows(left[:, p * width : (p + 1) * width], books[p])[:, 0] for p in range(parts)], 1).astype(np.uint8) if parts else np.zeros((len(left), 0), np.uint8)


def distances(left: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distance of each part of a residual to each codeword: parts x words."""
    away = books.astype(np.float64) - left.astype(np.float64).reshape(books.shape[0], 1, books.shape[2])
    return (away * away).sum(2)


def _residuals(unit: DataFrame, centroids: np.ndarray) -> DataFrame:
    """v: the unit vectors less their nearest centroids."""
    shared = unit.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = shared.value.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = _spread(_matrix(batch.column("v").slice(at, 4096), width), width)
                x = x - shared.value[nearest_rows(x, shared.value)[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width), pa.int32()), pa.array(x.ravel()))], ["v"])

    return unit.select(F.col("v").cast("array<float>").alias("v")).mapInArrow(run, "v array<float>")


def _codebooks(left: DataFrame, parts: int, words: int, width: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Codewords of all parts, trained in the same rounds, from residuals of least hash; fewer residuals than words leave
    the rest of a book infinitely far."""
    first = left.orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(words).toArrow().to_pylist()
    if not first:
        return np.full((parts, words, width), 1e9, np.float32)
    x = np.array([r["v"] for r in first], np.float32).reshape(len(first), parts, width)
    books = lloyd(left, [np.ascontiguousarray(x[:, p]) for p in range(parts)], lambda rows, g: rows[:, g * width : (g + 1) * width], None, rounds)
    out = np.full((parts, words, width), 1e9, np.float32)  # far from any residual of unit vectors
    for p, b in enumerate(books):
        out[p, : len(b)] = b
    return out


@dataclass
class TextSearch:
    """Search by text: an encoder (text to a vector of the index's space), an index with its codes, and metadata by id."""

    encoder: Callable[[str], np.ndarray]
    index: VectorIndex
    codes: DataFrame
    meta: DataFrame

    def search(self, text: str, k: int = 1, probes: int = 32, id_column: str = "vec_id") -> DataFrame:
        return search_with_metadata(self.index.search(self.codes, self.encoder(text), k, probes, id_column), self.meta, id_column)


def search_with_metadata(found: DataFrame, meta: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """Search results (k rows) with their metadata rows, by id."""
    return meta.join(F.broadcast(found), id_column).orderBy("score", id_column)


def pca_composite(df: DataFrame, vector: str, components: int = 3) -> DataFrame:
    """Adds `pc`: principal components of the centred vectors, as an array; rows without a sound vector are left out."""
    width = common_width(df, vector)
    known = df.where(sound(F.col(vector), width)).withColumn("_f", array_to_vector(doubles(F.col(vector))))
    model = PCA(k=components, inputCol="_f", outputCol="_pc").fit(known)
    means = known.select(Summarizer.mean(F.col("_f"))).first()[0].toArray()  # `width` numbers
    shift = model.pc.toArray().T @ means
    return model.transform(known).withColumn("pc", F.zip_with(vector_to_array("_pc"), literal(shift), lambda x, s: x - s)).drop("_f", "_pc")


def rgb_of_components(df: DataFrame, pc: str = "pc") -> DataFrame:
    """Stretches each of three components to 0..255 over the whole table: r, g, b."""
    spans = df.agg(*[f(F.col(pc)[i]).alias(f"{n}{i}") for i in range(3) for n, f in (("low", F.min), ("high", F.max))]).first()
    byte = lambda i: F.lit(0) if spans[f"high{i}"] == spans[f"low{i}"] else F.floor(255 * (F.col(pc)[i] - spans[f"low{i}"]) / (spans[f"high{i}"] - spans[f"low{i}"])).cast("int")
    return df.select("*", *[byte(i).alias(n) for i, n in enumerate("rgb")])

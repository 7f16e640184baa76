"""Vector code compression: parts of vectors as the numbers of their nearest codebook entries, found through kd-trees.

Each component x becomes the integer floor(scale * x). A vector is cut into equal consecutive parts (where the number of
components doesn't divide, part p of n begins at floor(p * width / n)); each part position has a codebook. A round broadcasts a
kd-tree of every codebook (of a fixed size: entries x components), assigns every part to its nearest entry and moves
each entry to the floored mean of its parts. Tasks add up integers by entry and component, Spark adds those of all
tasks, and only these sums, as many as the codebooks have components, come to the driver.

The search goes down to the nearer box first and enters the other one if its bound is no greater than the best
distance so far; a box of equal bound is entered too, since an entry of a lower index may tie there. Whole batches
descend at once. All arithmetic is on integers, so results don't depend on the order of rows or tasks.

Edge cases: vectors that are null, empty, hold null or non-finite components, or have another number of components
than most are left out. Components beyond 2**26 in size after scaling count as 2**26, so that sums stay exact. The first
entries come from the smallest ids, each id once (of several vectors with one id the least); a null id gives no entry,
its row is coded like others. Fewer vectors than entries give smaller codebooks; an entry without parts stays as it
is. Repeated rows each come out and each count; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.vectors import doubles
from quadrille.operators.vector_index import common_width, sound

from .common import Batches, lean, written

LARGEST = 1 << 26


@dataclass
class Tree:
    """A kd-tree over the rows of `entries`: bounding boxes, children (-1 at a leaf), and the entries of each leaf, ascending."""

    entries: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    children: list[tuple[int, int]]
    members: list[np.ndarray]

    @classmethod
    def of(cls, entries: np.ndarray, leaf: int = 4) -> Tree:
        tree = cls(entries, [], [], [], [])
        tree._grow(np.arange(len(entries)), leaf)
        return tree

    def _grow(self, members: np.ndarray, leaf: int) -> int:
        own, here = len(self.low), self.entries[members]
        self.low.append(here.min(0)), self.high.append(here.max(0)), self.members.append(members), self.children.append((-1, -1))
        if len(members) > leaf and here.shape[1]:
            widest = int((here.max(0) - here.min(0)).argmax())
            order = np.argsort(here[:, widest], kind="stable")
            halves = np.sort(members[order[: len(order) // 2]]), np.sort(members[order[len(order) // 2 :]])
            self.children[own] = tuple(self._grow(half, leaf) for half in halves)
        return own

    def _bound(self, node: int, x: np.ndarray) -> np.ndarray:
        """Least squared distance that an entry below the node can have."""
        out = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
        return (out * out).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of x, the least index among equals, and its squared distance."""
        best, which = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.entries))

        def visit(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            one, other = self.children[node]
            if one < 0:
                away = x[rows, None, :] - self.entries[self.members[node]][None]
                away = (away * away).sum(2)
                first = away.argmin(1)  # members ascend, so the least index of a leaf's equals
                found, least = self.members[node][first], away[np.arange(len(rows)), first]
                better = (least < best[rows]) | ((least == best[rows]) & (found < which[rows]))
                best[rows[better]], which[rows[better]] = least[better], found[better]
                return
            bounds = self._bound(one, x[rows]), self._bound(other, x[rows])
            left = bounds[0] <= bounds[1]
            visit(one, rows[left]), visit(other, rows[~left])
            right_too = left & (bounds[1] <= best[rows])
            left_too = ~left & (bounds[0] <= best[rows])
            visit(other, rows[right_too]), visit(one, rows[left_too])

        visit(0, np.arange(len(x)))
        return which, best


def _whole(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """The integers of a column of vectors, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(scale * flat), -LARGEST, LARGEST).astype(np.int64).reshape(len(column), width)


@dataclass
class Codebooks:
    """Entries of each part position (entries x components), for vectors of `width` components scaled by `scale`."""

    books: list[np.ndarray]
    width: int
    scale: float

    @property
    def cuts(self) -> list[int]:
        return part_cuts(self.width, len(self.books))

    def trees(self) -> list[Tree]:
        return [Tree.of(b) for b in self.books]

    def sha256(self) -> str:
        """Digest of all components as decimal text, by part, entry and position, with commas between."""
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()


def part_cuts(width: int, parts: int) -> list[int]:
    return [p * width // parts for p in range(parts + 1)]


def usable(df: DataFrame, vector: str, width: int) -> DataFrame:
    """The rows whose vector has `width` finite components, with the vector as doubles."""
    return df.where(sound(F.col(vector), width)).withColumn(vector, doubles(F.col(vector)))


def _first(known: DataFrame, id_column: str, vector: str, count: int) -> list:
    """The vectors of the `count` smallest ids, ascending, each id once."""
    rows = known.where(F.col(id_column).isNotNull()).select(id_column, vector)
    found = rows.orderBy(id_column, vector).limit(count).collect()
    if len({r[0] for r in found}) < len(found):  # some id repeats: ids first, then their least vectors
        ids = rows.select(id_column).distinct().orderBy(id_column).limit(count)
        found = sorted(rows.join(F.broadcast(ids), id_column).groupBy(id_column).agg(F.min(vector)).collect())  # `count` rows
    return [r[1] for r in found]


def _blocks(batch: pa.RecordBatch, vector: str, width: int, scale: float, values: int = 1 << 19) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, values // max(width, 1))
    for at in range(0, batch.num_rows, step):
        yield at, _whole(batch.column(vector).slice(at, step), width, scale)


def fitted(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> Codebooks | None:
    """Codebooks after `rounds` rounds over all usable rows of df; None if there is no vector to begin with."""
    width = common_width(df.where(F.size(vector) > 0), vector)
    known = usable(df.select(id_column, vector), vector, width) if width else None
    first = _first(known, id_column, vector, entries) if width else []
    if not first:
        return None
    whole = np.clip(np.floor(scale * np.array(first, np.float64)), -LARGEST, LARGEST).astype(np.int64)
    cuts = part_cuts(width, parts)
    books = Codebooks([whole[:, a:b] for a, b in zip(cuts[:-1], cuts[1:])], width, scale)
    for _ in range(rounds):
        books = _moved(known.select(vector), vector, books)
    return books


def _moved(known: DataFrame, vector: str, books: Codebooks) -> Codebooks:
    """The codebooks after one round."""
    shared = known.sparkSession.sparkContext.broadcast(books.trees())
    width, scale, cuts = books.width, books.scale, books.cuts

    def sums(batches: Batches) -> Batches:
        trees = shared.value
        totals, counts = [np.zeros_like(t.entries) for t in trees], [np.zeros(len(t.entries), np.int64) for t in trees]
        for batch in batches:
            for _, x in _blocks(batch, vector, width, scale):
                for p, tree in enumerate(trees):
                    own = x[:, cuts[p] : cuts[p + 1]]
                    which, _ = tree.nearest(own)
                    counts[p] += np.bincount(which, minlength=len(tree.entries))
                    for d in range(own.shape[1]):  # a block's sums are below 2**53, so doubles hold them exactly
                        totals[p][:, d] += np.bincount(which, weights=own[:, d], minlength=len(tree.entries)).astype(np.int64)
        for p, (total, count) in enumerate(zip(totals, counts)):
            entry, place = (z.ravel() for z in np.indices(total.shape))
            used = count[entry] > 0
            fixed = [pa.array(np.full(int(used.sum()), p, np.int32)), pa.array(entry[used].astype(np.int32)), pa.array(place[used].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(total.ravel()[used]), pa.array(count[entry][used])], ["part", "entry", "place", "total", "n"])

    found = known.mapInArrow(lean(sums), "part int, entry int, place int, total long, n long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    new = [b.copy() for b in books.books]
    for r in found.collect():  # entries x components of all codebooks at most
        new[r.part][r.entry, r.place] = r.total // r.n
    shared.unpersist()
    return Codebooks(new, width, scale)


def coded(df: DataFrame, books: Codebooks | None, columns: list[str], vector: str = "embedding") -> DataFrame:
    """`columns` of the usable rows of df, with code (two hex digits a part) and error (squared distance, all parts)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", code string, error long"
    if books is None:
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast(books.trees())
    width, scale, cuts = books.width, books.scale, books.cuts

    def run(batches: Batches) -> Batches:
        trees = shared.value
        for batch in batches:
            for at, x in _blocks(batch, vector, width, scale):
                which, error = np.zeros((len(x), len(trees)), np.uint8), np.zeros(len(x), np.int64)
                for p, tree in enumerate(trees):
                    which[:, p], away = tree.nearest(x[:, cuts[p] : cuts[p + 1]])
                    error += away
                text = which.tobytes().hex()
                code = [text[i : i + 2 * len(trees)] for i in range(0, len(text), 2 * len(trees))]
                part = batch.slice(at, len(x))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(code, pa.string()), pa.array(error)], [*columns, "code", "error"])

    return usable(df.select(*columns, vector), vector, width).mapInArrow(lean(run), schema)


def op11_kd_codes(spark, sf_dir) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    books = fitted(vectors)
    found = written(coded(vectors, books, ["vec_id", "label"]), "codes")
    sums = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    met = found.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


def op11_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The same by all distances."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT n, p, min(away * {entries} + e) AS least FROM (SELECT n, x.p, e, sum((x.v - c.v) * (x.v - c.v)) AS away FROM x JOIN c{k} c ON x.p = c.p AND x.d = c.d GROUP BY n, x.p, e) GROUP BY n, p)")
        if k < rounds:
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.d, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT x.p, x.d, least % {entries} AS e, CAST(floor(sum(x.v) / count(*)) AS BIGINT) AS v FROM x JOIN a{k} USING (n, p) GROUP BY ALL) m ON c.p = m.p AND c.d = m.d AND c.e = m.e)")
    last = rounds
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT n, i // (len(embedding) // {parts}) AS p, i % (len(embedding) // {parts}) AS d, CAST(floor(256 * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS v FROM kept, unnest(range(len(embedding))) t(i)),
c0 AS MATERIALIZED (SELECT p, d, n - 1 AS e, v FROM x WHERE n <= {entries}),
{", ".join(steps)},
codes AS MATERIALIZED (SELECT n, string_agg(lpad(lower(to_hex(CAST(least % {entries} AS BIGINT))), 2, '0'), '' ORDER BY p) AS code, CAST(sum(least // {entries}) AS BIGINT) AS error FROM a{last} GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, d)) FROM c{last}) AS codebooks_sha256 FROM codes JOIN kept USING (n)"""

"""Document fingerprints: threshold-scaled sketches of five-word shingles, made of Spark functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches of parts can be merged by
union, and the share of one sketch found in another estimates how much of a document the other contains, however
unequal their lengths.

Edge cases: a null text counts as empty; texts of fewer than five words have one shingle, the whole word sequence;
a text without words has none. The likeness to an equal text is 1, and otherwise 0 if the sketch is empty. A null
doc_id sorts after all others; rows with one doc_id are ordered by their text, greatest first. A single document
follows itself. Nothing of the input but doc_id and text is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

CELLS = 4096


def sketch(text: Column, words: int = 5, scale: int = 8) -> Column:
    """Sorted distinct shingle hashes that fall in the lowest 1/scale of the range."""
    below = -(2**63) + 2**64 // scale
    hashed = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    shingles = let(hashed, lambda h: F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, words)))).otherwise(F.array().cast("array<bigint>")))
    return F.array_sort(F.array_distinct(F.filter(shingles, lambda v: v < below)))


def hex_digits(hashes: Column) -> Column:
    """A sketch as text, 16 hex digits for each hash (all retained hashes are negative, so hex() gives 16)."""
    return F.array_join(F.transform(hashes, lambda v: F.lower(F.hex(v))), "")


def containment(a: Column, b: Column, equal: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.when(equal, 1.0).when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def listed(values: Iterable[float], of: str) -> Column:
    """A constant array of numbers, as one literal text that the optimizer folds: a literal for each takes seconds to plan."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{of}>")


def cell_of(value: Column, bounds: list[int]) -> Column:
    """Twice the number of bounds up to the value, and one more unless the value is a bound; null for null.

    Bounds (sorted) are looked up in two steps, so a value meets about twice the root of them.
    """
    if not bounds:
        return F.when(value.isNotNull(), F.lit(1))
    step = math.isqrt(len(bounds)) + 1
    heads, flat = listed(bounds[::step], "bigint"), listed(bounds, "bigint")
    place = lambda n: let(F.slice(flat, (n - 1) * step + 1, F.lit(step)), lambda own: 2 * ((n - 1) * step + F.size(F.filter(own, lambda x: x <= value))) + F.when(F.array_contains(own, value), 0).otherwise(1))
    return F.when(value.isNotNull(), let(F.greatest(F.size(F.filter(heads, lambda x: x <= value)), F.lit(1)), place))


def first_bytes(text: Column) -> Column:
    """The first seven bytes of a text as a number, in the order of texts."""
    return F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")


def _quantiles(column: Column, n: int) -> Column:
    return F.percentile_approx(column, listed((i / n for i in range(1, n)), "double"), 4 * n)


def with_buckets(docs: DataFrame, partitions: int) -> tuple[DataFrame, int]:
    """docs with `_bucket`, ranges of (doc_id, text) of about equal counts in ascending order from 0, and how many there are.

    Ranges are cut at quantiles of the ids. An id at which a quantile lies has a cell of its own, and so have null ids; a
    crowded cell of one id is cut again at quantiles of the texts' first bytes.
    """
    found = docs.agg(_quantiles(F.col("doc_id"), CELLS)).first()[0]
    cell = F.coalesce(cell_of(F.col("doc_id"), sorted(set(found or []))), F.lit(-1))
    counts = {r.cell: r.n for r in docs.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}  # 2 x CELLS rows at most
    total = sum(counts.values())
    crowded = [k for k, n in counts.items() if k % 2 == 0 or k == -1 if n * partitions > 2 * total]  # partitions / 2 at most
    sub = F.lit(0)
    if crowded:
        texts = docs.where(cell.isin(crowded)).groupBy(cell.alias("cell")).agg(_quantiles(first_bytes(F.col("text")), 4 * partitions).alias("q")).collect()
        for r in texts:
            sub = F.when(cell == r.cell, cell_of(first_bytes(F.col("text")), sorted(set(r.q)))).otherwise(sub)
        sizes = {(r.cell, r.sub): r.n for r in docs.groupBy(cell.alias("cell"), sub.alias("sub")).agg(F.count("*").alias("n")).collect()}
    else:
        sizes = {(k, 0): n for k, n in counts.items()}
    bucket, filled = {}, 0
    for key in sorted(sizes):
        bucket[key] = filled * partitions // max(1, total)
        filled += sizes[key]
    numbers = {b: i for i, b in enumerate(sorted(set(bucket.values())))}
    of = {key: numbers[b] for key, b in bucket.items()}
    plain = listed((of.get((k, 0), -1) for k in range(-1, max(counts, default=-1) + 1)), "int")
    number = F.element_at(plain, cell + 2)
    for k in crowded:
        own = [of.get((k, j), -1) for j in range(max(j for c, j in of if c == k) + 1)]
        number = F.when(cell == k, F.element_at(listed(own, "int"), sub + 1)).otherwise(number)
    return docs.withColumn("_bucket", number), len(numbers)


def with_next(docs: DataFrame, partitions: int, derived: dict[str, Column] | None = None) -> DataFrame:
    """Columns next_* from the document that follows in descending (doc_id, text); the last one gets the first.

    Derived columns are computed once a row, after the rows are dealt, and have a next_* as well.

    Each bucket also gets the head of the bucket that follows as a ghost row, so one window per bucket sees every
    neighbour and no task sees more than a bucket. Rows that agree in id and in the first bytes stay in one bucket.
    """
    dealt, n = with_buckets(docs, partitions)
    dealt = dealt.withColumn("_ghost", F.lit(False))
    ids = dealt.groupBy("_bucket").agg(F.max("doc_id").alias("_id"))  # a row a bucket, `partitions` at most
    firsts = dealt.join(F.broadcast(ids.withColumnRenamed("_bucket", "_b")), (F.col("_bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    heads = firsts.groupBy("_bucket").agg(F.max_by(F.struct(*docs.columns), "text").alias("h"))
    ghosts = heads.select("h.*", ((F.col("_bucket") + 1) % max(n, 1)).alias("_bucket"), F.lit(True).alias("_ghost"))
    order = Window.partitionBy("_bucket").orderBy("_ghost", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))
    every = dealt.unionByName(ghosts).withColumns(derived or {})
    following = every.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in [*docs.columns, *(derived or {})]])
    return following.where("NOT _ghost").drop("_bucket", "_ghost")


def fingerprints(docs: DataFrame, words: int = 5, scale: int = 8) -> DataFrame:
    """The sketch of every document, of its edited text, and the likeness of both and of the next document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text.alias("text"))
    both = with_next(own, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), {"sketch": sketch(F.col("text"), words, scale)})
    cut = F.floor(F.length("text") / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut)))
    both = both.withColumn("edited_sketch", sketch(F.col("edited"), words, scale))
    same = F.col("text") == F.col("edited")
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        hex_digits(F.col("sketch")).alias("fingerprint"), hex_digits(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch"), same).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch"), F.col("text") == F.col("next_text")).alias("near_next"),
    )


def op10_scaled_sketch(spark, sf_dir) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))

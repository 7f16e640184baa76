"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents (by a hash of seed and id), gone through as often as needed. A document
finishes at the virtual time of its source's cumulative words divided by the source's target. All documents of all
queues, as packets, are range-sorted by that time and the order is truncated at the total budget. A packet in which a
source reaches its target is split there (its first part finishes at time 1), so a source ends at its target to the word
and not a long document before or beyond it; the words that rounding leaves go to the packets that come next.

Targets: sources share the budget by weight; a source stops at `most` times its size and what is above is shared by
weight among the others, until none is above. Each round of that is a grouped sum over the table of sources; three
numbers of it come to the driver. No task sees all rows, or all of a source: running sums go over ranges (`running`).

Edge cases: a null text has no words, like an empty one; its document takes 0. Null is a source of its own, the last. A null
doc_id is shuffled like an id. Repeated rows are documents of their own. Sources without words have the target 0. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .running import running

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"


def shuffle_key(doc_id: Column, seed: str = SEED) -> Column:
    """Hex digest by which documents are shuffled, the same on every run."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)


def targets(sizes: DataFrame, weights: Sequence[int], share: Fraction = Fraction(3, 2), most: int = 2) -> tuple[DataFrame, int]:
    """Of sizes (source, source_size): source, source_size, rank (by code point, null last), target; and the budget."""
    ranked, _ = running(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], "one", "rank", "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).cast("long")
    ranked = ranked.select("source", "source_size", "rank", weight.alias("weight"))
    total = int(ranked.agg(F.sum("source_size")).first()[0] or 0)
    budget = share * total  # exact
    capped, level = 0, None
    for _ in range(10_000):  # each round caps a source or ends
        # a source is above if weight * level > most * size; level as a fraction of whole numbers
        above = F.lit(False) if level is None else F.col("weight").cast("decimal(38,0)") * F.lit(level.numerator).cast("decimal(38,0)") > F.col("source_size").cast("decimal(38,0)") * F.lit(most * level.denominator).cast("decimal(38,0)")
        found = ranked.agg(F.sum(F.when(above, 1).otherwise(0)), F.sum(F.when(above, most * F.col("source_size")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if level is not None and found[0] == capped:
            break
        capped = int(found[0] or 0)
        if not found[2]:
            break
        level = (budget - int(found[1])) / int(found[2])
    level = level or Fraction(0)
    above = F.col("weight").cast("decimal(38,0)") * F.lit(level.numerator).cast("decimal(38,0)") > F.col("source_size").cast("decimal(38,0)") * F.lit(most * level.denominator).cast("decimal(38,0)")
    shared = (F.col("weight") * F.lit(level.numerator)).cast("double") / F.lit(level.denominator).cast("double")
    return ranked.withColumn("target", F.when(above, (most * F.col("source_size")).cast("double")).otherwise(shared)), int(budget)


def queued(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2, seed: str = SEED) -> tuple[DataFrame, int]:
    """row, doc_id, size, source, source_size, rank, target, start (words of its source before it) of every document; and the budget."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    order = [F.col("source").asc_nulls_last(), shuffle_key(F.col("doc_id"), seed), F.col("doc_id").asc_nulls_last(), F.col("size")]
    counted, _ = running(own, order, "size", "upto", "queue")
    counted = written(counted.withColumn("row", F.monotonically_increasing_id()), "queued")
    sizes = written(counted.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("upto").alias("first")), "sizes")
    aims, budget = targets(sizes.drop("first"), weights, share, most)
    aims = written(aims.join(sizes.select(F.col("source").alias("s"), "first"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "of"), "targets")
    met = counted.join(aims, F.col("source").eqNullSafe(F.col("of")))
    return met.select("row", "doc_id", "size", "source", "source_size", "rank", "target", (F.col("upto") - F.col("first")).alias("start")), budget


def scheduled(queue: DataFrame, budget: int, most: int = 2) -> DataFrame:
    """The mix: row, copy, first (word of the document), words, finish, at (words of the mix before it), by finish time.

    queue and budget as `queued` gives them.
    """
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))).alias("copy")
    turns = queue.where("size > 0 AND target > 0").select("row", "size", "rank", "target", "source_size", "start", copies)
    begin = F.col("start") + F.col("copy") * F.col("source_size")
    cut = F.least(F.greatest(F.floor("target") - begin, F.lit(0).cast("long")), F.col("size"))  # words up to the target
    pieces = F.array(F.struct(F.lit(0).cast("long").alias("first"), cut.alias("words")), F.struct(cut.alias("first"), (F.col("size") - cut).alias("words")))
    packets = turns.select("row", "copy", "rank", "target", begin.alias("begin"), F.explode(pieces).alias("p")).where("p.words > 0")
    upto = F.col("begin") + F.col("p.first") + F.col("p.words")
    finish = F.when(upto <= F.floor("target"), upto / F.floor("target")).otherwise(upto / F.col("target"))
    packets = packets.select("row", "copy", "rank", (F.col("begin") + F.col("p.first")).alias("begin"), F.col("p.first").alias("first"), F.col("p.words").alias("words"), finish.alias("finish"))
    placed, _ = running(packets, [F.col("finish"), F.col("rank"), F.col("begin")], "words", "at", "schedule")
    kept = placed.where(F.col("at") < F.lit(budget))
    return kept.select("row", "copy", "first", F.least(F.col("words"), F.lit(budget) - F.col("at")).alias("words"), "finish", "at")


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2, seed: str = SEED) -> DataFrame:
    """doc_id, source, copy, first, words, at: which words of which document stand where in the mix."""
    queue, budget = queued(docs, weights, share, most, seed)
    queue = written(queue, "queue")
    return scheduled(queue, budget, most).join(queue.select("row", "doc_id", "source"), "row").select("doc_id", "source", "copy", "first", "words", "at")


def op12_fair_queueing(spark, sf_dir) -> DataFrame:
    queue, budget = queued(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    queue = written(queue, "queue")
    taken = scheduled(queue, budget).groupBy("row").agg(F.sum("words").alias("taken"))
    return queue.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op12_sql() -> str:
    """The same in one window over all packets. Targets by the order of size to weight: the level at which they add up."""
    return rf"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, row_number() OVER z AS j, coalesce(sum(source_size) OVER (z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(weight) OVER (z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight, sum(source_size) OVER () AS total FROM w WINDOW z AS (ORDER BY source_size / weight, rank)),
l AS (SELECT arg_min(total * 3 - below * 4, j) AS num, arg_min(left_weight, j) AS den FROM o WHERE weight * (total * 3 - below * 4) <= 4 * source_size * left_weight),
t AS (SELECT source, source_size, rank, CASE WHEN weight * l.num > 4 * source_size * l.den THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(weight * l.num AS DOUBLE) / CAST(2 * l.den AS DOUBLE) END AS target, total FROM o, l),
q AS (SELECT row_number() OVER () AS row, doc_id, size, t.*, coalesce(sum(size) OVER (PARTITION BY t.rank ORDER BY sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT row, size, rank, target, total, start + copy * source_size AS begin FROM q, range(2) r(copy) WHERE size > 0 AND target > 0),
k AS (SELECT *, least(greatest(CAST(floor(target) AS BIGINT) - begin, 0), size) AS cut FROM c),
p AS (SELECT row, rank, target, total, begin, cut AS words FROM k UNION ALL SELECT row, rank, target, total, begin + cut, size - cut FROM k),
f AS (SELECT *, CASE WHEN begin + words <= floor(target) THEN CAST(begin + words AS DOUBLE) / floor(target) ELSE CAST(begin + words AS DOUBLE) / target END AS finish FROM p WHERE words > 0),
m AS (SELECT row, words, total * 3 // 2 - coalesce(sum(words) OVER (ORDER BY finish, rank, begin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM f),
taken AS (SELECT row, sum(least(words, room)) AS taken FROM m WHERE room > 0 GROUP BY row)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN taken USING (row)"""

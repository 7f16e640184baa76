"""Target-distribution importance resampling: draw documents whose hashed n-grams look like those of a target corpus.

Texts are cut into words (A-Z as a-z; letters and digits of ASCII, and all beyond ASCII). The words of a block of texts get
ids in byte order; a suffix array over these ids, sorted to `longest` words by prefix doubling, brings equal n-grams
together, and its common-prefix lengths mark the runs of each n-gram. A run is hashed once (crc32 of its words, joined by
a space) and its bucket is scattered back to all its occurrences. Corpus and target counts of the buckets, as many as
there are buckets, come to the driver; the log ratio of their smoothed shares is a bucket's gain, a document's weight is the
sum over its features, and Gumbel noise of its id turns the highest scores into draws without replacement.

Both passes, counting and scoring, read whole texts block by block; ranks come from range partitions (`running`).

Edge cases: a null text has no words, like an empty one: weight 0. Texts below `least_words` words are scored, never drawn. A
null doc_id has the noise of an empty id and is the last among ties; repeated rows are documents of their own. Without
target texts all shares are smoothing alone. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, blocks, lean, text_bytes, written
from .running import running

#: A-Z to a-z; all that is no part of a word to a blank.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def suffix_array(ids: np.ndarray, home: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of word ids (text number `home`, ascending) in order of their first `depth` words, and how many words
    each has in common with the one before; a suffix ends with its text."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, width = ids.astype(np.int64) + 1, 1
    while width < depth:  # prefix doubling; 0 stands for the end of a text
        step = min(width, depth - width)
        later = np.zeros(n, np.int64)
        later[: n - step] = np.where(home[step:] == home[: n - step], rank[step:], 0)
        pair = rank * (int(rank.max()) + 1) + later
        rank = np.unique(pair, return_inverse=True)[1] + 1
        width += step
    order = np.argsort(rank, kind="stable")
    common, alike = np.zeros(n, np.int64), np.ones(n - 1, bool)
    for k in range(depth):
        a, b = order[:-1] + k, order[1:] + k
        inside = (a < n) & (b < n)
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        alike &= inside & (home[a] == home[order[:-1]]) & (home[b] == home[order[1:]]) & (ids[a] == ids[b])
        common[1:] += alike
    return order, common


def buckets(texts: list[bytes], longest: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each feature, the text it is of, and each text's number of words."""
    words = [t.translate(FOLDED).split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for own in words for w in own]
    known = sorted(set(flat))
    place = {w: i for i, w in enumerate(known)}
    ids = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
    home = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)[home] if len(flat) else np.zeros(0, np.int64)
    order, common = suffix_array(ids, home, longest)
    found, of = [], []
    for k in range(1, longest + 1):
        long = order + k <= ends[order]  # suffixes of k words and more
        at, heads = order[long], np.flatnonzero(~long | (common < k))
        starts = heads[long[heads]]  # the first of each run of one k-gram
        if not len(at):
            continue
        hashed = np.array([zlib.crc32(b" ".join([known[i] for i in ids[a : a + k].tolist()])) % number for a in order[starts].tolist()], np.int64)
        run = np.cumsum((common < k)[long]) - 1
        found.append(hashed[run]), of.append(home[at])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found) if found else none), (np.concatenate(of) if of else none), sizes


def _blocks(batch: pa.RecordBatch, size: int = 1 << 21) -> Iterator[tuple[int, int, list[bytes]]]:
    data, at = text_bytes(batch.column("text"))
    for first, last in blocks(at, size):
        yield first, last, [data[a:b].tobytes() for a, b in zip(at[first:last], at[first + 1 : last + 1])]


def counts(texts: DataFrame, longest: int = 1, number: int = 10_000) -> np.ndarray:
    """How many features of all texts (column text) fall into each bucket."""
    def run(batches: Batches) -> Batches:
        total = np.zeros(number, np.int64)
        for batch in batches:
            for _, _, own in _blocks(batch):
                total += np.bincount(buckets(own, longest, number)[0], minlength=number)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(number, np.int64)
    for r in found.collect():  # one row a bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and in the corpus, floored."""
    number, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + number) / ((int(a) + 1) * (t + number)))) for a, b in zip(corpus, target)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Batches) -> Batches:
        value = shared.value
        for batch in batches:
            for first, last, own in _blocks(batch):
                bucket, of, sizes = buckets(own, longest, len(value))
                weight, n = np.zeros(len(own), np.int64), np.bincount(of, minlength=len(own))
                order = np.argsort(of, kind="stable")
                upto = np.concatenate([[0], np.cumsum(value[bucket[order]])])  # whole numbers, exact
                ends = np.cumsum(n)
                weight = upto[ends] - upto[ends - n]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(sizes), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, longest: int = 1, number: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank is null for those not drawn."""
    gain = gains(counts(docs, longest, number), counts(target, longest, number))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = written(weighed(docs, gain, longest).withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    ranked, _ = running(scored.where(able).withColumn("one", F.lit(1).cast("long")), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "one", "before", "ranked")
    rank = F.when(F.col("before") < drawn, F.col("before") + 1).alias("rank")
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranked.select(*names, rank).unionByName(scored.where(~able).select(*names, F.lit(None).cast("long").alias("rank")))


def op13_suffix_resampling(spark, sf_dir) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampled(docs, target).drop("n_words")


def op13_sql() -> str:
    """The same by grouped words; crc32 over the nibbles of a word's bytes."""
    poly, table = 0xEDB88320, []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (poly if i & 1 else 0)
        table.append(i)
    nibbles = "list_transform(range(length(hex(w)) // 2 * 2), lambda i: CAST(strpos('123456789ABCDEF', substr(hex(w), CAST(i + 1 + CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END AS INT), 1)) AS UBIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {nibbles}), lambda a, b: xor(a >> 4, ({table}::UBIGINT[])[CAST(xor(a & 15, b) AS INT) + 1])), 4294967295::UBIGINT) % 10000"
    words = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
    return rf"""WITH own AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
dw AS MATERIALIZED (SELECT row, w, count(*) AS n FROM (SELECT row, {words} AS w FROM own) GROUP BY ALL),
bw AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT {words} AS w FROM benchmark) GROUP BY ALL),
k AS MATERIALIZED (SELECT w, {crc} AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
s AS (SELECT b, sum(n) AS s FROM dw JOIN k USING (w) GROUP BY b), t AS (SELECT b, sum(n) AS t FROM bw JOIN k USING (w) GROUP BY b),
g AS MATERIALIZED (SELECT b, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (b)),
v AS (SELECT row, sum(n) AS n, sum(n * gain) AS weight FROM dw JOIN k USING (w) JOIN g USING (b) GROUP BY row),
z AS (SELECT row, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM own LEFT JOIN v USING (row)),
x AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM z),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, 10 * count(*) OVER () // 100 AS drawn FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM x LEFT JOIN r USING (row)"""

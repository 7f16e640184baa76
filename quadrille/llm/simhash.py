"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints at two or fewer differing bits share at least six of their eight bytes in place. A posting of a single
byte would hold 1/256 of all fingerprints, so a posting is keyed by the bytes at four positions. The positions are the
14 planes of the affine space of 2 x 2 x 2 points: of any six positions three planes hold nothing else, and together
they hold all six. So the tally of the positional bytes that a pair shares, united over the postings it meets in, is
exact from six bytes on; pairs below six (which meet in one posting at most) are dropped by the tally, a grouped
count, and the rest are verified bit by bit.

Postings of more than `posting_limit` fingerprints (many near copies of one text) are linked exactly without forming
pairs: two fingerprints differ in two bits or fewer if and only if some value is within one bit of both, so each sends
itself and its 32 one-bit changes outside the posting's bytes, and all that meet in a value are linked to the least of
them. A pair of which one posting is so large is connected there, whatever its tally in the others.

Fingerprints, not documents, are linked: equal fingerprints collapse first, however many documents have them.

Edge cases: null and empty texts, and texts without words, have fingerprint zero and are linked like others. A null
doc_id takes the component of its fingerprint and is never its id, unless no member has one (then null). Repeated
rows each come out. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, discard, lean, text_bytes, written

#: The positions of each posting, as bits: the points x of a plane, those with an even or an odd number of bits in a & x.
PLANES = tuple(sum(1 << x for x in range(8) if (a & x).bit_count() % 2 == odd) for a in range(1, 8) for odd in (0, 1))


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def bytes_mask(positions: int) -> int:
    """All bits of the bytes at the positions (a bit set), as a signed long."""
    return signed(sum(255 << 8 * k for k in range(8) if positions >> k & 1))


def fingerprint(text: bytes, words_each: int = 3, step: int = 1 << 16) -> int:
    """The 64-bit SimHash (unsigned) of the word shingles of UTF-8 bytes; A-Z count as a-z.

    Spark's xxhash64 is the same function, but a lambda over slices of words takes twice as long as this loop.
    """
    words = text.lower().split()  # on bytes both know ASCII only: A-Z, and \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words_each, len(words)) - 1
    starts, ends = starts[: len(words) - k].tolist(), ends[k:].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), step):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + step], ends[i : i + step])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts)).view("<u8")[0])


def _fingerprints(batches: Batches) -> Batches:
    for batch in batches:
        data, at = text_bytes(batch.column("text"))
        found = [signed(fingerprint(data[a:b].tobytes())) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(_fingerprints), "doc_id long, fp long")


def links(fps: DataFrame, bits: int = 2, posting_limit: int = 64) -> DataFrame:
    """Links a > b between distinct fingerprints (column fp), enough of them to connect all within `bits` (2 or fewer)."""
    masks, fp = [bytes_mask(p) for p in PLANES], F.col("fp")
    keys = F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    index = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    sizes = index.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    index = written(index.join(sizes, ["t", "key"]), "postings")
    small = index.where(F.col("n") <= posting_limit)
    a, b = small.select("t", "key", F.col("fp").alias("a")), small.select("t", "key", F.col("fp").alias("b"))
    positions = F.element_at(F.array(*map(F.lit, PLANES)), F.col("t") + 1)
    shared = a.join(b, ["t", "key"]).where("a > b").groupBy("a", "b").agg(F.bit_or(positions).alias("shared"))
    candidates = shared.where(F.bit_count("shared") >= 8 - bits)
    pairs = candidates.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")
    change = F.lit(None)
    for t, m in enumerate(masks):
        free = [signed(1 << i) for i in range(64) if not m >> i & 1]
        change = F.when(F.col("t") == t, F.array(fp, *[fp.bitwiseXOR(F.lit(x)) for x in free])).otherwise(change)
    near = index.where(F.col("n") > posting_limit).select("fp", "t", F.explode(change).alias("value"))
    least = near.groupBy("t", "value").agg(F.min("fp").alias("b"))
    stars = near.join(least, ["t", "value"]).where("fp > b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b).

    Large-star and small-star rounds: each node is tied to the least of its neighbours until all are stars. Only
    a count and a checksum of the links come to the driver.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, bits: int = 2, posting_limit: int = 64) -> DataFrame:
    """doc_id, fp, component_id for every document."""
    found = written(fingerprints(docs), "fingerprints")
    firsts = found.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = components(links(firsts.select("fp"), bits, posting_limit)).withColumnRenamed("node", "fp")
    linked = firsts.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    return found.join(linked.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark, sf_dir) -> DataFrame:
    marks = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return marks.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

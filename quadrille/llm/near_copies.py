"""Near copies by SimHash over five-word shingles: documents of Jaccard similarity 0.8 or more are linked, one of each component stays.

At a similarity of 0.8 some 10 of a document's 64 SimHash bits differ, too many for an index of its bytes. So a
document is fingerprinted by sections: each of its distinct shingles (words as in simhash, A-Z as a-z, hashed to 64 bits)
falls into one of up to `SECTIONS` sections by its hash, two to four a section, and each section has a SimHash of its
own, the value at that position of the fingerprint. Long documents take every second, fourth and so on shingle by
hash, to keep sections as small. The sections are posted by position and value; documents whose number of shingles is
near the edge of a class (a power of two) are posted under both classes, so that like documents share one.

Under 64 shingles two documents alike by 0.8 differ in at most a quarter of them, so one section at least is free of
differences: the guaranteed minimum. From 64 on, `LEAST_SHARED` equal sections are asked for; 99.9 % of pairs at 0.8
have them, and more above. They are tallied as in simhash: a row for each posting that a pair meets in, and a grouped count. Before that count, pairs are held to a bound that loses nothing: each set has an odd sketch
(512 bits, bit h mod 512 turned over for each shingle hash h), two of which differ in no more bits than the sets in
shingles, at most a ninth of both sizes together at 0.8. It tells 0.75 from 0.8 up to some 500 shingles and little above
1,000. Pairs that pass are compared exactly, on their whole sets, so nothing below 0.8 is ever linked. Sets, not documents, are compared: equal sets collapse first, however many documents have them.

Pairs of a large group would grow with its square. So each set is first compared with the least set of each of its
postings, then, where a posting still holds several components, with some members of the largest one; what that connects
needs no more pairs. The few sets that stay outside a posting's largest component meet all others there that they
aren't connected to; pairs stay if the tally of their meetings reaches enough positions. A pair meets its star's centre
in some of their common postings only, so such pairs meet again in all of them to be tallied.

A posting with more than `most_others` sets outside (a passage that very many documents share) says little. Its sets
meet by their rarest shingles instead: of two sets alike by 0.8 each has one at least of the other's among the fifth (and
one) of its shingles that the fewest of these sets hold, whatever they are, so this loses nothing. Pairs that meet so
are held to the sizes and the odd sketches, not to a number of positions, and compared exactly.

Edge cases: texts of fewer than five words are one shingle; null and empty texts, and texts without words, equal each
other and nothing else. A null doc_id never wins over an id, and its rows all stay. Repeated rows: one stays. Two
texts with one doc_id are two documents. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, blocks, discard, lean, shuffles_reaped, spare, text_bytes, written
from .simhash import components

WORDS, SECTIONS, LEAST_SHARED, CENTRES = 5, 32, 5, 4
ODD_WORDS = 8
_rng = np.random.default_rng(20)
PLACES, FACTORS = (_rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1) for n in (256, WORDS + 2))
BLANKS = (9, 10, 11, 12, 13, 32)


def _folding() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64)
    table[65:91] += np.uint64(32)
    table[list(BLANKS)] = 32
    return table


FOLDED = _folding()


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _cuts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of the texts data[at[i]:at[i+1]], text after text and sorted, and where each text's begin."""
    n, low = len(at) - 1, FOLDED[data[at[0] : at[-1]]]
    blank, row = low == 32, np.repeat(np.arange(n), np.diff(at))
    edge = np.ones(len(low), bool)
    edge[1:] = blank[:-1] | (row[1:] != row[:-1])
    starts = np.flatnonzero(~blank & edge)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    place = np.arange(len(low)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(low)]])))
    letters = np.where(blank, np.uint64(0), (low + np.uint64(1)) * (PLACES[place & 255] + (place >> 8).astype(np.uint64)))
    word = _mixed(np.add.reduceat(letters, starts) + np.add.reduceat(~blank, starts, dtype=np.uint64) * FACTORS[WORDS + 1])
    home = row[starts]
    words = np.bincount(home, minlength=n)
    whole = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        whole += word[k : k + len(whole)] * FACTORS[k]
    inside = np.flatnonzero(home[: len(whole)] == home[WORDS - 1 :])
    short = np.flatnonzero((words > 0) & (words < WORDS))
    own = np.isin(home, short)
    first = _cuts(words)[:-1]
    rest = np.add.reduceat(word[own] * FACTORS[(np.arange(len(word)) - first[home])[own]], np.flatnonzero(np.diff(home[own], prepend=-1))) if len(short) else np.zeros(0, np.uint64)
    of = np.concatenate([home[inside], short])
    found = _mixed(np.concatenate([whole[inside] + np.uint64(WORDS) * FACTORS[WORDS], rest + words[short].astype(np.uint64) * FACTORS[WORDS]]))
    order = np.lexsort((found, of))
    of, found = of[order], found[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (found[1:] != found[:-1])
    return found[new], _cuts(np.bincount(of[new], minlength=n))


def section_keys(found: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The postings of each set found[at[i]:at[i+1]]: a hash of class, position and the section's SimHash for each filled section."""
    n = np.diff(at)
    row, r = np.repeat(np.arange(len(n)), n), _mixed(found ^ FACTORS[0])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    own = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    near = np.floor(np.log2(np.maximum(1.25 * n, 1))).astype(np.int64)
    for level, used in ((own, n > 0), (near, (n > 0) & (near != own))):
        thin, sections = np.maximum(level - 6, 0), np.minimum(1 << np.maximum(level - 1, 0), SECTIONS)
        kept = np.flatnonzero(used[row] & ((r >> (np.uint64(63) - thin[row].astype(np.uint64)) >> np.uint64(1) == 0) | (thin[row] == 0)))
        section = row[kept] * SECTIONS + (r[kept] & (sections[row[kept]] - 1).astype(np.uint64)).astype(np.int64)
        order = np.argsort(section, kind="stable")
        kept, section = kept[order], section[order]
        heads = np.flatnonzero(np.diff(section, prepend=-1))
        if not len(heads):
            continue
        size, bits = np.diff(np.concatenate([heads, [len(kept)]])), np.unpackbits(found[kept].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
        value = np.packbits(2 * np.add.reduceat(bits, heads, axis=0, dtype=np.int32) > size[:, None], axis=1).view("<u8")[:, 0]
        home = section[heads] // SECTIONS
        place = (level[home] * SECTIONS + section[heads] % SECTIONS).astype(np.uint64)
        out.append((home, _mixed(value + place * FACTORS[1])))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    home, key = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(home, kind="stable")
    return key[order], _cuts(np.bincount(home, minlength=len(n)))


def odd_sketches(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The odd sketch of each set found[at[i]:at[i+1]], a row of ODD_WORDS words."""
    n, bits = len(at) - 1, 64 * ODD_WORDS
    odd = np.bincount(np.repeat(np.arange(n), np.diff(at)) * bits + (found % np.uint64(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(bool).reshape(n, bits), axis=1).view("<i8")


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    data, at = text_bytes(batch.column("text"))
    for first, last in blocks(at, 1 << 18):
        found, cuts = shingles(data, at[first : last + 1])
        names = [xxhash.xxh3_64_intdigest(found[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        yield first, last, found, cuts, pa.array(np.array(names, np.uint64).view(np.int64), pa.int64())


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _marked(batches: Batches) -> Batches:
    for batch in batches:
        for first, last, found, cuts, names in _sets(batch):
            part = batch.slice(first, last - first)
            odd = pa.StructArray.from_arrays([pa.array(x) for x in odd_sketches(found, cuts).T.copy()], [f"w{i}" for i in range(ODD_WORDS)])
            columns = [part.column("doc_id"), part.column("text_key"), names, pa.array(np.diff(cuts), pa.int32()), _lists(*section_keys(found, cuts)), odd]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "set", "n", "keys", "odd"])


def _hashes(batches: Batches) -> Batches:
    for batch in batches:
        for _, _, found, cuts, names in _sets(batch):
            yield pa.RecordBatch.from_arrays([names, _lists(found, cuts)], ["set", "hashes"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and text of every document; text_key stands for the text in joins."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _possible(n: str, m: str, odd: str, other: str):
    """Sets whose sizes or odd sketches alone rule out a similarity of 0.8 aren't compared."""
    sized = 5 * F.least(n, m).cast("long") >= 4 * F.greatest(n, m).cast("long")
    differing = reduce(Column.__add__, [F.bit_count(F.col(f"{odd}.w{i}").bitwiseXOR(F.col(f"{other}.w{i}"))) for i in range(ODD_WORDS)])
    return sized & (9 * differing.cast("long") <= F.col(n).cast("long") + F.col(m))


def _tallied(meetings: DataFrame) -> DataFrame:
    """The count filter: of meetings (a, b, least: the smaller size), one for each position that a and b share, the pairs (a, b) that share as many as sets alike by 0.8 do."""
    tally = meetings.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("least").alias("least"))
    return tally.where(F.col("shared") >= F.when(F.col("least") >= 64, LEAST_SHARED).otherwise(1)).select("a", "b")


def _similar(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose exact Jaccard similarity is 0.8 or more."""
    one, other = (hashes.select(F.col("set").alias(name), F.col("hashes").alias(x)) for name, x in (("a", "x"), ("b", "y")))
    both = pairs.join(one, "a").join(other, "b")
    return both.where(9 * F.size(F.array_intersect("x", "y")).cast("long") >= 4 * (F.size("x").cast("long") + F.size("y"))).select("a", "b")


def _stars(index: DataFrame, order, centres: int) -> DataFrame:
    """Pairs (a, b) of each set of index (set, n, root, odd, key) with the first sets of its postings by `order`, of another root."""
    first = F.slice(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("set").alias("s"), F.col("n").alias("m"), F.col("root").alias("r"), "odd"))), 1, centres)
    kept = index.groupBy("key", F.pmod(F.xxhash64("set"), F.lit(64)).alias("slice")).agg(first.alias("low"))  # so that no group holds a whole posting
    kept = kept.select("key", F.explode("low").alias("c")).groupBy("key").agg(F.slice(F.array_sort(F.collect_list("c")), 1, centres).alias("low"))
    kept = kept.select(F.col("key").alias("k"), F.explode("low").alias("c"))
    pairs = index.join(kept, (F.col("key") == F.col("k")) & (F.col("root") != F.col("c.r")) & _possible("n", "c.m", "odd", "c.odd"))
    return pairs.select(F.greatest("set", "c.s").alias("a"), F.least("set", "c.s").alias("b")).distinct()


def _meetings(pairs: DataFrame, postings: DataFrame) -> DataFrame:
    """A row (a, b, least) for each posting that both sets of a pair are in: a pair meets its star's centre in some of them only."""
    one, other = (postings.select(F.col("set").alias(name), F.col("n").alias(size), "key") for name, size in (("a", "n"), ("b", "m")))
    return pairs.join(one, "a").join(other, ["b", "key"]).select("a", "b", F.least("n", "m").alias("least"))


def _unsettled(index: DataFrame) -> DataFrame:
    """Of index (set, n, root, key), the rows under keys that hold several roots, with `main` (the commonest root), `others` (sets outside it) and `all`."""
    sizes = index.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key")
    sizes = sizes.agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("all")).where(F.col("m.c") < F.col("all"))
    return index.join(sizes.select("key", F.col("m.root").alias("main"), (F.col("all") - F.col("m.c")).alias("others"), "all"), "key")


def _by_rarest(index: DataFrame, hashes: DataFrame) -> DataFrame:
    """The sets of index (set, n, root, odd) under the rarest fifth, and one, of their shingles.

    Rare by the number of these sets that hold a shingle, ties by its hash: one order for all, so that like sets share one.
    Shingles that a single set holds come first and make no posting.
    """
    sets = index.dropDuplicates(["set"]).select("set", "n", "root", "odd")
    held = sets.select("set").join(hashes, "set").select("set", F.explode("hashes").alias("h"))
    counts = held.groupBy("h").agg(F.count("*").alias("c"))
    ranked = held.join(counts, "h").groupBy("set").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("all"))  # one text's shingles
    size = F.size("all")
    prefix = F.filter(F.slice("all", 1, size - F.ceil(size * 4 / 5).cast("int") + 1), lambda x: x["c"] > 1)
    return sets.join(ranked.select("set", F.explode(F.transform(prefix, lambda x: x["h"])).alias("key")), "set")


def _across(index: DataFrame) -> DataFrame:
    """A row (a, b, least) for each key under which two sets meet that aren't connected yet."""
    left = index.where("root <> main").select(F.col("key").alias("k"), F.col("set").alias("s"), F.col("n").alias("sn"), F.col("root").alias("sr"), F.col("odd").alias("sd"))
    right = index.select("key", "set", "n", "root", "main", "odd")
    apart = (F.col("sr") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("s") > F.col("set")))
    pairs = left.join(right, (F.col("k") == F.col("key")) & apart & _possible("sn", "n", "sd", "odd"))
    return pairs.select(F.greatest("s", "set").alias("a"), F.least("s", "set").alias("b"), F.least("sn", "n").alias("least"))


def near_copies(docs: DataFrame, most_others: int = 2048) -> DataFrame:
    """doc_id, text_key, root for every document; near copies have one root."""
    found = written(keyed(docs).mapInArrow(lean(_marked), f"doc_id long, text_key long, set long, n int, keys array<long>, odd struct<{', '.join(f'w{i}: long' for i in range(ODD_WORDS))}>"), "shingled")
    with shuffles_reaped(docs.sparkSession):
        rooted = _rooted(docs, found, most_others)
    marks = found.select("doc_id", "text_key", "set").join(rooted.withColumnRenamed("node", "set"), "set", "left")
    marks = written(marks.select("doc_id", "text_key", F.coalesce("root", "set").alias("root")), "marks")
    discard(found, rooted)
    return marks


def _grown(rooted: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root with the edges (a, b) added. Only their ends' roots are searched for components, not what is linked already."""
    ends = rooted.select(F.col("node").alias("end"), F.col("root").alias("of"))
    for side in ("a", "b"):
        edges = edges.join(ends.withColumnRenamed("of", f"r{side}"), F.col(side) == F.col("end"), "left").drop("end")
    between = edges.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
    more = written(components(between), "more")
    above = more.select(F.col("node").alias("before"), F.col("root").alias("after"))
    moved = rooted.join(above, F.col("root") == F.col("before"), "left").select("node", F.coalesce("after", "root").alias("root"))
    out = written(moved.unionByName(more.join(rooted.select("node"), "node", "left_anti")), "rooted")
    discard(more)
    return out


def _rooted(docs: DataFrame, found: DataFrame, most_others: int) -> DataFrame:
    """node, root of the sets that are linked."""
    def now(index: DataFrame, rooted: DataFrame) -> DataFrame:
        """The unsettled rows of index by the roots."""
        own = rooted.withColumnRenamed("node", "set")
        return written(_unsettled(index.drop("root", "main", "others", "all").join(own, "set", "left").withColumn("root", F.coalesce("root", "set"))), "unsettled")

    sets = written(found.groupBy("set").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("odd").alias("odd"), F.min("text_key").alias("text_key")), "sets")
    index = sets.select("set", "n", F.explode("keys").alias("key"))
    sizes = index.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    postings = written(index.join(sizes, "key").join(sets.select("set", "odd"), "set"), "postings")
    members = sets.join(postings.select("set").distinct(), "set", "left_semi").select("text_key")
    texts = keyed(docs).select("text_key", "text").join(members, "text_key", "left_semi").dropDuplicates(["text_key"])
    hashes = written(texts.mapInArrow(lean(_hashes), "set long, hashes array<long>"), "hashes")
    met = _stars(postings.withColumn("root", F.col("set")), F.lit(0), 1)
    stars = written(_similar(_tallied(_meetings(met, postings)), hashes), "stars")
    rooted = [written(components(stars), "rooted")]
    first = now(postings, rooted[0])
    met = _stars(first, F.struct(F.col("root") != F.col("main"), F.xxhash64("set", "key")), CENTRES)
    more = written(_similar(_tallied(_meetings(met, first)), hashes), "stars")  # sets of two roots share no posting but unsettled ones
    rooted.append(_grown(rooted[0], more))
    index = now(first, rooted[1])
    used = [postings, first, index]
    small, crowded = index.where(F.col("others") <= most_others), index.where(F.col("others") > most_others)
    pairs = [written(_tallied(_across(small)), "across")]
    if not crowded.isEmpty():  # pairs that share a crowded posting, and perhaps too few others, are all found here
        rare = written(_unsettled(_by_rarest(crowded, hashes)), "rare")
        used.append(rare)
        pairs.append(written(_across(rare).select("a", "b").distinct(), "across"))
    across = written(_similar(reduce(DataFrame.unionByName, pairs).distinct(), hashes), "across")
    out = _grown(rooted[1], across)
    discard(sets, hashes, stars, more, across, *rooted, *used, *pairs)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents but for near copies: of each component the one with the smallest doc_id stays.

    Of several texts of a component with the doc_id that stays, one stays (the least); documents without an id all stay.
    """
    marks = near_copies(docs)
    least = marks.groupBy("root").agg(F.min("doc_id").alias("doc_id"))
    kept = marks.join(least.where("doc_id IS NOT NULL"), ["root", "doc_id"]).groupBy("doc_id", "text_key", "root").agg(F.count("*").alias("copies"))
    kept = written(kept, "kept")
    discard(marks)
    own, text, root, rank = spare(docs, "own", "text_key", "root", "rank")
    stay = docs.withColumns({own: F.col("doc_id").cast("long"), text: F.xxhash64(F.col("text").cast("string"))})
    stay = stay.join(kept.select(F.col("doc_id").alias(own), F.col("text_key").alias(text), F.col("root").alias(root)), [own, text])
    if not kept.groupBy("doc_id", "root").agg(F.sum("copies").alias("n")).where("n > 1").isEmpty():
        stay = stay.withColumn(rank, F.row_number().over(Window.partitionBy(own, root).orderBy("text"))).where(F.col(rank) == 1)
    return stay.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))

"""Byte-level BPE by corpus-level merge replay.

The distinct words of a batch of documents form a corpus. An inverted index from token pair to word positions is
built once; then merges are replayed in rank order: the pair of the lowest rank is merged at all its positions, and
only the pairs with the touched neighbours are taken out or added. A word's own merges thus come in the order in
which a word-by-word encoder makes them. Words that are tokens as a whole are not split. The ids of words seen
before are kept between the batches of a partition, up to a bound.

Edge cases: null and empty texts have no tokens; special-token strings are ordinary text; repeated rows each come
out; an empty table gives an empty result; columns but doc_id and text are not read. Text that isn't in the
vocabulary can't occur, since all single bytes are tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkIds
from .common import lean

#: Cuts a text where PATTERN always cuts too: words with the one space before them, and white space.
ROUGH = re.compile(r" ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+")

MOST_WORDS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def replay(words: list[bytes], ranks: dict[bytes, int], tokens: list[bytes]) -> list[list[int]]:
    """The ids of each word after all merges, over all words at once.

    Symbols of all words lie in one array, with the places of the next and the previous symbol (-1 at a word's
    ends). A pair with few positions is merged by a plain loop, one with many by array operations on the same memory.
    """
    size = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(size)
    n = int(ends[-1]) if len(words) else 0
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    sym = array("q", single[np.frombuffer(b"".join(words), np.uint8)].tobytes())
    after, before = array("q", np.arange(1, n + 1).tobytes()), array("q", np.arange(-1, n - 1).tobytes())
    s, nxt, prv = (np.frombuffer(x, np.int64) if n else np.zeros(0, np.int64) for x in (sym, after, before))
    full = ends[size > 0]
    nxt[full - 1] = -1
    prv[full - size[size > 0]] = -1

    known: dict[int, int] = {}  # pair to the rank of its merge, -1 if there is none
    index: dict[int, list] = {}  # pair to its positions: numbers and arrays
    queue: list[tuple[int, int]] = []

    def add(pair: int, at) -> None:
        there = index.get(pair)
        if there is not None:
            there.append(at)
            return
        rank = known.get(pair)
        if rank is None:
            rank = known[pair] = ranks.get(tokens[pair >> 32] + tokens[pair & 0xFFFFFFFF], -1)
        if rank >= 0:
            index[pair] = [at]
            heapq.heappush(queue, (rank, pair))

    def add_all(pairs: np.ndarray, at: np.ndarray) -> None:
        if len(pairs) <= 4:
            for p, i in zip(pairs.tolist(), at.tolist()):
                add(p, i)
            return
        order = np.argsort(pairs, kind="stable")
        pairs, at = pairs[order], at[order]
        cuts = np.flatnonzero(pairs[1:] != pairs[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for p, i, j in zip(pairs[starts].tolist(), starts, [*starts[1:], len(pairs)]):
            add(p, at[i:j] if j - i > 1 else int(at[i]))

    left = np.flatnonzero(nxt >= 0)
    add_all(s[left] << 32 | s[left + 1], left)
    while queue:
        rank, pair = heapq.heappop(queue)
        a, b = pair >> 32, pair & 0xFFFFFFFF
        found = index.pop(pair)
        if len(found) <= 4 and all(type(x) is int for x in found) or a == b:
            flat = found if all(type(x) is int for x in found) else np.concatenate([np.atleast_1d(x) for x in found]).tolist()
            for i in sorted(flat):  # from left to right, as it matters where both tokens are the same
                j = after[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue  # a neighbour's merge took one of the two
                k, h = after[j], before[i]
                sym[i], sym[j], after[i] = rank, -1, k
                if k >= 0:
                    before[k] = i
                    add(rank << 32 | sym[k], i)
                if h >= 0:
                    add(sym[h] << 32 | rank, h)
            continue
        at = np.unique(np.concatenate([np.atleast_1d(x) for x in found]))
        j = nxt[at]
        good = (s[at] == a) & (j >= 0) & (s[j] == b)
        at, j = at[good], j[good]
        if not len(at):
            continue
        k, h = nxt[j], prv[at]
        s[at], s[j], nxt[at] = rank, -1, k
        more = k >= 0
        prv[k[more]] = at[more]
        add_all(rank << 32 | s[k[more]], at[more])
        less = prv[at] >= 0
        h = prv[at][less]
        add_all(s[h] << 32 | rank, h)
    live = s >= 0
    flat = s[live].tolist()
    kept = np.concatenate([[0], np.cumsum(live)])[np.concatenate([[0], ends])].tolist() if len(words) else [0]
    return [flat[i:j] for i, j in zip(kept[:-1], kept[1:])]


class Codec:
    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        # \s of the pattern means Unicode's white space, which U+001C to U+001F aren't
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\t-\r \x85\p{Z}").replace(r"\s", r"[\t-\r \x85\p{Z}]")).findall
        self.cache = ChunkIds(self._encode)
        self.done: dict[str, tuple[int, ...]] = {}  # ids of words, up to MOST_WORDS
        size = np.array([len(t) for t in self.tokens], np.int64)
        self.size, self.start = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = list(map(self.split, chunks))
        words = list(chain.from_iterable(parts))
        distinct = dict.fromkeys(words)
        new = [w for w in distinct if w not in self.done]
        if len(self.done) + len(new) > MOST_WORDS:
            self.done, new = {}, list(distinct)
        done, ranks = self.done, self.ranks
        coded = [w.encode() for w in new]
        done.update((w, (ranks[b],)) for w, b in zip(new, coded) if b in ranks)
        rest = [(w, b) for w, b in zip(new, coded) if b not in ranks]
        done.update(zip([w for w, _ in rest], map(tuple, replay([b for _, b in rest], ranks, self.tokens))))
        ids = list(map(done.__getitem__, words))
        last = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        sizes = np.diff(last[np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])])
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, last[-1])
        if len(done) > MOST_WORDS:
            self.done = {}
        return flat, sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.cache.ids([ROUGH.findall(t) for t in texts])

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        last = np.cumsum(size)
        return self.bytes[np.arange(last[-1] if len(last) else 0) + np.repeat(self.start[ids] - (last - size), size)].tobytes()


def groups(texts: list[str], size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `size` characters."""
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (32-bit little-endian) and decoded (bytes of the decoded ids) for every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(path, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in groups(texts):
                ids = own.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(lean(run), "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes, taken where the ids are made."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hexed = Codec(path, pattern), lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in groups(texts):
                ids = own.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array([len(x) for x in ids], pa.int64()), pa.array([hexed(x.astype("<u4").tobytes()) for x in ids]), pa.array([hexed(own.decode(x)) for x in ids])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_merge_replay(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

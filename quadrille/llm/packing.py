"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each document's ids (with an end mark) are cut into windows of the full capacity, which need no partner, and a rest.
The rests of a block are parted into as few windows as could hold them: every rest starts as a partial partition of
its own, and the two partial partitions of the largest imbalance merge, largest window with smallest, until one is
left, whose windows are near-equal. Where a window exceeds the capacity the window count rises and all is parted
anew. Rests stay whole where six or more go into a window, else they are cut into smaller pieces, which even out to
less than `padding`. What would begin a poorly filled window waits for the next block, and at a
partition's end is dealt out in sequences of power-of-two lengths, which aren't padded.

A task packs the documents of its partition block by block, and a block is bounded by ids and by rests, so memory
holds a block and nothing is shuffled; very long documents are just many windows.

Edge cases: null and empty texts are the end mark alone; repeated rows are packed as often as they occur (their
pieces look alike but lie in different places); a null doc_id stays null; an empty table gives an empty result;
columns but doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import groups
from .chunks import ChunkIds
from .common import lean

END = 1
#: The tokenizer's own cut of normalised text, in terms of `re`: contractions, letters, digits, and the rest.
CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: What `re` and the tokenizer take differently: separators that aren't white space there, numbers that aren't
#: digits, a letter whose lower case depends on its place, and letters that one's Unicode tables may not have yet (some
#: Latin and Cyrillic ones, and all beyond U+FFFF). Texts that have them are encoded as a whole.
ODD = regex.compile(r"(?V1)[\x1c-\x1f\p{Nl}\p{No}\u03a3\u1c80-\u1c8f\ua7cb-\ua7ff[[\p{L}\p{M}\p{N}\p{Cn}]&&[\U00010000-\U0010ffff]]]")


class WordTokenizer:
    """Ids of whole texts through the ids of their distinct runs without white space, and of these by their distinct
    pieces (words, digits, punctuation).

    No piece holds white space, so texts are split at it, which is far quicker than cutting them; Arrow splits a group of
    texts and numbers its distinct runs, and only new runs are cut. Pieces are normalised and cut already, so the
    tokenizer that encodes them has neither step. Words are encoded thousands at a time in one text and told apart by their last tokens, which carry the
    vocabulary's mark for a word's end.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.bare = path, Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.bare.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.pieces = ChunkIds(self._encode)
        self.cache = ChunkIds(self._cut)

    @cached_property
    def own(self):
        """The tokenizer with all its steps, for the few texts that are encoded as a whole."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _cut(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, cuts = self.pieces.flat_ids(list(map(CUT.findall, runs)))
        return found, np.diff(cuts)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(pieces), 5000):
            part = pieces[i : i + 5000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                flat.append(ids[: ends[-1]])
                sizes.append(np.diff(ends, prepend=0))
            else:
                each = [e.ids for e in self.bare.encode_batch_fast(part, add_special_tokens=False)]
                flat.append(np.array([t for own in each for t in own], np.int64))
                sizes.append(np.array([len(own) for own in each], np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        odd = {i for i, t in enumerate(texts) if "<|" in t or (ODD.search(t) if not t.isascii() or any(c in t for c in "\x1c\x1d\x1e\x1f") else False)}
        plain = [t.lower() if t.isascii() else unicodedata.normalize("NFC", t).lower() for t in texts]
        runs = pc.utf8_split_whitespace(pa.array(["" if i in odd else t for i, t in enumerate(plain)], pa.large_string()))
        coded = runs.flatten().dictionary_encode()
        flat, cuts = self.cache.flat_ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), runs.value_lengths().to_numpy())
        found = np.split(flat, cuts[1:-1]) if texts else []
        for i in odd:
            found[i] = np.array(self.own.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return found


def _united(a: tuple, b: tuple, windows: int, trees: list[tuple]) -> tuple:
    """Two partial partitions merged: the largest window of the one with the smallest of the other, and so on."""
    (sums_a, own_a), (sums_b, own_b) = a, b
    if len(sums_a) + len(sums_b) <= windows:
        sums, own = np.concatenate([sums_a, sums_b]), np.concatenate([own_a, own_b])
    else:
        sums, own = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[windows - len(sums_a) :], own[windows - len(sums_a) :] = sums_a, own_a
        sums[: len(sums_b)] += sums_b[::-1]
        other = own_b[::-1]
        for k in np.flatnonzero(own[: len(other)] >= 0).tolist():
            trees.append((int(own[k]), int(other[k])))
            own[k] = len(trees) - 1
        lone = np.flatnonzero(own[: len(other)] < 0)
        own[lone] = other[lone]
    by = np.argsort(sums, kind="stable")
    sums, own = sums[by], own[by]
    return (sums - sums[0] if len(sums) == windows else sums), own


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: parts numbers 0..n-1 into `windows` lists whose sums of sizes are near-equal.

    A partial partition is the sums of its windows in ascending order, less the least, and the item tree of each;
    windows without items are left out. Always the two of the largest imbalance are merged.
    """
    trees: list[tuple] = [(i,) for i in range(len(sizes))]
    parts: dict[int, tuple] = {i: (np.array([size], np.int64), np.array([i], np.int64)) for i, size in enumerate(sizes)}
    heap = [(-size if windows > 1 else 0, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    for order in range(len(sizes), 2 * len(sizes) - 1):
        first, second = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        parts[order] = _united(parts.pop(first), parts.pop(second), windows, trees)
        heapq.heappush(heap, (-int(parts[order][0][-1]), order))
    out: list[list[int]] = [[] for _ in range(windows)]
    for items, root in zip(out, parts[heap[0][1]][1].tolist() if heap else []):
        stack = [root] if root >= 0 else []
        while stack:
            node = trees[stack.pop()]
            if len(node) == 1:
                items.append(node[0])
            else:
                stack += node
    return out


def windows_of(sizes: list[int], capacity: int, count: int) -> list[list[int]]:
    """Item numbers in `count` near-equal windows; while one exceeds the capacity the count rises and all is parted anew.

    No size exceeds the capacity, so at the latest one window an item fits.
    """
    while True:
        parts = difference(sizes, count)
        over = max(sum(sizes[i] for i in part) for part in parts) - capacity
        if over <= 0:
            return [part for part in parts if part]
        even = sum(sizes) / count
        count = max(count + 1, math.ceil(sum(sizes) / (even - over))) if even > over else len(sizes)


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Pieces (rest, start, length) dealt into sequences of power-of-two lengths, longest first."""
    left, out = sum(p[2] for p in pieces), []
    pieces = list(reversed(pieces))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            item, start, length = pieces.pop()
            cut = min(room, length)
            out[-1].append((item, start, cut))
            room -= cut
            if length > cut:
                pieces.append((item, start + cut, length - cut))
    return out


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def block_windows(sizes: list[int], capacity: int, padding: float, slack: float) -> list[list[tuple[int, int, int]]]:
    """The rests of a block in windows of pieces (rest, start, length).

    `slack`: ids that a window is expected to stay short of, where the window count starts. Rests are cut into quarters
    of a window where there are fewer than six of them a window, and into eighths where that leaves too much padding.
    """
    total = sum(sizes)
    for most in (capacity if len(sizes) * capacity >= 6 * total else capacity // 4, capacity // 8):
        pieces = [(i, at, min(most, size - at)) for i, size in enumerate(sizes) for at in range(0, size, most)]
        parts = windows_of([n for _, _, n in pieces], capacity, max(-(-total // capacity), int(total / (capacity - slack))))
        if total >= (1 - padding) * capacity * len(parts):
            break
    return [[pieces[k] for k in part] for part in parts]


def packed(docs: DataFrame, path: str, capacity: int = 2048, block: int = 256, most_rests: int = 4096, padding: float = 0.02, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their places; `keep_ids` adds the ids themselves (32-bit little-endian).

    `block`: windows of rests that are packed together; `most_rests`: rests at most, for blocks of short texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = WordTokenizer(path), NAMES + ["ids"] * keep_ids
        next_id = TaskContext.get().partitionId() << 40
        rests: list[tuple] = []  # doc_id, ids, start and length of the rest
        waiting, slack, rows = 0, 0.0, {n: [] for n in names}

        def lay(sequence: list[tuple], offset: int = 0) -> None:
            nonlocal next_id
            for doc_id, ids, start, length in sequence:
                piece = ids[start : start + length].tobytes()
                for name, value in zip(names, (doc_id, start, length, zlib.crc32(piece), len(ids), next_id, offset, piece)):
                    rows[name].append(value)
                offset += length
            next_id += 1

        def lay_all(windows: list[list[tuple[int, int, int]]]) -> None:
            for window in windows:
                lay([(rests[i][0], rests[i][1], rests[i][2] + s, n) for i, s, n in window])

        def pack() -> None:
            """Pack what fills windows; what is beyond that keeps waiting."""
            nonlocal waiting, slack
            kept, fill = [], waiting // (capacity - 8) * (capacity - 8)
            while waiting > fill:
                doc_id, ids, start, length = rests.pop()
                waiting -= length
                if waiting < fill:  # this one is cut
                    rests.append((doc_id, ids, start, fill - waiting))
                    start, length, waiting = start + fill - waiting, length - (fill - waiting), fill
                kept.append((doc_id, ids, start, length))
            if rests:
                parts = block_windows([r[3] for r in rests], capacity, padding, slack)
                slack = 0.9 * min(capacity - fill / len(parts), padding * capacity)
                lay_all(parts)
            rests[:] = reversed(kept)
            waiting = sum(r[3] for r in rests)

        def finish() -> None:
            if waiting >= capacity - 8:
                pack()
            lay_all(powers([(i, 0, r[3]) for i, r in enumerate(rests)]))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(rows[n], pa.binary() if n == "ids" else pa.int64()) for n in names], names)
            for n in names:
                rows[n] = []
            return out

        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in groups(texts, 1 << 20):
                for doc_id, ids in zip(keys[a:b], own.ids(texts[a:b])):
                    ids = np.append(ids, END).astype("<u4")
                    whole = len(ids) // capacity * capacity
                    for start in range(0, whole, capacity):
                        lay([(doc_id, ids, start, capacity)])
                    if whole < len(ids):
                        rests.append((doc_id, ids if len(ids) < 8 * capacity else _Tail(ids, whole), whole, len(ids) - whole))
                        waiting += len(ids) - whole
                    if waiting >= block * capacity or len(rests) >= most_rests:
                        pack()
                yield flush()
        finish()
        yield flush()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(lean(run), COLUMNS + ", ids binary" * keep_ids)


class _Tail:
    """The end of a long document's ids, so that a waiting rest doesn't hold the whole document."""

    def __init__(self, ids: np.ndarray, start: int):
        self.ids, self.first, self.n = ids[start:].copy(), start, len(ids)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, part: slice) -> np.ndarray:
        return self.ids[part.start - self.first : part.stop - self.first]


def op9_differencing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

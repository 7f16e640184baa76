"""Suffix-array deduplication: bytes that repeat a passage of a document with a smaller doc_id go.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id. Suffixes are sorted to
that length, and neighbours with a common prefix of 50 bytes or more belong together. So that suffixes which can be
alike meet in one task, and no others are moved, the corpus is first thinned:

1. The 50-byte strings starting in a document form runs that share their least 24-byte gram (by hash). Equal strings
   have the same least gram, so runs meet by it. Hashes only bring runs together; what is equal is told by bytes.
   A gram that several documents of a batch have is known to repeat there and then, and one witness of it travels with
   the number of its runs; of the others each run sends about 12 bytes, packed into one binary row for each batch and
   part. So the runs of every gram are counted over the whole table.
2. The bytes of all runs of grams that several documents have meet by gram. Runs of equal bytes collapse into one, first
   within a batch, then within a part; the least document of each counts. The suffixes of what is left are sorted
   deep-shallow: dealt by their first two bytes, a multikey quicksort on eight-byte words to a shallow depth, then
   blind tries for what still shares its prefix (two suffixes alone need one comparison). Of equal strings all but the
   smallest document's are repeats.
3. Repeats return to their documents as byte ranges.

A crowded gram (a common line in ever other surroundings), one with more than `crowd` runs in the table, is dealt by
document over so many parts that each gets about `crowd` of its runs. Each of these parts then sends one row for each of
the gram's strings it holds, with its least document, and the least of all is
a grouped minimum. No step pairs documents or holds all runs of a gram. A part stands for about `part_bytes` of text,
so memory doesn't grow with the corpus. Tasks get the crowded grams and their counts as a broadcast of at most `MOST_CROWDED`
entries (64 MB): if there were more, the bound on runs rises to their mean, which at most so many exceed. Long texts are cut into overlapping segments, so arrays stay small.

Edge cases: null counts as empty; texts under 50 bytes lose nothing; a null doc_id has no order, so it neither loses
bytes nor makes others lose them; rows that share a doc_id don't affect one another (nor do equal rows, which have
equal results); an empty table gives an empty result; other columns pass through `deduplicated` untouched, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, blocks, discard, lean, shuffles_reaped, spare, text_bytes, written

LENGTH, GRAM, SEGMENT = 50, 24, 1 << 20
LONGEST_RUN, WITNESS, CROWD, MOST_CROWDED = 254, 255, 4096, 1 << 22
SHALLOW = 16
MIX, ROOT = np.uint64(0xD6E8FEB86659FD93), 0x9E3779B97F4A7C15


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    out = []
    for root in (ROOT, pow(ROOT, -1, 1 << 64)):
        steps = np.full(SEGMENT + (1 << 16), root, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return tuple(out)


_tables: list = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(32))


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs of string starts in texts data[bounds[i]:bounds[i+1]] (SEGMENT bytes and a bit in all at most):
    text, start in data, number of starts, hash of the gram."""
    if not _tables:
        _tables.extend(_powers())
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64)
    power, inverse = (t[: n + 1] for t in _tables)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(data * power[:n], out=total[1:])
    least = _mixed((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    width, want = 1, LENGTH - GRAM + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    valid = np.arange(len(least)) + LENGTH <= bounds[text + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (valid[1:] & ~valid[:-1])
    starts = np.flatnonzero(new & valid)
    ends = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]])) + 1
    if len(starts) and (ends - starts).max() > LONGEST_RUN:
        many = -(-(ends - starts) // LONGEST_RUN)
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        starts, ends = np.repeat(starts, many) + k * LONGEST_RUN, np.repeat(ends, many)
        ends = np.minimum(starts + LONGEST_RUN, ends)
    return text[starts], starts, ends - starts, _mixed(least[starts] ^ np.uint64(ROOT)) >> np.uint64(16)


def segments(at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Byte ranges of about SEGMENT bytes with the bounds and rows of their texts; longer texts come in overlapping parts."""
    first, n = 0, len(at) - 1
    while first < n:
        if at[first + 1] - at[first] > SEGMENT:
            for a in range(int(at[first]), int(at[first + 1]) - LENGTH + 1, SEGMENT):
                b = min(a + SEGMENT + LENGTH - 1, int(at[first + 1]))
                yield a, b, np.array([0, b - a]), np.array([first])
            first += 1
            continue
        last = max(first + 1, int(np.searchsorted(at, at[first] + SEGMENT, "right")) - 1)
        yield int(at[first]), int(at[last]), at[first : last + 1] - at[first], np.arange(first, last)
        first = last


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of each number, plane by plane: zero planes cost nothing once compressed."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(data: memoryview, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8")[:, 0], at + n * width


def part_of(gram: np.ndarray, parts: int) -> np.ndarray:
    """The part of a 48-bit gram hash, by its upper bits."""
    return ((gram >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)


CODEC = "zstd"  # the runs of copies compress much better by it than by the shuffle's own
PARTED, PARTED_NAMES = "part int, packed binary, doc_id long, _d long, at binary", ["part", "packed", "doc_id", "_d", "at"]
MARKS, MARK_NAMES = "doc_id long, _d long, at binary, string binary", ["doc_id", "_d", "at", "string"]


def _parted(part: list[int], packed: list, own: list[tuple]) -> pa.RecordBatch:
    """Packed rows for parts, and rows (part, doc_id, _d, at) that only pass through the shuffle."""
    columns = [part + [x[0] for x in own], packed + [None] * len(own), *([None] * len(part) + [x[k] for x in own] for k in (1, 2, 3))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], PARTED_NAMES)


def _by_document(ids: np.ndarray, twins: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One row of values for each document."""
    order = np.lexsort((twins, ids))
    ids, twins, values = ids[order], twins[order], values[order]
    cut = np.flatnonzero((ids[1:] != ids[:-1]) | (twins[1:] != twins[:-1])) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(ids)]):
        if b > a:
            yield int(ids[a]), int(twins[a]), values[a:b].tobytes()


def _marks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], MARK_NAMES)


def _passed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows that only pass through, as marks."""
    own = batch.filter(pa.array(batch.column("part").to_numpy() < 0))
    return pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("_d"), own.column("at"), pa.nulls(len(own), pa.binary())], MARK_NAMES)


def _heads(values: np.ndarray) -> np.ndarray:
    """Where each group of equal neighbours begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _spread(values: np.ndarray, heads: np.ndarray, n: int) -> np.ndarray:
    """A group's value for each of its members."""
    return np.repeat(values, np.diff(np.concatenate([heads, [n]])))


def _packed(ids, twins, row, columns: tuple[tuple[np.ndarray, int], ...], part: np.ndarray, parts: int, data: np.ndarray | None = None, length: np.ndarray | None = None, kept: np.ndarray | None = None) -> tuple[list[int], list[bytes]]:
    """One binary for each part: documents with their numbers of rows, the rows' columns by byte planes, and their bytes.
    kept: the rows that go, all if None; `part` is theirs."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    order = order if kept is None else kept[order]
    begins = np.cumsum(length) - length if data is not None else None
    out: tuple[list, list] = ([], [])
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        o = order[cuts[p] : cuts[p + 1]]
        heads = _heads(row[o])
        docs = row[o[heads]]
        size = np.diff(np.concatenate([heads, [len(o)]]))
        packed = np.array([len(o), len(docs)], "<u4").tobytes() + _planes(ids[docs].view(np.uint64), 8) + _planes(twins[docs].view(np.uint64), 4) + _planes(size, 4)
        packed += b"".join(_planes(x[o], width) for x, width in columns)
        if data is not None:
            packed += b"".join(data[a : a + n].tobytes() for a, n in zip(begins[o].tolist(), length[o].tolist()))
        out[0].append(p)
        out[1].append(len(packed).to_bytes(8, "little") + pa.compress(packed, CODEC, asbytes=True))
    return out


def _unpacked(held: list[bytes], widths: tuple[int, ...]) -> tuple[list[np.ndarray], list[bytes]]:
    """ids, twins and the columns of all rows, and the bytes that follow them in each binary."""
    columns: list[list[np.ndarray]] = [[] for _ in range(2 + len(widths))]
    rest = []
    for small in held:
        packed = pa.decompress(memoryview(small)[8:], int.from_bytes(small[:8], "little"), CODEC, asbytes=True)
        n, docs = np.frombuffer(packed, "<u4", 2).tolist()
        at, got = 8, []
        for m, width in ((docs, 8), (docs, 4), (docs, 4), *((n, w) for w in widths)):
            x, at = _unplaned(packed, at, m, width)
            got.append(x)
        size = got[2].astype(np.int64)
        for column, x in zip(columns, (np.repeat(got[0].view(np.int64), size), np.repeat(got[1].view(np.int64), size), *got[3:])):
            column.append(x)
        rest.append(packed[at:])
    return [np.concatenate(c) for c in columns], rest


def _joined_up(arrays: list[np.ndarray]) -> np.ndarray:
    """Their concatenation; the list is emptied, so that no second copy stays."""
    out = np.concatenate(arrays)
    arrays.clear()
    return out


def gram_rows(parts: int):
    """Map side of the grams: rows of runs for the parts, and the runs whose gram two documents of the batch have."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            ids, twins = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "_d"))
            kept: tuple[list, ...] = ([], [], [])
            for a, b, bounds, rows in segments(at):
                text, start, count, gram = runs(data[a:b], bounds)
                own_row = rows[text]
                for column, x in zip(kept, (own_row.astype(np.int32), ((a + start - at[own_row]) << 8 | count).astype(np.uint64), gram)):
                    column.append(x)
            if not any(map(len, kept[0])):
                continue
            row, place, gram = map(_joined_up, kept)
            order = np.argsort(gram, kind="stable")
            heads, owner = _heads(gram[order]), ids[row[order]]
            shared = np.minimum.reduceat(owner, heads) < np.maximum.reduceat(owner, heads)
            known = np.zeros(len(row), bool)
            known[order] = _spread(shared, heads, len(order))
            witness, size = order[heads[shared]], np.diff(np.concatenate([heads, [len(order)]]))[shared]
            del owner, order, heads
            own = list(_by_document(ids[row[known]], twins[row[known]], np.stack([place[known].astype("<u8"), gram[known].astype("<u8")], 1)))
            place[witness] = size.astype(np.uint64) << np.uint64(8) | np.uint64(WITNESS)  # a witness tells the number of runs in place of its start
            known[witness] = False
            sent = np.flatnonzero(~known)
            columns = ((place >> np.uint64(8), 5), (place.astype(np.uint8), 1), (gram, 6))
            out = _packed(ids, twins, row, columns, part_of(gram[sent], parts), parts, kept=sent)
            yield _parted(*out, [(-1 - doc % parts, doc, twin, marks) for doc, twin, marks in own])

    return run


def _by_part(batches: Batches, settle) -> Batches:
    """What `settle` makes of the packed rows of each part (sorted by part), and what passes through."""
    part, held = None, []
    for batch in batches:
        yield _passed(batch)
        for p, packed in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist()):
            if p < 0:
                continue
            if p != part:
                if held:
                    yield from settle(held)
                part, held = p, []
            held.append(packed)
    if held:
        yield from settle(held)


def shared_grams(crowd: int):
    """Reduce side of the grams: the runs whose gram another document has, too, and crowded grams: gram as doc_id, number of
    runs as _d, an empty string."""
    def settle(held: list[bytes]) -> Batches:
        (ids, twins, start, count, gram), _ = _unpacked(held, (5, 1, 6))
        order = np.argsort(gram)
        ids, twins, start, count, gram = (x[order] for x in (ids, twins, start, count, gram))
        heads, witness = _heads(gram), count == WITNESS
        shared = (np.minimum.reduceat(ids, heads) < np.maximum.reduceat(ids, heads)) | np.logical_or.reduceat(witness, heads)
        found = np.flatnonzero(_spread(shared, heads, len(gram)) & ~witness)
        values = np.stack([(start << np.uint64(8) | count)[found].astype("<u8"), gram[found].astype("<u8")], 1)
        rows = [(doc, twin, at, None) for doc, twin, at in _by_document(ids[found], twins[found], values)]
        runs_of = np.add.reduceat(np.where(witness, start.astype(np.int64), 1), heads)
        many = np.flatnonzero(shared & (runs_of > crowd))
        rows += [(g, n, None, b"") for g, n in zip(gram[heads[many]].tolist(), runs_of[many].tolist())]
        for i in range(0, len(rows), 20_000):
            yield _marks(rows[i : i + 20_000])

    return lambda batches: _by_part(batches, settle)


def crowded_grams(grams: DataFrame, crowd: int, most: int = MOST_CROWDED) -> tuple[np.ndarray, np.ndarray]:
    """The grams with more than `crowd` runs, ascending, and their numbers of runs; `most` of them or fewer.

    If the runs of all these grams exceed crowd x most, only grams above their total / most are given: at most `most` can be.
    """
    found = grams.where("string IS NOT NULL")
    least = max(crowd, (found.agg(F.sum("_d")).first()[0] or 0) // most)
    table = found.where(F.col("_d") > least).select("doc_id", "_d").toArrow()
    gram, size = (table.column(c).to_numpy() for c in ("doc_id", "_d"))
    order = np.argsort(gram)
    return gram[order].astype(np.uint64), size[order].astype(np.int64)


def _gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes data[start:start+length] one after another."""
    ends = np.cumsum(length)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)]


def _classes(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number for each of the strings that lie one after another in data: the same for equal bytes."""
    ends = np.concatenate([[0], np.cumsum(length)])
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    return strings.dictionary_encode().indices.to_numpy().astype(np.int64)


def slices_of(gram: np.ndarray, crowds: tuple[np.ndarray, np.ndarray], parts: int, crowd: int) -> np.ndarray:
    """Over how many parts each gram is dealt."""
    known, size = crowds
    if not len(known):
        return np.ones(len(gram), np.int64)
    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
    return np.where(known[at] == gram, np.clip(-(-size[at] // max(crowd, 1)), 2, max(parts, 2)), 1)


def run_rows(parts: int, crowd: int, crowds):
    """Map side of the bytes: runs for the parts, and whole repeats of a run that a smaller document of the batch has.
    crowds: a broadcast of `crowded_grams`."""
    def block(data, at, ids, twins, marks) -> pa.RecordBatch:
        many = np.array([sum(map(len, m)) // 16 for m in marks], np.int64)
        place, gram = np.frombuffer(b"".join(x for m in marks for x in m), "<u8").reshape(-1, 2).T
        row, start, count = np.repeat(np.arange(len(marks)), many), (place >> np.uint64(8)).astype(np.int64), (place & np.uint64(255)).astype(np.int64)
        length = count + LENGTH - 1
        code = _classes(_gathered(data, at[row] + start, length), length)
        least = np.full(code.max() + 1 if len(code) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, code, ids[row])
        whole = ids[row] > least[code]
        own = _by_document(ids[row[whole]], twins[row[whole]], place[whole])
        o = np.flatnonzero(~whole)
        row, start, count, gram, length = (x[o] for x in (row, start, count, gram, length))
        slices = slices_of(gram, crowds.value, parts, crowd)
        part = (part_of(gram, parts).astype(np.int64) + (_mixed(ids[row].view(np.uint64)) % slices.astype(np.uint64)).astype(np.int64)) % parts
        out = _packed(ids, twins, row, ((start, 5), (count, 1), (gram, 6), ((slices > 1).astype(np.int64), 1)), part, parts, _gathered(data, at[row] + start, length), length)
        return _parted(*out, [(-1 - doc % parts, doc, twin, x) for doc, twin, x in own])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            ids, twins = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "_d"))
            marks = batch.column("_ats").to_pylist()
            for a, b in blocks(at, 1 << 21):
                yield block(data, at[a:b], ids[a:b], twins[a:b], marks[a:b])

    return run


class BlindTrie:
    """Orders strings of equal length; inner nodes know only the position where their strings differ."""

    def __init__(self, first: bytes, member: int):
        self.root: list = [None, first, [member]]  # leaf: None, string, members; inner node: position, children, a leaf below

    def insert(self, text: bytes, member: int) -> None:
        node = self.root
        while node[0] is not None:  # blind descent to any leaf
            node = node[1].get(text[node[0]]) or node[2]
        if node[1] == text:
            node[2].append(member)
            return
        leaf, common = node[1], 0
        differ = int.from_bytes(leaf) ^ int.from_bytes(text)
        common = len(text) - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while node[0] is not None and node[0] < common:
            above, node = node, node[1][text[node[0]]]
        own = [None, text, [member]]
        if node[0] == common:
            node[1][text[common]] = own
            return
        split = [common, {leaf[common]: node, text[common]: own}, own]
        if above is None:
            self.root = split
        else:
            above[1][text[above[0]]] = split

    def leaves(self) -> Iterator[tuple[bytes, list[int]]]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[0] is None:
                yield node[1], node[2]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]


def multikey_quicksort(word: np.ndarray, starts: np.ndarray, order: np.ndarray, new: np.ndarray, shallow: int) -> None:
    """Sorts the suffixes within each group (a True of `new` begins one) by eight-byte words to the shallow depth, in place.

    All groups take a step at once: three-way partition by the median of three words. The middle part goes on to the
    next word, and at the shallow depth it is left as a group; the outer parts go on at the same word.
    """
    heads = np.flatnonzero(new)
    size = np.diff(np.concatenate([heads, [len(order)]]))
    depth = np.zeros(len(heads), np.int64)
    while True:
        some = (size > 1) & (depth < shallow)
        heads, size, depth = heads[some], size[some], depth[some]
        if not len(heads):
            return
        first = np.cumsum(size) - size  # where each group begins among the active
        at = np.arange(size.sum()) + np.repeat(heads - first, size)
        members = order[at]
        w = word[starts[members] + np.repeat(depth, size)]
        x, y, z = w[first], w[first + size // 2], w[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z)), size)
        less, more = w < pivot, w > pivot
        same = ~(less | more)
        n_less, n_same = np.add.reduceat(less, first, dtype=np.int64), np.add.reduceat(same, first, dtype=np.int64)
        to = np.zeros(len(at), np.int64)
        for part, before in ((less, np.zeros(len(first), np.int64)), (same, n_less), (more, n_less + n_same)):
            rank = np.cumsum(part) - part
            to[part] = (rank - np.repeat(rank[first] - before - heads, size))[part]
        order[to] = members
        n_more = size - n_less - n_same
        for begin, n in ((heads + n_less, n_same), (heads + n_less + n_same, n_more)):
            new[begin[n > 0]] = True
        heads = np.concatenate([heads, heads + n_less, heads + n_less + n_same])
        size, depth = np.concatenate([n_less, n_same, n_more]), np.concatenate([depth, depth + 8, depth])


def deep_shallow(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[s:s+length], and for each in that order whether it equals the one before."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.zeros(len(data) + 8, np.uint64)
    for j in range(8):
        word = word << np.uint64(8) | padded[j : j + len(word)]
    first = (word[starts] >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(first, kind="stable")  # a radix sort: two bytes
    new = np.concatenate([[True], first[order][1:] != first[order][:-1]])
    multikey_quicksort(word, starts, order, new, shallow)
    # deep: groups that share `shallow` bytes
    heads = np.flatnonzero(new)
    size = np.diff(np.concatenate([heads, [n]]))
    same = np.zeros(n, bool)
    two = heads[size == 2]
    if len(two):
        a, b = starts[order[two]], starts[order[two + 1]]
        less, more = np.zeros(len(two), bool), np.zeros(len(two), bool)
        for depth in range(shallow, length, 8):
            shift = np.uint64(8 * max(0, depth + 8 - length))
            x, y = word[a + depth] >> shift, word[b + depth] >> shift
            less |= ~more & (x < y)
            more |= ~less & (x > y)
        same[two + 1] = ~less & ~more
        order[two[more]], order[two[more] + 1] = order[two[more] + 1], order[two[more]]
    text = data.tobytes()
    for head, many in zip(heads[size > 2].tolist(), size[size > 2].tolist()):
        members = order[head : head + many].tolist()
        at = starts[members].tolist()
        trie = BlindTrie(text[at[0] + shallow : at[0] + length], members[0])
        for m, s in zip(members[1:], at[1:]):
            trie.insert(text[s + shallow : s + length], m)
        k = head
        for _, found in trie.leaves():
            order[k : k + len(found)] = found
            same[k + 1 : k + len(found)] = True
            k += len(found)
    return order, same


def _string_least(ids: np.ndarray, code: np.ndarray, length: np.ndarray, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the distinct runs: where each one's starts begin in the other two, for each start the least document with that string,
    and the string's number."""
    n = int(code.max()) + 1
    owner, some = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    np.minimum.at(owner, code, ids)
    some[code] = np.arange(len(code))
    size = length[some]
    texts, count = _gathered(data, begins[some], size), size - LENGTH + 1
    first = np.cumsum(count) - count
    of = np.repeat(np.arange(n), count)
    starts = (np.cumsum(size) - size)[of] + np.arange(len(of)) - first[of]
    order, same = deep_shallow(texts, starts)
    heads = np.flatnonzero(~same)
    least, number = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    least[order] = _spread(np.minimum.reduceat(owner[of[order]], heads), heads, len(of))
    number[order] = np.cumsum(~same)
    return first, least, number


def repeats(batches: Batches, most: int = 1 << 21) -> Batches:
    """Reduce side of the bytes: starts of strings that a smaller document has, and strings of crowded grams with their least documents."""
    def sorted_part(ids, twins, start, count, crowded, data, begins) -> Iterator[tuple]:
        length = count + LENGTH - 1
        code = _classes(_gathered(data, begins, length), length)
        first, least, number = _string_least(ids, code, length, data, begins)
        row = np.repeat(np.arange(len(ids)), count)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        string = first[code[row]] + offset
        gone = ids[row] > least[string]
        edge = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | (row[1:] != row[:-1])]))
        last = np.flatnonzero(gone & np.concatenate([~gone[1:] | (row[1:] != row[:-1]), [True]]))
        at = ((start[row[edge]] + offset[edge]) << 8 | (last - edge + 1)).astype("<u8")
        yield from ((doc, twin, x, None) for doc, twin, x in _by_document(ids[row[edge]], twins[row[edge]], at))
        told = np.flatnonzero(crowded[row] & ~gone)
        told = told[np.unique(np.stack([number[string[told]], row[told], offset[told]]), axis=1, return_index=True)[1]]
        for k in told.tolist():
            r, o = int(row[k]), int(offset[k])
            b = int(begins[r]) + o
            yield int(ids[r]), int(twins[r]), np.array([(int(start[r]) + o) << 8 | 1], "<u8").tobytes(), data[b : b + LENGTH].tobytes()

    def settle(held: list[bytes]) -> Batches:
        (ids, twins, start, count, gram, crowded), rest = _unpacked(held, (5, 1, 6, 1))
        start, count, data = start.astype(np.int64), count.astype(np.int64), np.frombuffer(b"".join(rest), np.uint8)
        length = count + LENGTH - 1
        begins = np.cumsum(length) - length
        order = np.argsort(gram, kind="stable")
        heads, crowd = _heads(gram[order]), crowded > 0
        bounds, held_bytes = [0], np.concatenate([[0], np.cumsum(length[order])])
        for h in [*heads[1:].tolist(), len(order)]:  # whole grams, about `most` bytes at a time
            if held_bytes[h] - held_bytes[bounds[-1]] >= most or h == len(order):
                bounds.append(h)
        for a, b in zip(bounds[:-1], bounds[1:]):
            o = order[a:b]
            if len(o):
                rows = list(sorted_part(ids[o], twins[o], start[o], count[o], crowd[o], data, begins[o]))
                for i in range(0, len(rows), 20_000):
                    yield _marks(rows[i : i + 20_000])

    yield from _by_part(batches, settle)


def repeated_places(docs: DataFrame, part_bytes: int = 1 << 24, crowd: int = CROWD) -> DataFrame:
    """doc_id, _d (hash of the text), _ats (binary rows of start << 8 | number of string starts) of what repeats."""
    spark = docs.sparkSession
    text = docs.where("doc_id IS NOT NULL AND octet_length(text) >= 50").select("doc_id", "_d", "text")
    with shuffles_reaped(spark):
        total = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
        dealt = text.mapInArrow(lean(gram_rows(parts)), PARTED).repartition(parts, "part").sortWithinPartitions("part")
        grams = written(dealt.mapInArrow(lean(shared_grams(crowd)), MARKS), "grams")
        crowds = spark.sparkContext.broadcast(crowded_grams(grams, crowd))
        wanted = grams.where("string IS NULL").groupBy("doc_id", "_d").agg(F.collect_list("at").alias("_ats"))
        moved = text.join(wanted, ["doc_id", "_d"]).mapInArrow(lean(run_rows(parts, crowd, crowds)), PARTED)
        found = written(moved.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lean(repeats), MARKS), "repeats")
        told = found.where("string IS NOT NULL")
        least = told.groupBy("string").agg(F.min("doc_id").alias("least"))
        more = written(told.join(least, "string").where("doc_id > least").select("doc_id", "_d", "at"), "crowded")
    discard(grams)
    marks = found.where("string IS NULL").select("doc_id", "_d", "at").unionByName(more)
    return marks.groupBy("doc_id", "_d").agg(F.collect_list("at").alias("_ats"))


def covered(size: int, marks: list[bytes] | None) -> list[tuple[int, int]]:
    """The maximal byte ranges that the marked strings cover."""
    if not marks:
        return []
    at = np.sort(np.frombuffer(b"".join(marks), "<u8").astype(np.int64))
    start, end = at >> 8, np.minimum((at >> 8) + (at & 255) + LENGTH - 1, size)
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return list(zip(start[new].tolist(), reach[np.concatenate([new[1:], [True]])].tolist()))


def _joined(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with the text (never null) and the places that repeat, in two more columns, and their names."""
    text, twin, own, other, ats = spare(docs, "own_text", "twin", "own_id", "other_twin", "ats")
    typed = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    typed = typed.withColumns({twin: F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)), own: F.col("doc_id").cast("long")})
    places = repeated_places(typed.select(F.col(own).alias("doc_id"), F.col(twin).alias("_d"), F.col(text).alias("text")))
    places = places.select(F.col("doc_id").alias(own), F.col("_d").alias(twin), F.col("_ats").alias(ats))
    return typed.join(places, [own, twin], "left"), text, ats


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with their repeats cut out of `text` (characters cut in two go as a whole) and n_chars set anew."""
    names, kept = docs.columns, docs.schema
    joined, own_text, ats = _joined(docs)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            data, at = text_bytes(batch.column(own_text))
            texts = batch.column("text").to_pylist()
            for i, marks in enumerate(batch.column(ats).to_pylist()):
                if marks:
                    own, left, last = data[at[i] : at[i + 1]], [], 0
                    for a, b in covered(len(own), marks):
                        left.append(own[last:a].tobytes())
                        last = b
                    texts[i] = b"".join([*left, own[last:].tobytes()]).decode("utf-8", "ignore")
            fresh = {"text": texts}
            if "n_chars" in names:
                fresh["n_chars"] = [old if t is None else len(t) for t, old in zip(texts, batch.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(fresh[n], batch.schema.field(n).type) if n in fresh else batch.column(n) for n in names], names)

    return joined.select(*names, own_text, ats).mapInArrow(lean(run), kept)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    joined, own_text, ats = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def run(batches: Batches) -> Batches:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            data, at = text_bytes(batch.column(own_text))
            rows = []
            for i, marks in enumerate(batch.column(ats).to_pylist()):
                own, last, gone, digest = data[at[i] : at[i + 1]], 0, 0, hashlib.sha256()
                spans = covered(len(own), marks)
                for a, b in spans:
                    digest.update(own[last:a])
                    last, gone = b, gone + b - a
                digest.update(own[last:])
                rows.append((len(own), gone, len(spans), digest.hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select("doc_id", own_text, ats).mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_deep_shallow(spark, sf_dir) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

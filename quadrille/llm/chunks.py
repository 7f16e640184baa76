"""Token ids of many texts through the ids of their distinct chunks (words), kept between the batches of a partition."""

from __future__ import annotations

from array import array
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np


class ChunkIds:
    """Ids of every chunk seen, computed once each by `encode` (a list of chunks to all their ids and how many each has).

    Kept in flat arrays; where new chunks would make more than `most`, all is forgotten first, and a call that has more
    by itself leaves nothing behind. Callers pass texts of bounded size at a time, so memory stays bounded.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.ends = array("I"), array("q", [0])

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The ids of each text, given as its chunks."""
        found, cuts = self.flat_ids(texts)
        cuts = cuts.tolist()
        return [found[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def flat_ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin."""
        return self.flat_ids_of(list(chain.from_iterable(texts)), None, np.fromiter(map(len, texts), np.int64, len(texts)))

    def flat_ids_of(self, chunks: list[str], places: np.ndarray | None, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts of so many chunks each, one after another: `chunks`, or their distinct ones with each one's place there."""
        which, holes, new = self._known(chunks)
        if self.number and len(self.number) + len(new) > self.most:
            self.clear()
            which, holes, new = self._known(chunks)
        if new:
            flat, sizes = self.encode(new)
            self.number.update(zip(new, range(len(self.ends) - 1, len(self.ends) - 1 + len(new))))
            self.ends.frombytes((len(self.flat) + np.cumsum(sizes, dtype=np.int64)).tobytes())
            self.flat.frombytes(flat.astype(np.uint32).tobytes())
            which[holes] = np.fromiter(map(self.number.__getitem__, [chunks[i] for i in holes.tolist()]), np.int64, len(holes))
        which = which if places is None else which[places]
        flat, ends = np.frombuffer(self.flat, np.uint32) if self.flat else np.zeros(0, np.uint32), np.frombuffer(self.ends, np.int64)
        start, size = ends[which], ends[which + 1] - ends[which]
        last = np.concatenate([[0], np.cumsum(size)])
        found = flat[np.arange(last[-1]) + np.repeat(start - last[:-1], size)]
        cuts = last[np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])]
        del flat, ends, start  # views keep the arrays from growing
        if len(self.number) > self.most:
            self.clear()
        return found, cuts

    def _known(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The number of each chunk or -1, the places of those, and the new chunks."""
        which = np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))
        holes = np.flatnonzero(which < 0)
        return which, holes, list(dict.fromkeys([chunks[i] for i in holes.tolist()]))

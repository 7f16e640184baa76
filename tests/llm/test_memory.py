"""Workers hold no more than a few times their batch."""

import random
import string
import tracemalloc

import numpy as np
import pyarrow as pa

from quadrille.llm import near_copies, suffix_dedup


def test_runs_of_a_batch_stay_small():
    rng = random.Random(3)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=600)) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array([0] * 4000, pa.int64()), pa.array(texts)], ["doc_id", "_d", "text"])
    size = sum(map(len, texts))
    suffix_dedup.runs(np.zeros(100, np.uint8), np.array([0, 100]))  # its tables are made once
    tracemalloc.start()
    sent = sum(out.nbytes for out in suffix_dedup.gram_rows(16)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent > size / 4 and peak < 8 * size, peak / size


def test_sections_of_a_batch_stay_small():
    rng = random.Random(4)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array([0] * 2000, pa.int64()), pa.array(texts)], ["doc_id", "text_key", "text"])
    tracemalloc.start()
    rows = sum(len(out) for out in near_copies._marked(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2000 and peak < 32 << 20, peak

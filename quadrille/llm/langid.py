"""Language ID by a blended-spectrum string kernel.

Two texts are as alike as the n-grams (of 1 to 4 bytes, hashed) that both have; presence counts, not frequency, and
the kernel is normalised. Landmark texts give a Nyström map, and one kernel ridge regression per language (one
versus the rest) is solved on it. Because the kernel is linear in the presence vectors, landmarks and regression
weights multiply into one matrix, and a batch of texts is scored by one product of its presence matrix with it.

A text is read in blocks of `BLOCK` bytes, each with presences of its own, for in a very long text every n-gram
would be present; the block scores are averaged by length. All blocks of the whole text count.

The fit is bounded: about `per_language` documents of each language, those whose id and text hash least, and of each
`blocks_each` blocks at most, spread over the whole text; `landmarks` of a language's blocks become landmarks. Which
languages there are is counted over all rows, however long their texts. Rows of one id and text count once.

The score is the logistic value of the best one-versus-rest result, so it doesn't depend on how many languages there are.

Edge cases: `und` with score 0 where the text is null or has no letter, or there is nothing to learn from; a null
doc_id is not held out and never learned from; an empty table gives an empty result; ties go to the language that
sorts first; repeated rows each come out; columns but doc_id, text and lang (to learn) are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, id_hash_mod, lean, text_bytes

WIDTHS, BUCKETS, BLOCK = (1, 2, 3, 4), 1 << 15, 4096
TEMPERATURE = 4.0


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the two-byte Latin-1 capitals."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        low[capital] += 32
    return low


def block_bounds(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the blocks that the rows are read in; an empty row has one empty block."""
    size = np.diff(at)
    many = np.maximum(1, -(-size // BLOCK))
    row = np.repeat(np.arange(len(size)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = at[row] + k * BLOCK
    return start, np.minimum(start + BLOCK, at[row + 1]), row


def presence(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Presence matrix (0 or 1) of the n-grams of the blocks data[start:end]."""
    size = ends - starts
    row = np.repeat(np.arange(len(starts)), size)
    text = _folded(data[np.arange(len(row)) + np.repeat(starts - (np.cumsum(size) - size), size)]).astype(np.uint32)
    out = np.zeros(len(starts) * BUCKETS, np.float32)
    code = np.zeros(len(text), np.uint32)
    for width in range(1, max(WIDTHS) + 1):
        end = len(text) - width + 1
        if end <= 0:
            break
        code = (code[:end] << np.uint32(8)) | text[width - 1 :]
        if width in WIDTHS:
            inside = row[:end] == row[width - 1 :]
            bucket = ((code ^ np.uint32(width * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(17)
            out[(row[:end] * BUCKETS + bucket)[inside]] = 1
    return out.reshape(len(starts), BUCKETS)


def fit(texts: list[bytes], langs: list[str], landmarks: int = 96, ridge: float = 1e-3, seed: int = 3) -> dict:
    """Kernel ridge regression for each language on Nyström landmarks, folded into one weight matrix."""
    names = sorted(set(langs))
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, ends, row = block_bounds(at)
    y = np.array([names.index(x) for x in langs])[row]
    rng = np.random.default_rng(seed)
    chosen = np.concatenate([rng.permutation(np.flatnonzero(y == c))[:landmarks] for c in range(len(names))])
    unit = lambda p: p / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))
    marks = unit(presence(data, starts[chosen], ends[chosen]))
    k = np.concatenate([unit(presence(data, starts[i : i + 64], ends[i : i + 64])) @ marks.T for i in range(0, len(starts), 64)]).astype(np.float64)
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1 / np.bincount(y, minlength=len(names))[y]  # languages count alike
    weight *= len(y) / weight.sum()
    kmm = (marks @ marks.T).astype(np.float64)
    alpha = np.linalg.solve(k.T @ (k * weight[:, None]) + ridge * len(y) * kmm + 1e-6 * len(y) * np.eye(len(chosen)), k.T @ (target * weight[:, None]))
    return {"names": names, "w": (marks.T.astype(np.float64) @ alpha).astype(np.float32)}


def predict(model: dict, data: np.ndarray, at: np.ndarray, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language and its score (0 to 1) for each row."""
    starts, ends, row = block_bounds(at)
    total, weight = np.zeros((len(at) - 1, len(model["names"]))), np.zeros(len(at) - 1)
    for i in range(0, len(starts), batch):
        p = presence(data, starts[i : i + batch], ends[i : i + batch])
        f = (p @ model["w"]) / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))
        size = np.maximum(ends[i : i + batch] - starts[i : i + batch], 1)
        np.add.at(total, row[i : i + batch], f * size[:, None])
        np.add.at(weight, row[i : i + batch], size)
    f = total / weight[:, None]
    return f.argmax(1), 1 / (1 + np.exp(-TEMPERATURE * f.max(1)))


def _some_blocks(batches: Batches, most: int) -> Batches:
    for batch in batches:
        langs, out = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            data = text.encode()
            n = max(1, -(-len(data) // BLOCK))
            for k in np.unique(np.linspace(0, n - 1, min(n, most)).astype(int)).tolist():
                langs.append(lang)
                out.append(data[k * BLOCK : (k + 1) * BLOCK])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "block"])


def train(docs: DataFrame, per_language: int = 400, blocks_each: int = 4) -> dict:
    """The model, learned from text and lang of the learning folds (id hash not 1 mod 3); {} if there are none."""
    learn = docs.where(id_hash_mod("doc_id", 3) != 1).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return {}
    learn = learn.select("lang", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("mix"))
    few = F.lit(False)
    for lang, n in counts.items():
        few = few | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("mix"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, per_language / n))))
    picked = learn.where(few).groupBy("lang", "mix").agg(F.first("text").alias("text"))
    blocks = picked.mapInArrow(lean(lambda batches: _some_blocks(batches, blocks_each)), "lang string, block binary")
    rows = sorted((r.lang, bytes(r.block)) for r in blocks.collect())  # bounded by the sample's parameters
    return fit([b for _, b in rows], [x for x, _ in rows])


def _predicted(model, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, at = text_bytes(batch.column("text"))
    letters = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not model or not len(batch):
        return np.zeros(len(batch), np.int64), np.zeros(len(batch)), np.zeros(len(batch), bool)
    which, found = predict(model, data, at)
    return which, np.where(letters, found, 0.0), letters


def languages(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights a language

    def run(batches: Batches) -> Batches:
        for batch in batches:
            which, found, known = _predicted(shared.value, batch)
            names = [shared.value["names"][k] if ok else "und" for k, ok in zip(which, known)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(found, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, model: dict, least: float = 0.3) -> DataFrame:
    """The rows whose language is known with a score of `least` or more, with their columns; `und` goes."""
    shared, kept = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Batches) -> Batches:
        for batch in batches:
            _, found, known = _predicted(shared.value, batch)
            yield batch.filter(pa.array(known & (found >= least)))

    return docs.mapInArrow(lean(run), kept)


def op4_string_kernel(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return languages(docs, train(docs)).select("doc_id", F.coalesce(id_hash_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")

"""Quality classifier learned from positives and unlabelled text.

A small network over byte-trigram, character-class and repetition features minimises the non-negative unbiased risk
    prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])
(l: logistic loss); where the second part falls below zero its gradient is turned round, which keeps the flexible
model from memorising the positives. The class prior is estimated from positives and unlabelled text alone (labels of
bad text are never read): a first network is fitted to half of the sample, and on the other half the least ratio of
the unlabelled to the positive share above a score bounds the prior, allowing for chance (`estimated_prior`).

The fit uses bounded samples: about `positives` trusted and `unlabelled` web documents, those whose id and text hash
least; rows of one id and text count once. Everything else reads all rows. Scores come from whole texts: features are
counts over all bytes.

Edge cases: a null text counts as empty and gets the score of an empty text; a null doc_id is not held out and is
never learned from; a document is trusted if any of its label rows is 1; without positives to learn
from, every score is 1. Repeated rows each come out; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, blocks, id_hash_mod, lean, text_bytes

TRIGRAMS, GRAMS4 = 512, 4096
MARKS = b"!?.,;:|*#$%&\n/@<>=_-(){}[]\"'~"


def _classes() -> np.ndarray:
    """Byte to class: upper case, lower case, digit, white space, beyond ASCII, control, then each of MARKS."""
    table = np.full(256, 5, np.int64)
    for k, span in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, 9, 11, 12, 13), range(128, 256))):
        table[list(span)] = k
    table[list(MARKS)] = np.arange(6, 6 + len(MARKS))
    return table


CLASSES, N_CLASSES = _classes(), 6 + len(MARKS)
N_FEATURES = TRIGRAMS + N_CLASSES + 11


def repeats(text: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each row the shares of words that equal the word one, two and three before."""
    letter = (text != 32) & (text != 10)
    edge = np.concatenate([[True], (row[1:] != row[:-1])]) if len(row) else np.zeros(0, bool)
    start = np.flatnonzero(letter & (edge | ~np.concatenate([[False], letter[:-1]])))
    out = np.zeros((rows, 3), np.float32)
    if len(start):
        place = np.arange(len(text)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(text)]])))
        mixed = np.where(letter, (text + 1) * ((place * 0x9E3779B97F4A7 >> 7) | 1), 0)
        word, home = np.add.reduceat(mixed, start), row[start]
        count = np.maximum(np.bincount(home, minlength=rows), 1)
        for k in (1, 2, 3):
            same = (word[k:] == word[:-k]) & (home[k:] == home[:-k])
            out[:, k - 1] = np.bincount(home[k:], weights=same, minlength=rows) / count
    return out


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of features for each text data[at[i]:at[i+1]]."""
    out, n = np.zeros((len(at) - 1, N_FEATURES), np.float32), np.diff(at)
    for first, last in ((a, min(b, c + 128)) for a0, b in blocks(at, 1 << 20) for c in range(a0, b, 128) for a in [c]):
        text, size, rows = data[at[first] : at[last]].astype(np.int64), n[first:last], last - first
        row = np.repeat(np.arange(rows), size)
        least = np.maximum(size, 1)
        kinds = np.bincount(row * N_CLASSES + CLASSES[text], minlength=rows * N_CLASSES).reshape(rows, -1) / least[:, None]
        here = out[first:last]
        here[:, TRIGRAMS : TRIGRAMS + N_CLASSES] = np.sqrt(kinds)
        for width, room in ((3, TRIGRAMS), (4, GRAMS4)):
            if len(text) < width:
                continue
            end = len(text) - width + 1
            code = np.zeros(end, np.int64)
            for j in range(width):
                code = code * 257 + text[j : end + j]
            code = (code * 0x9E3779B1 >> 15) % room
            inside = row[:end] == row[width - 1 :]
            counts = np.bincount((row[:end] * room + code)[inside], minlength=rows * room).reshape(rows, room)
            share = counts / np.maximum(size - width + 1, 1)[:, None]
            if width == 3:
                here[:, :TRIGRAMS] = np.sqrt(share)
            else:
                here[:, -8] = np.sqrt((share**2).sum(1))
                here[:, -7] = share.max(1)
                here[:, -6] = (counts > 0).sum(1) / np.minimum(np.maximum(size - 3, 1), room)
                expected = room * (1 - np.exp(-np.maximum(size, 1) / room))
                here[:, -5] = (counts > 0).sum(1) / expected
        here[:, -11:-8] = repeats(text, row, rows)
        here[:, -4] = np.log1p(size) / 10
        here[:, -3] = size < 40
        spaces = np.bincount(row, weights=text == 32, minlength=rows) + 1
        here[:, -2] = np.log1p(size / spaces)
        here[:, -1] = size == 0
    return out


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, hidden: int = 32, epochs: int = 40, batch: int = 512, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> dict:
    """Weights of the network that minimises the non-negative risk, by Adam over mini-batches."""
    rng = np.random.default_rng(seed)
    mean, scale = unl.mean(0), unl.std(0) + 0.05 * (unl.std(0).mean() + 1e-6) + 1e-6
    pos, unl = (pos - mean) / scale, (unl - mean) / scale
    np.clip(pos, -8, 8, out=pos), np.clip(unl, -8, 8, out=unl)
    w = [rng.normal(0, (2 / pos.shape[1]) ** 0.5, (pos.shape[1], hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, (1 / hidden) ** 0.5, hidden).astype(np.float32), np.zeros(1, np.float32)]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(epochs):
        order_p, order_u = rng.permutation(len(pos)), rng.permutation(len(unl))
        steps = max(1, len(unl) // batch)
        for p, u in zip(np.array_split(order_p, steps), np.array_split(order_u, steps)):
            if not len(p) or not len(u):
                continue
            x = np.concatenate([pos[p], unl[u]])
            h = np.maximum(x @ w[0] + w[1], 0)
            f = h @ w[2] + w[3]
            fp, fu = f[: len(p)], f[len(p) :]
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            up, uu = sigma(fp), sigma(fu)
            if negative >= 0:
                gp, gu = (prior * (up - 1) - prior * up) / len(p), uu / len(u)
            else:  # against the overfitted part only
                gp, gu = prior * up / len(p), -uu / len(u)
            g = np.concatenate([gp, gu]).astype(np.float32)
            gh = np.outer(g, w[2]) * (h > 0)
            grads = [x.T @ gh + decay * w[0], gh.sum(0), h.T @ g + decay * w[2], np.array([g.sum()], np.float32)]
            t += 1
            for k, d in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "scale": scale, "w": w}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    x = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    w = model["w"]
    return 1 / (1 + np.exp(-np.clip((np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]).astype(np.float64), -30, 30)))


def _featured(batches: Batches) -> Batches:
    for batch in batches:
        x = features(*text_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])


def _gather(docs: DataFrame, expected: int, of: int) -> np.ndarray:
    """Features of about `expected` of `of` rows (doc_id, text), those whose id and text hash least, each id and text once."""
    mix = F.xxhash64("doc_id", "text", F.lit("sample"))
    threshold = min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, expected / max(1, of))))
    rows = docs.select("text", mix.alias("mix")).where(F.col("mix") <= F.lit(threshold)).groupBy("mix").agg(F.first("text").alias("text"))
    found = rows.select("text").mapInArrow(lean(_featured), "x binary").toPandas()["x"]
    return np.frombuffer(b"".join(sorted(found)), np.float32).reshape(-1, N_FEATURES).copy()


def estimated_prior(pos: np.ndarray, unl: np.ndarray, risk: float = 0.1, seed: int = 7) -> float:
    """The share of positives among the unlabelled.

    Above any score lie at least prior x (share of positives there) of the unlabelled, so the ratio of the two shares
    is never below the prior, and near it where few negatives score. The score is taken where that ratio with its
    margin of chance (by Hoeffding's bound at `risk`) is least.
    """
    rng = np.random.default_rng(seed)
    (p, p2), (u, u2) = (np.array_split(rng.permutation(len(x)), 2) for x in (pos, unl))
    if not min(map(len, (p, p2, u, u2))):
        return 0.5
    model = fit(pos[p], unl[u], 0.5, epochs=20)
    sp, su = np.sort(score(model, pos[p2])), np.sort(score(model, unl[u2]))
    above_p, above_u = 1 - np.arange(len(sp)) / len(sp), 1 - np.searchsorted(su, sp) / len(su)
    margin = (np.log(4 / risk) / (2 * len(sp))) ** 0.5 + (np.log(4 / risk) / (2 * len(su))) ** 0.5
    best = ((above_u + margin) / above_p).argmin()
    return float(above_u[best] / above_p[best])


def train(docs: DataFrame, labels: DataFrame, positives: int = 5000, unlabelled: int = 10000) -> dict:
    """The model: bounded samples of trusted positives and of web text, both from the learning folds (id hash not 0 mod 5)."""
    learn = id_hash_mod("doc_id", 5) != 0
    good_ids = labels.where(learn).where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    text = docs.where(learn).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    trusted = text.join(good_ids, "doc_id", "left_semi")
    pos, unl = _gather(trusted, positives, trusted.count()), _gather(text, unlabelled, text.count())
    if not len(pos) or not len(unl):
        return {"constant": 1.0}
    return fit(pos, unl, min(max(estimated_prior(pos, unl), 0.01), 0.99))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a network of fixed size

    def run(batches: Batches) -> Batches:
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            if "constant" in shared.value:
                found = np.full(len(batch), shared.value["constant"])
            else:
                found = np.concatenate([np.zeros(0)] + [score(shared.value, features(data, at[a : b + 1])) for a, b in blocks(at, 4 << 20)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, score double")


def good(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score `threshold` or more, with their columns."""
    shared, kept = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Batches) -> Batches:
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            if "constant" in shared.value:
                found = np.full(len(batch), shared.value["constant"])
            else:
                found = np.concatenate([np.zeros(0)] + [score(shared.value, features(data, at[a : b + 1])) for a, b in blocks(at, 4 << 20)])
            yield batch.filter(pa.array(found >= threshold))

    return docs.mapInArrow(lean(run), kept)


def op1_pu_quality(spark, sf_dir) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = scored(docs, train(docs, labels))
    return found.select("doc_id", F.coalesce(id_hash_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

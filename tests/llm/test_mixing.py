"""Vector codes, source mixing and resampling against SQL, brute force and plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quadrille.llm import codes, mixing, queries, resampling, running
from pyspark.sql import functions as F

from ..compare import duck, same
from .test_queries import QUERIES, edges, nothing  # noqa: F401

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", ["op11_kd_codes", "op12_fair_queueing", "op13_suffix_resampling"])
def test_equal_to_sql(spark, sf_dir, name):
    assert same(QUERIES[name](spark, sf_dir), duck(sf_dir), SQL[name]) is None


@pytest.mark.parametrize("name", ["op12_fair_queueing", "op13_suffix_resampling"])
def test_edges_equal_to_sql(spark, edges, name):  # noqa: F811
    keep = lambda df: df.where("doc_id IS NOT NULL AND doc_id NOT IN (8)") if name[:4] == "op12" else df  # noqa: E731  8 names two texts: their order is the operator's own
    own = duck(edges)
    assert same(keep(QUERIES[name](spark, edges)), own, f"SELECT * FROM ({SQL[name]}) WHERE doc_id IS NOT NULL AND doc_id NOT IN (8)" if name[:4] == "op12" else SQL[name]) is None


@pytest.mark.parametrize("seed", range(6))
def test_tree_is_brute_force(seed):
    rng = np.random.default_rng(seed)
    width = (1, 2, 4, 9, 3, 0)[seed]
    entries = rng.integers(-3 if seed % 2 else -400, 4 if seed % 2 else 400, (64 - seed, width))
    entries[10:20] = entries[30:40]  # equal entries: the lower index has to survive
    x = np.concatenate([rng.integers(-500, 500, (3000, width)), rng.integers(-4, 5, (3000, width)), entries])
    away = ((x[:, None] - entries[None]) ** 2).sum(2)
    which, best = codes.Tree.of(entries).nearest(x)
    assert (which == away.argmin(1)).all() and (best == away.min(1)).all()


def plain_codes(vectors, parts=16, entries=64, rounds=2):
    known = [(i, [math.floor(256 * float(np.float32(v))) for v in x], y) for i, x, y in vectors if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    width = len(known[0][1])
    cuts = [p * width // parts for p in range(parts + 1)]
    ids = {}
    for i, x, _ in sorted((k for k in known if k[0] is not None), key=lambda k: (k[0], k[1])):
        ids.setdefault(i, x)
    books = [[x[a:b] for _, x in sorted(ids.items())[:entries]] for a, b in zip(cuts, cuts[1:])]
    near = lambda part, book: min((sum((p - q) ** 2 for p, q in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            met = {}
            for _, x, _ in known:
                met.setdefault(near(x[a:b], books[p])[1], []).append(x[a:b])
            books[p] = [[sum(z) // len(met[k]) for z in zip(*met[k])] if k in met else e for k, e in enumerate(books[p])]
    found = [(i, [near(x[a:b], books[p]) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))], y) for i, x, y in known]
    sums = Counter()
    for _, own, y in found:
        sums[y] += sum(d for d, _ in own)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in own), sum(d for d, _ in own), sums[y], digest) for i, own, y in found), key=repr)


@pytest.mark.parametrize("width", [16, 32, 7])
def test_codes_of_odd_tables(spark, tmp_path, width):
    rng = np.random.default_rng(width)
    vectors = [(int(i), rng.normal(size=width).round(1).tolist(), None if i % 5 == 0 else int(i % 2)) for i in rng.permutation(150)]
    vectors += [(3, vectors[0][1], 1), (3, [9.0] * width, 0), (None, [0.5] * width, None), (200, None, 1), (201, [float("nan")] * width, 1), (202, [None] + [1.0] * (width - 1), 0), vectors[5]]
    pq.write_table(pa.table({"vec_id": pa.array([v[0] for v in vectors], pa.int64()), "embedding": pa.array([v[1] for v in vectors], pa.list_(pa.float32())), "label": pa.array([v[2] for v in vectors], pa.int32()), "code": pa.array(["x"] * len(vectors)), "of": pa.array([1] * len(vectors))}), tmp_path / "embeddings.parquet")
    got = sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in QUERIES["op11_kd_codes"](spark, str(tmp_path)).collect()), key=repr)
    assert got == plain_codes(vectors)


def test_codes_leave_out_other_widths(spark):
    df = spark.createDataFrame([(1, [1.0] * 16), (2, [2.0] * 16), (3, [1.0] * 4), (4, []), (5, [1e30] * 16)], "vec_id long, embedding array<float>")
    books = codes.fitted(df, rounds=1)
    assert [r.vec_id for r in codes.coded(df, books, ["vec_id"]).orderBy("vec_id").collect()] == [1, 2, 5]
    assert books.books[0].tolist() == [[256], [512], [codes.LARGEST]]


def test_running(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 9, 5000).tolist()
    keys = rng.integers(0, 40, 5000).tolist()
    keys[:2000] = [7] * 2000
    df = spark.createDataFrame(list(zip(keys, values)), "k long, v long").repartition(7)
    out, total = running.running(df, [F.col("k")], "v", "upto", "test")
    rows = sorted((r.k, r.upto, r.v) for r in out.collect())
    assert total == sum(values)
    upto = 0
    for (k, before, v), want in zip(sorted(rows, key=lambda r: (r[1], r[2] > 0)), sorted(keys)):
        assert (k, before) == (want, upto)
        upto += v


def mix(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    queue, budget = mixing.queued(df, **options)
    return df, queue.collect(), budget, mixing.mixed(df, **options).orderBy("at").collect()


def test_mix_fills_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ("big", "mid", "small", None)[int(rng.choice(4, p=(0.6, 0.3, 0.08, 0.02)))], "w " * int(rng.integers(0, 60))) for i in range(800)]
    rows += [(900, "one", "long " * 3000), (901, "none", ""), (902, "none", None)]
    _, queue, budget, found = mix(spark, rows)
    at = 0
    for r in found:
        assert r["at"] == at and r.words > 0
        at += r.words
    assert at == budget == sum(r.size for r in queue) * 3 // 2
    taken = Counter()
    for r in found:
        taken[r.source] += r.words
    for r in queue:
        assert abs(taken[r.source] - r.target) <= len({q.source for q in queue}) and r.target <= 2 * r.source_size
    # the words of a document are taken twice at most, and each once in a copy
    spans = Counter()
    for r in found:
        for w in range(r.first, r["first"] + r.words):
            spans[r.doc_id, r.copy, w] += 1
    assert set(spans.values()) == {1} and {c for _, c, _ in spans} <= {0, 1}
    # sources advance together: half the mix holds about half of each
    half = Counter()
    for r in found:
        if r["at"] < budget / 2:
            half[r.source] += r.words
    assert all(abs(half[s] - taken[s] / 2) <= 3000 if s == "one" else abs(half[s] - taken[s] / 2) <= 150 for s in taken)


def test_mix_targets_by_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 1), (None, 500)], "source string, source_size long")
    found, budget = mixing.targets(sizes, (5, 2, 1))
    got = {r.source: r.target for r in found.collect()}
    # weights 5, 2, 1, 5, 2 of 3766 words: a and d stop at 20 and 2; then b 1497.6, c 748.8, null 1000 (capped), and again
    level = (2511 * 3 / 2 - 20 - 2 - 1000) / 3
    want = {"a": 20, "d": 2, None: 1000, "b": min(2000, 2 * level), "c": level}
    assert budget == 2511 * 3 // 2 and all(abs(got[k] - w) < 1e-9 for k, w in want.items())


def test_mix_reruns_agree(spark, sf_dir):
    runs = [sorted(map(tuple, QUERIES["op12_fair_queueing"](spark, sf_dir).collect())) for _ in range(2)]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_runs_are_all_features(longest):
    rng = np.random.default_rng(longest)
    texts = [" ".join(rng.choice(["a", "B", "ba", "ä", "9", "x-y"], rng.integers(0, 40))).encode() for _ in range(60)] + [b"", "Ünï 日本 x".encode(), b"a a a a a a a"]
    bucket, of, sizes = resampling.buckets(texts, longest, 997)
    for i, text in enumerate(texts):
        low = text.decode().translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        grams = [" ".join(words[j : j + k]) for k in range(1, longest + 1) for j in range(len(words) - k + 1)]
        assert Counter(bucket[of == i].tolist()) == Counter(zlib.crc32(g.encode()) % 997 for g in grams) and sizes[i] == len(words)


def test_suffix_array():
    rng = np.random.default_rng(0)
    ids, home = rng.integers(0, 3, 400), np.sort(rng.integers(0, 12, 400))
    for depth in (1, 2, 3, 4, 7):
        order, common = resampling.suffix_array(ids, home, depth)
        ends = np.searchsorted(home, home, "right")
        suffix = [tuple(ids[i : min(i + depth, e)]) for i, e in enumerate(ends)]
        assert [suffix[i] for i in order] == sorted(suffix)
        for a, b, n in zip(order[:-1], order[1:], common[1:]):
            assert n == next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b])) if x != y), min(len(suffix[a]), len(suffix[b])))


def test_longer_features_draw_the_target(spark):
    docs = spark.createDataFrame([(i, ("red green blue " if i % 2 else "blue green red ") * 10) for i in range(100)] + [(200, "short one")], "doc_id long, text string")
    target = spark.createDataFrame([("red green blue " * 50,)], "text string")
    found = resampling.resampled(docs, target, longest=2, percent=30).collect()
    drawn = [r.doc_id for r in found if r["rank"] is not None]
    assert len(drawn) == 30 and all(i % 2 for i in drawn) and {r.n_features for r in found} == {59, 3}

"""The pipeline's near-duplicate stage against all pairs by brute force, on planted edits."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def least_of_components(docs):
    """Positions of the documents that stay."""
    distinct, root = [shingle_set(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(docs)), 2):
        x, y = distinct[a], distinct[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            root[find(a)] = find(b)
    least = {}
    for k, (d, t) in enumerate(docs):
        if d is not None:
            least[find(k)] = min(least.get(find(k), (d, t)), (d, t))
    return [*least.values(), *((d, t) for d, t in docs if d is None)]


def planted():
    rng = np.random.default_rng(5)
    text = lambda n: [f"w{i}" for i in rng.integers(20_000, size=n)]
    docs = []

    def edited(words, n):
        words = list(words)
        for i in rng.choice(len(words), n, replace=False):
            words[i] = f"edit{rng.integers(10**9)}"
        return words

    for n, edits in [(100, 1), (100, 2), (250, 1), (250, 4), (250, 12), (1000, 10), (1000, 40)] * 4:
        base = text(n)
        docs += [base, edited(base, edits), edited(base, edits)]
    base = text(300)
    docs += [edited(base, int(rng.integers(1, 6))) for _ in range(120)]  # one large group
    passage = text(60)
    docs += [passage + text(40) for _ in range(100)]  # a shared passage alone is no copy
    chain = text(200)
    for _ in range(6):
        docs.append(chain)
        chain = edited(chain, 3)
    return [" ".join(d) for d in docs]


@pytest.mark.parametrize("most_others", [64, 2])
def test_planted_edits(spark, sf_dir, monkeypatch, most_others):
    from quadrille.llm import near_copies

    monkeypatch.setattr(near_copies.near_copies, "__defaults__", (most_others,))
    docs = [(k, t) for k, t in enumerate(planted())]
    docs += [(3, "quite another text under an id that is taken"), (900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "TWO  words"), (905, docs[0][1]), (0, docs[0][1]), (None, docs[0][1]), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, df, sf_dir)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(least_of_components([(d, t) for d, t in docs]), key=key)
    assert len(docs) - kept.count() > 150


def test_crowded_passage_loses_nothing(spark, monkeypatch):
    """5,400 texts around one passage of 150 words, 200 of them edited to just above a similarity of 0.8."""
    from quadrille.llm import near_copies

    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(150)]
    docs = [passage + [f"w{k}x{i}" for i in range(60)] for k in range(5200)]
    for k in range(200):  # 206 shingles; e edits far apart change 5 e of them: 4 keep 186 of 226 (0.823)
        words = list(docs[k])
        for i in 3 + 10 * rng.choice(20, 4, replace=False):
            words[i] = f"e{k}y{i}"
        docs.append(words)
    texts = [" ".join(d) for d in docs]
    holders, distinct = {}, [shingle_set(t) for t in texts]
    for k, own in enumerate(distinct):
        for s in own:
            holders.setdefault(s, []).append(k)
    links = set()
    for own in holders.values():  # pairs that share nothing but what more than 100 texts hold have 146 of 266 shingles in common at most
        if len(own) <= 100:
            links |= {(a, b) for a, b in combinations(own, 2) if 5 * len(distinct[a] & distinct[b]) >= 4 * len(distinct[a] | distinct[b])}
    assert links >= {(k, 5200 + k) for k in range(200)}
    monkeypatch.setattr(near_copies.near_copies, "__defaults__", (64,))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {r.doc_id: r.root for r in near_copies.near_copies(df).collect()}
    assert all(roots[a] == roots[b] for a, b in links)
    assert len(set(roots.values())) == len(texts) - len(links)


def test_shared_positions_are_tallied_over_postings(spark):
    """A grouped count of the postings that a pair meets in decides: 5 from 64 shingles on, 1 below."""
    from quadrille.llm import near_copies

    sets = {1: (100, range(8)), 2: (100, range(5)), 3: (90, range(4)), 4: (20, [7]), 5: (100, [50])}
    rows = [(s, n, s, 0, k, 6, 9) for s, (n, keys) in sets.items() for k in keys]
    odd = F.struct(*[F.lit(0).cast("long").alias(f"w{i}") for i in range(near_copies.ODD_WORDS)])
    index = spark.createDataFrame(rows, "set long, n int, root long, main long, key long, others long, all long").withColumn("odd", odd)
    pairs = lambda df: sorted(map(tuple, near_copies._tallied(df).collect()))
    assert pairs(near_copies._across(index)) == [(2, 1)]  # 3 shares four positions with 1 and 2; sizes rule 4 out
    met = spark.createDataFrame([(2, 1), (3, 1), (3, 2), (4, 1), (5, 1)], "a long, b long")
    assert pairs(near_copies._meetings(met, index)) == [(2, 1), (4, 1)]
    stars = near_copies._stars(index.where("key >= 4"), F.lit(0), 1)  # 1 and 2 meet in one posting here, but share five
    assert pairs(near_copies._meetings(stars, index)) == [(2, 1)]


def test_odd_sketches_never_differ_in_more_bits_than_the_sets():
    from quadrille.llm import near_copies

    rng = np.random.default_rng(6)
    for n in (0, 1, 40, 400, 4000):
        both = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        ones, others = (rng.integers(0, 1 << 64, k, dtype=np.uint64) for k in (n // 8, n // 6))
        found, at = np.concatenate([both, ones, both, others]), np.cumsum([0, n + len(ones), n + len(others)])
        a, b = near_copies.odd_sketches(found, at)
        differing = sum(int(x).bit_count() for x in (a ^ b).view(np.uint64))
        assert differing <= len(ones) + len(others) and (differing - len(ones) - len(others)) % 2 == 0
        if n in (40, 400):
            assert differing > 0.7 * (len(ones) + len(others))


def test_empty(spark, sf_dir):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, df, sf_dir).count() == 0

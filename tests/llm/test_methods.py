"""The methods inside the operators: what the queries' digests don't show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import ann, chat, langid, near_copies, packing, quality, simhash, sketch, suffix_dedup
from quadrille.llm.common import shared_folder, spare


def test_quicksort_sorts_suffixes():
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 99, 3000).astype(np.uint8)) + b"same passage of more than fifty bytes, here and there and then" * 3
    starts = rng.permutation(len(text) - 50)
    order, same = suffix_dedup.deep_shallow(np.frombuffer(text, np.uint8), starts)
    got = [text[s : s + 50] for s in starts[order]]
    assert got == sorted(got)
    assert same.tolist() == [k > 0 and got[k] == got[k - 1] for k in range(len(got))]


@pytest.mark.parametrize("crowd, part_bytes", [(0, 1 << 24), (2, 3000)])
def test_crowded_grams_change_nothing(spark, sf_dir, crowd, part_bytes):
    line = "a line of well over fifty bytes that very many of the documents have in common"
    rng = np.random.default_rng(1)
    rows = [(i, f"{rng.integers(10**12)} {line} {rng.integers(10**12)}") for i in range(300)] + [(i, r.text) for i, r in enumerate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect(), 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    typed = docs.withColumn("_d", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)))
    places = lambda **how: {r.doc_id: suffix_dedup.covered(1 << 20, r["_ats"]) for r in suffix_dedup.repeated_places(typed, **how).collect()}
    plain = places(crowd=10**9)
    assert places(crowd=crowd, part_bytes=part_bytes) == plain and len(plain) >= 299


@pytest.mark.parametrize("share", [0.25, 0.9])
def test_hot_gram_stays_flat(spark, share):
    """Four times the documents in four times the parts: the hottest part gets no more runs of a common line, in whatever batches
    they come. The line lies in few texts of each batch, so that only counts of the whole table tell that it is crowded."""
    line, hottest, crowd = "a line of well over fifty bytes that very many of the documents have in common", [], 32
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        for n, parts in ((1000, 16), (4000, 64)):
            rng = np.random.default_rng(n)
            rows = [(i, f"{rng.integers(10**18)} {line if rng.random() < share else 'x'} {rng.integers(10**18)} {rng.integers(10**18)}") for i in range(n)]
            text = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("_d", F.lit(0).cast("long")).select("doc_id", "_d", "text").cache()
            dealt = text.mapInArrow(suffix_dedup.gram_rows(parts), suffix_dedup.PARTED).repartition(parts, "part").sortWithinPartitions("part")
            grams = dealt.mapInArrow(suffix_dedup.shared_grams(crowd), suffix_dedup.MARKS).cache()
            gram, size = suffix_dedup.crowded_grams(grams, crowd)
            runs = grams.where("string IS NULL").groupBy("doc_id", "_d").agg(F.collect_list("at").alias("_ats"))
            marks = [m for r in runs.collect() for m in r["_ats"]]
            all_grams, counts = np.unique(np.frombuffer(b"".join(marks), "<u8").reshape(-1, 2)[:, 1], return_counts=True)
            assert dict(zip(gram.tolist(), size.tolist())) == {g: c for g, c in zip(all_grams.tolist(), counts.tolist()) if c > crowd} and len(gram)
            limited, _ = suffix_dedup.crowded_grams(grams, crowd, 2)
            assert len(limited) <= 2
            crowds = spark.sparkContext.broadcast((gram, size))
            moved = text.join(runs, ["doc_id", "_d"]).mapInArrow(suffix_dedup.run_rows(parts, crowd, crowds), suffix_dedup.PARTED).where("part >= 0")
            held: dict[int, int] = {}
            for r in moved.collect():
                (*_, crowded), _ = suffix_dedup._unpacked([bytes(r.packed)], (5, 1, 6, 1))
                held[r.part] = held.get(r.part, 0) + int(crowded.sum())
            hottest.append(max(held.values()))
            assert max(held.values()) <= 3 * sum(held.values()) / parts
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert hottest[1] <= 1.5 * hottest[0]


def test_tally_decides(spark):
    """A pair that shares five bytes meets in one posting and is dropped by the tally; six bytes give all six."""
    for planes in range(256):
        inside = [p for p in simhash.PLANES if p & planes == p]
        if planes.bit_count() == 6:
            assert len(inside) == 3 and inside[0] | inside[1] | inside[2] == planes
        assert planes.bit_count() != 5 or len(inside) <= 1
    base = 0x1122334455667788
    near, far = base ^ 0x0100000000000001, base ^ 0x010100000000_0001
    df = spark.createDataFrame([(x,) for x in (base, near, far)], "fp long")
    assert {frozenset(r) for r in simhash.links(df).collect()} == {frozenset((base, near)), frozenset((near, far))}


@pytest.mark.parametrize("n, width, spread", [(2000, 64, 0.0), (6000, 256, 0.0), (4000, 32, 1.0)])
def test_recall(spark, n, width, spread):
    """Recall against brute force with far more vectors than a bucket holds; `spread`: norms from 1/e to e."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, width))
    x *= np.exp(rng.uniform(-spread, spread, (n, 1))) / np.sqrt((x**2).sum(1, keepdims=True))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4).cache()
    found = ann.search(vectors, F.col("id") % 20 == 0).toPandas().groupby("query_id")["vec_id"].apply(set)
    q = np.arange(0, n, 20)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    best = np.argsort(-scores, 1)[:, :20]
    recall = np.mean([len(set(b.tolist()) & found[i]) / 20 for i, b in zip(q.tolist(), best)])
    print(f"recall of {n} x {width}: {recall:.3f}")
    assert recall >= 0.9


def test_more_vectors_more_buckets():
    sizes = [np.prod([2.0 * s for s in ann.Polytopes.of(64, n, 128, 8, 0.0, 1).sizes]) for n in (1000, 100_000, 10**9)]
    assert sizes[0] < sizes[1] < sizes[2] and all(n / s < 1000 for n, s in zip((1000, 100_000, 10**9), sizes))


def test_window_count_rises():
    sizes = [1500, 1500, 1500, 600]  # three windows could hold the sum, but no three hold the items
    parts = packing.windows_of(sizes, 2048, 3)
    assert sorted(i for p in parts for i in p) == [0, 1, 2, 3] and max(sum(sizes[i] for i in p) for p in parts) <= 2048 and len(parts) == 4
    many = packing.windows_of([1] * 4000 + [2000] * 3, 2048, 5)
    assert len(many) == 5 and max(map(len, many)) <= 2048


@pytest.mark.parametrize("seed", range(4))
def test_chat_windows_keep_the_budget(seed):
    rng = np.random.default_rng(seed)
    costs, past = rng.integers(1, 300, 200).tolist(), rng.integers(1, 80, seed * 5).tolist()
    costs[50], opens = 1500, not past
    found = chat.spans(costs, past, 90 if seed % 2 else None, opens, 1024, 192)
    assert [i for i, *_ in found] == [0] + [end for _, end, *_ in found[:-1]] and found[-1][1] == 200
    for i, end, back, kept in found:
        history = (past + costs)[len(past) + i - back : len(past) + i]
        total = sum(costs[i:end]) + sum(history) + (90 if kept else 0)
        assert sum(history) <= 192 and (total <= 1024 or (end - i == 1 and costs[i] > 1024 - 90))
        assert kept == (seed % 2 == 1 and not (opens and i == 0) and costs[i] + 90 <= 1024)
        if end < 200:
            assert total + costs[end] > 1024  # the span is the longest


def test_long_conversation_is_spread(spark):
    import public_tokenizers

    turns = [(1, k, ("system", "user", "assistant")[min(k, 1 + k % 2)], f"turn number {k}, with some words in it") for k in range(400)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    how = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = chat.format_chats(df, *how, budget=200, history=60, segment=500)
    rows = sorted(found.collect(), key=lambda r: r.window)
    assert [r.window for r in rows] == np.cumsum([0] + [r.turns for r in rows[:-1]]).tolist() and sum(r.turns for r in rows) == 400
    assert all(r.tokens <= 200 and (r.window == 0 or (r.text.startswith("<|im_start|>system\nturn number 0,") and r.repeated >= 2)) for r in rows)
    said = [r.text[m.start : m.start + m.length] for r in rows for m in r.mask]
    assert said == [t for _, _, role, t in turns if role == "assistant"]


def test_language_of_long_texts(spark):
    words = {"en": "the house and the water of this morning ", "fr": "la maison et les eaux de ce matin là "}
    rows = [(i, words[lang] * 600, lang) for i in range(60) for lang in ("en", "fr") if (i % 2 == 0) == (lang == "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.languages(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == 60 and all(r.lang_pred == r.lang for r in found)


def test_prior_without_negatives():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 0.7, (6000, 12)).astype(np.float32), rng.normal(-1, 0.7, (6000, 12)).astype(np.float32)
    for share in (0.25, 0.75):
        n = int(4000 * share)
        assert abs(quality.estimated_prior(good[4000:], np.concatenate([good[:n], bad[: 4000 - n]])) - share) < 0.08


def test_fingerprints_against_plain(spark):
    import xxhash

    texts = ["a b c d e f g h i j k l m n o p", "a  B c\td e f g h", "one two", "", None, "word " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    long_hash = lambda h, seed: xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
    for r in sketch.fingerprints(df).collect():
        words = (texts[r.doc_id] or "").lower().split()
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
        want = set()
        for i in range(max(1, len(hashes) - 4) if hashes else 0):
            seed = 42
            for h in hashes[i : i + 5]:
                seed = long_hash(h, seed)
            if (seed - (1 << 64) if seed >> 63 else seed) < -(2**63) + 2**64 // 8:
                want.add(f"{seed:016x}")
        got = {r.fingerprint[i : i + 16] for i in range(0, len(r.fingerprint), 16)}
        assert got == want


def test_next_with_a_far_id_and_one_crowded_id(spark):
    rows = [(i, f"t{i}") for i in range(0, 400, 2)] + [(2**62, "far")] + [(100, f"{chr(97 + i % 26)}{i}") for i in range(600)] + [(None, f"n{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, n = sketch.with_buckets(df, 16)
    counts = [r["count"] for r in dealt.groupBy("_bucket").count().collect()]
    assert max(counts) < len(rows) / 4 and n > 8
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = sorted(((a, b) for a, b in zip(order, [*order[1:], order[0]])), key=str)
    assert sorted((((r.doc_id, r.text), (r.next_doc_id, r.next_text)) for r in sketch.with_next(df, 16).collect()), key=str) == want


def test_shingle_sets():
    texts = [b"A b c d e f", b"a b  c d e f", b"x y", b"", b" \n", b"w " * 40]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found, cuts = near_copies.shingles(np.frombuffer(b"".join(texts), np.uint8), at)
    assert np.diff(cuts).tolist() == [2, 2, 1, 0, 0, 1] and found[:2].tolist() == found[2:4].tolist()


def test_spare_names_and_folder(spark):
    df = spark.createDataFrame([(1, 2)], "own long, OWN_ long")
    assert spare(df, "own", "other") == ["own__", "other"]
    assert shared_folder(spark)


def test_positives_are_bounded_by_rows(spark, monkeypatch):
    """All texts under one id: about as many rows come to the driver as were asked for."""
    from quadrille.llm import quality

    seen = []
    gather = quality._gather
    monkeypatch.setattr(quality, "_gather", lambda *a: seen.append(gather(*a)) or seen[-1])
    docs = spark.createDataFrame([(1, f"text number {i} of one id") for i in range(1500)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    quality.train(docs, labels, positives=40, unlabelled=60)
    assert 10 < len(seen[0]) < 100 and 20 < len(seen[1]) < 140


def test_long_turns_are_copied_twice_at_most(spark):
    """A turn of a million characters between short ones, in small segments: windows as in one segment, and few copies."""
    import public_tokenizers
    from quadrille.llm import chat

    turns = [(1, k, ("user", "assistant")[k % 2], f"word {k} " * (3 if k != 5 else 150_000)) for k in range(12)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = [[(r.window, r.text, r.repeated) for r in chat.format_chats(df, path, pattern, segment=s).orderBy("window").collect()] for s in (512, 1 << 40)]
    own = lambda rows: [(t, n) for w, t, n in rows]
    assert sum(len(t) for t, _ in own(found[0])) < 1.1 * sum(len(x[3]) for x in turns) + 20_000
    back = [chat.read_back(chat.format_chats(df, path, pattern, segment=s)).first()[:5] for s in (512, 1 << 40)]
    assert back[0] == back[1]


def test_words_are_cut_once_a_run():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, plain = packing.WordTokenizer(path), Tokenizer.from_file(path)
    texts = ["", " ", "it's  they'll,ok don't'", "a_b_ 12x3 été naïve 中文 é", "x\x1cy\u0085z", "Ⅷ ΣΟΣ <|endoftext|>", "Word, word. " * 50]
    assert [x.tolist() for x in own.ids(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert {"word,", "word.", "they'll,ok"} <= set(own.cache.number) and {"word", ",", "'ll"} <= set(own.pieces.number)
    cut = []
    own.cache.encode = lambda runs: cut.append(runs) or own._cut(runs)
    own.ids(["word, word. new! word,"])
    assert cut == [["new!"]]


def test_runs_are_looked_up_once_a_group_and_equal_the_tokenizer():
    """However often a run occurs in a group of texts, its ids are looked up once; ids equal the whole tokenizer's, whatever the white space."""
    import public_tokenizers

    own = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    asked, plain = [], own.cache.flat_ids_of
    own.cache.flat_ids_of = lambda chunks, places, lengths: asked.append(len(chunks)) or plain(chunks, places, lengths)
    texts = ["same words " * 500 + "don't", "", " ", "\u00a0same\u3000Words\u2028x\u0085y\u200bz\u180ew ", "A\u0300 \u212b \u0130I e\u0301\u0327 \u1e9b\u0323 \ufb01n", "a\x1cb \u03a3\u03a3", "in<|endoftext|>side", "1\u00bd2\u0663_x_ \U0001f600\u0301!", "a\u1c89b \ua7da\ua7ce1 \U000105d3x \U00020000y", "\tsame\nsame\r\nsame\x0b\x0csame"]
    for got, text in zip(own.ids(texts), texts, strict=True):
        assert got.tolist() == own.own.encode(text, add_special_tokens=False).ids
    assert asked[0] < 30
    assert own.ids([]) == [] and [len(x) for x in own.ids([""])] == [0]

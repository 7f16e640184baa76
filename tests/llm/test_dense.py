"""The trained operators held against dense and plain versions of what they fit."""

import math
import random

import numpy as np
import pytest

from quadrille.llm import langid, quality


def grams(text: bytes) -> set[int]:
    """The buckets of the n-grams that a text has, one by one."""
    low, out = text.lower(), set()  # bytes.lower() knows A-Z only
    for width in langid.WIDTHS:
        for i in range(len(low) - width + 1):
            code = int.from_bytes(low[i : i + width], "big") ^ (width * 0x9E3779B1 & 0xFFFFFFFF)
            out.add((code * 0x85EBCA6B & 0xFFFFFFFF) >> 17)
    return out


def alike(a: set[int], b: set[int]) -> float:
    return len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1))


def test_language_is_kernel_ridge():
    """With every text a landmark, the folded weights are the dense kernel ridge regression on set kernels."""
    rng = random.Random(5)
    words = {"aa": "der die und nicht haus wasser".split(), "bb": "the and not house water".split(), "cc": "el la y no casa agua".split()}
    langs = [x for x in words for _ in range(6 if x == "cc" else 12)]
    texts = [" ".join(rng.choices(words[x], k=rng.randint(3, 40))).encode() for x in langs]
    asked = [" ".join(rng.choices(rng.choice(list(words.values())), k=rng.randint(1, 30))).encode() for _ in range(40)] + [b"", b"x"]
    model = langid.fit(texts, langs, landmarks=len(texts), ridge=1e-3)

    sets, names, n = [grams(t) for t in texts], sorted(words), len(texts)
    k = np.array([[alike(a, b) for b in sets] for a in sets])
    weight = np.array([n / len(names) / langs.count(x) for x in langs])
    target = np.array([[1.0 if x == y else -1.0 for y in names] for x in langs])
    alpha = np.linalg.solve(k @ (k * weight[:, None]) + 1e-3 * n * k + 1e-6 * n * np.eye(n), k @ (target * weight[:, None]))
    want = np.array([[alike(grams(t), s) for s in sets] for t in asked]) @ alpha

    at = np.concatenate([[0], np.cumsum([len(t) for t in asked])]).astype(np.int64)
    which, score = langid.predict(model, np.frombuffer(b"".join(asked), np.uint8), at)
    assert model["names"] == names
    assert np.allclose(score, 1 / (1 + np.exp(-langid.TEMPERATURE * want.max(1))), atol=2e-3)
    clear = np.ptp(want, axis=1) > 0.01
    assert clear.sum() > 30 and (which == want.argmax(1))[clear].all()


def test_long_text_is_the_mean_of_its_blocks():
    model = langid.fit([b"aaa bbb", b"ccc ddd"] * 3, ["a", "c"] * 3)
    text = (b"aaa bbb " * 700)[:5000]
    blocks = [text[: langid.BLOCK], text[langid.BLOCK :]]
    plain = [np.array([model["w"][sorted(grams(b))].sum(0) / math.sqrt(len(grams(b)))]) for b in blocks]
    want = sum(p * len(b) for p, b in zip(plain, blocks)) / len(text)
    _, score = langid.predict(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert np.allclose(score, 1 / (1 + np.exp(-langid.TEMPERATURE * want.max(1))), atol=1e-4)


def risk(w: list[np.ndarray], pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk, by the logistic loss: of the positives, and of the negatives."""
    out = lambda x: np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]
    loss = lambda z: np.log1p(np.exp(-z)).mean()
    return prior * loss(out(pos)), loss(-out(unl)) - prior * loss(-out(pos))


@pytest.mark.parametrize("decay", [0.0, 0.5])
def test_quality_descends_the_non_negative_risk(decay):
    """A first step of Adam goes by `rate` against the sign of each partial derivative, found here by differences."""
    rng, met = np.random.default_rng(1), set()
    for seed in range(40):
        pos, unl = rng.normal(3, 1, (30, 4)), rng.normal(-1, 1, (40, 4))
        prior, rate = (0.3, 0.99)[seed % 2], 1e-3
        model = quality.fit(pos, unl, prior, hidden=3, epochs=1, batch=10**6, rate=rate, decay=decay, seed=seed)
        draw = np.random.default_rng(seed)
        first = [draw.normal(0, 0.5**0.5, (4, 3)), np.zeros(3), draw.normal(0, (1 / 3) ** 0.5, 3), np.zeros(1)]
        scaled = lambda x: np.clip((x - model["mean"]) / model["scale"], -8, 8)
        p, u = scaled(pos), scaled(unl)
        below = risk(first, p, u, prior)[1] < 0
        met.add(below)

        def goal(w):
            good, bad = risk(w, p, u, prior)
            penalty = decay / 2 * ((w[0] ** 2).sum() + (w[2] ** 2).sum())
            return penalty + (-bad if below else good + bad)

        for a, b in zip(first, model["w"]):
            for at in np.ndindex(a.shape):
                kept = a[at]
                a[at] = kept + 1e-5
                up = goal(first)
                a[at] = kept - 1e-5
                slope = (up - goal(first)) / 2e-5
                a[at] = kept
                if abs(slope) > 1e-3:
                    assert abs(b[at] - (kept - rate * np.sign(slope))) < 1e-5
    assert met == {True, False}


def test_quality_reads_each_text_alone():
    rng = random.Random(2)
    texts = ["", "a", "Ünï çödé", "!!! buy now !!!", "one two one two one two", "x" * 3000] + ["".join(rng.choices("abc DE\n.,0é", k=rng.randint(0, 400))) for _ in range(300)]
    coded = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in coded])]).astype(np.int64)
    together = quality.features(np.frombuffer(b"".join(coded), np.uint8), at)
    for t, row in zip(coded, together):
        alone = quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        assert np.allclose(row, alone, atol=1e-6)
        if t:
            for kind, has in ((0, bytes.isupper), (1, bytes.islower), (2, bytes.isdigit)):
                share = sum(has(bytes([b])) for b in t) / len(t)
                assert abs(row[quality.TRIGRAMS + kind] ** 2 - share) < 1e-5

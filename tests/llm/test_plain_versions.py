"""The vectorised text models held against plain versions: one text, word or weight at a time."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from caseflow.llm import lang_cnn, quality_gbt, toxicity_ftrl

TEXTS = ["One two two three.\nOne two two three.\n\n", "", "AAA!! BBB!! aaa!!", "x", "été | a | b été", None, "  \n\t ", "a b a b a",
         "Wörter, wörter: 123 (456) = \"x\"\r\nend? *#% \x7f\x00", "longword longwork long lon longword", "日本語 テキスト 日本語"]


# --- language ID -----------------------------------------------------------------

def plain_forward(net, p, codes):
    """Probabilities of one window, filter by filter and place by place."""
    padded = [*codes, *[lang_cnn.PAD] * (max(lang_cnn.WIDTHS) - 1)]
    pooled = []
    for i, width in enumerate(lang_cnn.WIDTHS):
        for f in range(i * lang_cnn.FILTERS, (i + 1) * lang_cnn.FILTERS):
            w = p["W"][:, f].reshape(-1, lang_cnn.EMBED)
            best = max(sum(float(p["E"][padded[at + k]] @ w[k]) for k in range(width)) for at in range(lang_cnn.WINDOW))
            pooled.append(max(best + p["b"][f], 0.0))
    logits = np.array(pooled) @ p["V"] + p["c"]
    e = np.exp(logits - logits.max())
    return e / e.sum()


def some_windows(rng, n=3):
    x = rng.integers(97, 110, (n, lang_cnn.WINDOW)).astype(np.int16)
    x[-1, 9:] = lang_cnn.PAD
    return x


def test_network_equals_a_plain_one(rng):
    net, x = lang_cnn.ByteCnn(["a", "b", "c"]), some_windows(rng)
    net.p["b"] += rng.normal(size=net.p["b"].shape).astype(np.float32)
    net.p["c"] += rng.normal(size=3).astype(np.float32)
    p = {k: v.astype(float) for k, v in net.p.items()}
    np.testing.assert_allclose(net.predict(x), [plain_forward(net, p, c) for c in x], rtol=1e-4, atol=1e-6)


def test_first_step_goes_down_the_numeric_gradient(rng):
    """Adam's first step moves every weight by the rate against the sign of its gradient."""
    net, x, y = lang_cnn.ByteCnn(["a", "b", "c"]), some_windows(rng), np.array([0, 2, 1])
    start = {k: v.astype(float) for k, v in net.p.items()}
    net.fit(x, y, epochs=1, batch=len(x), rate=0.01)

    def loss(p):
        return -np.mean([math.log(plain_forward(net, p, c)[t]) for c, t in zip(x, y)])

    seen = 0
    for name, value in start.items():
        at = [i for i in np.ndindex(value.shape) if name != "E" or i[0] in x[:, :9]]
        if name == "W":
            at = [i for i in at if net.mask[i]]
        for i in [at[k] for k in rng.choice(len(at), min(10, len(at)), replace=False)]:
            sides = []
            for h in (1e-5, -1e-5):
                p = {k: v.copy() for k, v in start.items()}
                p[name][i] += h
                sides.append(loss(p))
            slope = (sides[0] - sides[1]) / 2e-5
            if abs(slope) > 1e-4:
                seen += 1
                assert net.p[name][i] - start[name][i] == pytest.approx(-0.01 * np.sign(slope), rel=1e-2), (name, i)
    assert seen > 15
    assert not (net.p["W"][net.mask == 0]).any() and not net.p["E"][lang_cnn.PAD].any()


# --- toxicity --------------------------------------------------------------------

def plain_features(text):
    """What the features of a text stand for: words, beginnings, pairs and skip pairs, A-Z folded."""
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]
    out = [("word", w) for w in words]
    out += [("begin", size, w[:size]) for size in toxicity_ftrl.STEMS for w in words if len(w) >= size]
    return out + [("pair", gap, a, b) for gap in (1, 2) for a, b in zip(words, words[gap:])]


def test_features_stand_for_words_beginnings_pairs_and_skip_pairs():
    idx, of = toxicity_ftrl.features(pa.array(TEXTS))
    got = [Counter(idx[of == i].tolist()) for i in range(len(TEXTS))]
    names = {}
    for i, t in enumerate(TEXTS):
        alone, _ = toxicity_ftrl.features(pa.array([t], pa.string()))
        want = plain_features(t)
        assert Counter(alone.tolist()) == got[i] and len(alone) == len(want)
        for k, name in zip(alone.tolist(), want):
            assert names.setdefault(name, k) == k
    assert len(set(names.values())) == len(names)  # no two of these share a place


def plain_ftrl(rows, y, epochs, alpha, beta, l1, seed):
    """The same learner over dictionaries, one weight at a time."""
    z, n = Counter(), Counter()

    def weight(i):
        penalty = 0.0 if i == "bias" else l1
        if abs(z[i]) <= penalty:
            return 0.0
        return -(z[i] - math.copysign(penalty, z[i])) / ((beta + math.sqrt(n[i])) / alpha)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            names = [*rows[r].tolist(), "bias"]
            w = {i: weight(i) for i in names}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[r]
            for i in names:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z) if weight(i)}


def test_ftrl_equals_a_plain_version(rng):
    rows = [np.unique(rng.integers(0, 60, 12)) for _ in range(150)]
    y = np.array([float((r == 7).any() or (rng.random() < .1)) for r in rows])
    got = toxicity_ftrl.fit(rows, y, epochs=4, alpha=0.5, beta=1.0, l1=1.5, seed=9)
    want = plain_ftrl(rows, y, 4, 0.5, 1.0, 1.5, 9)
    assert got.bias == pytest.approx(want.pop("bias"))
    assert 3 < len(want) < 60 and sorted(want) == got.index.tolist()
    np.testing.assert_allclose(got.value, [want[i] for i in sorted(want)])


def test_a_score_counts_every_feature_once(rng):
    idx, _ = toxicity_ftrl.features(pa.array(TEXTS))
    index = np.unique(idx)
    w = toxicity_ftrl.Weights(-0.3, index, rng.normal(size=len(index)))
    weight = dict(zip(w.index.tolist(), w.value))
    for t, s in zip(TEXTS, w.score(pa.array(TEXTS))):
        own = set(toxicity_ftrl.features(pa.array([t], pa.string()))[0].tolist())
        assert s == pytest.approx(1 / (1 + math.exp(0.3 - sum(weight[i] for i in own))))


# --- quality ---------------------------------------------------------------------

def plain_statistics(text):
    raw = (text or "").encode()
    fold = lambda w: bytes(b + 32 if 65 <= b <= 90 else b for b in w)
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    lines = [x for x in raw.split(b"\n") if x]
    known = "".join(quality_gbt.CLASSES).encode()
    counts = [sum(raw.count(bytes([b])) for b in c.encode()) for c in quality_gbt.CLASSES]
    counts += [sum(b < 0x80 and b not in known for b in raw), sum(0x80 <= b < 0xC0 for b in raw), sum(b >= 0xC0 for b in raw)]
    size, n = len(raw), max(len(words), 1)
    folded = [fold(w) for w in words]
    pairs = list(itertools.pairwise(folded))
    most = lambda x: max(Counter(x).values(), default=0)
    length = [len(w) for w in words]
    mean = sum(length) / n
    std = math.sqrt(max(sum(v * v for v in length) / n - mean * mean, 0))
    k = max(len(lines), 1)
    return [*[c / max(size, 1) for c in counts], math.log1p(size), math.log1p(len(words)), mean, std,
            sum(a == b for a, b in pairs) / n, len(set(folded)) / n, most(folded) / n, len(set(pairs)) / n, most(pairs) / n,
            math.log1p(len(lines)), len(words) / k, len({fold(x) for x in lines}) / k,
            max(map(len, lines), default=0) / max(size, 1), sum(65 <= w[0] <= 90 for w in words) / n,
            *[counts[i] / n for i in (7, 9, 10, 5, 2)]]


def test_quality_statistics_equal_a_plain_version():
    np.testing.assert_allclose(quality_gbt.statistics(pa.array(TEXTS)), [plain_statistics(t) for t in TEXTS], atol=1e-9)

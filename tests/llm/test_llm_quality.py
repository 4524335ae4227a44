"""The quality classifier against plain Python: features text by text, and the fit of its pairs by gradient descent."""

from __future__ import annotations

import math
import random
import re
import string

import numpy as np

from kilnwork.llm import quality

KINDS = [string.ascii_uppercase, string.ascii_lowercase, string.digits, ".,;:", "!?", "\"'()", "#$%&*@^~", "|<>[]{}\\/=+_-", "\n\r"]


def kind(byte: int) -> int:
    """1 to 10, by the lists above and bytes beyond ASCII; 0: none."""
    return 10 if byte > 127 else next((i + 1 for i, k in enumerate(KINDS) if chr(byte) in k), 0)


def plain(text: bytes) -> list[float]:
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", text) if w]
    n, some = len(text), max(len(words), 1)
    lines = re.findall(rb"[^\n]*\n|[^\n]+", text)
    out = [sum(kind(b) == k for b in text) / max(n, 1) for k in range(1, 11)]
    out += [math.log1p(n), math.log1p(len(words)), (n - len(words)) / some]
    out += [sum(a == b for a, b in zip(words, words[1:], strict=False)) / some, len(set(words)) / some, math.log1p(len(set(words))) / math.log1p(some)]
    out += [sum(kind(w[-1]) == 5 or kind(w[-1]) >= 7 for w in words) / some, sum(kind(w[-1]) == 4 for w in words) / some]
    out += [sum(kind(w[0]) == 1 for w in words) / some, sum(sum(kind(b) == 1 for b in w) >= 2 for w in words) / some]
    out += [sum(len(w) == 1 for w in words) / some, sum(len(w) > 14 for w in words) / some]
    return [*out, len(set(lines)) / max(len(lines), 1)]


def test_features_are_those_of_each_text_by_definition():
    rng = random.Random(3)
    pieces = ["word", "Word", "WORD", "a", "x1", "--", "é", "end.", "what?", "(so)", "averyveryverylongword", " ", "  ", "\n", "\n\n", "\t", "\x0b", "#", "{", "a a", "line one\nline one\n", "\x00"]
    texts = ["", " ", "\n", "a", "\n\n\n", "w " * 3000, "same same same"] + ["".join(rng.choices(pieces, k=rng.randrange(1, 60))) for _ in range(150)]
    raw = [t.encode() for t in texts]
    got = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    np.testing.assert_allclose(got, np.array([plain(t) for t in raw]), rtol=0, atol=1e-9)


def test_the_fit_is_the_optimum_of_the_logistic_loss_on_differences():
    """Weights by plain gradient descent over the same pairs; the threshold by the share of bad documents among the strengths."""
    rng = np.random.default_rng(4)
    good = rng.random(60) < 0.6
    x = rng.normal(size=(60, 3)) + good[:, None] * np.array([1.0, 0.4, 0.0])
    got = quality.Ranker(x, good, pairs=2, steps=4, ridge=3.0, seed=7)
    cuts = [sorted(set(np.quantile(c, [0.25, 0.5, 0.75]).tolist())) for c in x.T]
    z = np.array([[float(row[i] > c) for i in range(3) for c in cuts[i]] for row in x])
    up, down, draw = [i for i in range(60) if good[i]], [i for i in range(60) if not good[i]], np.random.default_rng(7)
    wins = [i for i in up for _ in range(2)] + draw.choice(up, 2 * len(down)).tolist()
    losses = draw.choice(down, 2 * len(up)).tolist() + [i for i in down for _ in range(2)]
    w, d = np.zeros(z.shape[1]), z[wins] - z[losses]
    for _ in range(5000):
        w = w - 0.01 * (3.0 * w - ((1 / (1 + np.exp(d @ w)))[:, None] * d).sum(0))
    np.testing.assert_allclose(got.weights, w, atol=1e-3)
    strength = sorted((z @ w).tolist())
    below = [s for s in strength if s <= np.quantile(strength, len(down) / 60) + 1e-9]
    want = (below[-1] + strength[len(below)]) / 2
    assert abs(got.threshold - want) < 1e-2
    np.testing.assert_allclose(got.scores(x), 1 / (1 + np.exp(-(z @ w - want))), atol=1e-2)

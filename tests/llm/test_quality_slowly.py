"""The quality classifier's features, risk and steps, recomputed by slow code."""

import math
import random

import numpy as np
import pytest

from tilefold.llm import op8_quality as q

SPACE = b" \t\n\r\x0b\x0c"
MARKS = b"#*$%&|<>!?.,;:\"'()[]{}/\\_=+-~@^`"


def slow_features(text):
    raw = list(text.encode())
    n = len(raw)
    if not n:
        return [0.0] * q.N_FEATURES
    words, held = [], []
    for b in [*raw, 32]:
        if b in SPACE:
            if held:
                words.append(tuple(held))
            held = []
        else:
            held.append(b)
    m = max(1, len(words))
    lines = [x for x in bytes(raw).split(b"\n") if x]
    upper, lower, high = (sum(f(b) for b in raw) for f in (lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122, lambda b: b >= 128))
    runs, k = 0, 0
    while k < n:
        j = k
        while j < n and raw[j] in b"#*$%&|<>!?=_~^-":
            j += 1
        runs += j - k >= 2
        k = max(j, k + 1)

    def title(w):  # runs of letters of which the first alone is a capital, at least one
        some, inside = False, False
        for b in w:
            up, low = 65 <= b <= 90, 97 <= b <= 122
            if up and inside or low and not inside:
                return False
            some, inside = some or up, up or low
        return some

    out = [1.0, math.log1p(n) / 10, math.log1p(m) / 10 if words else math.log1p(1) / 10, min(4.0, n / m / 10), len(set(words)) / m, max((words.count(w) for w in set(words)), default=0) / m]
    out += [sum(a == b for a, b in zip(words, words[1:])) / m, upper / max(1, upper + lower + high), sum(48 <= b <= 57 for b in raw) / n, high / n, len(lines) / m]
    out += [1 - len(set(lines)) / max(1, len(lines)), min(2.0, 4 * runs / m), sum(title(w) for w in words) / m]
    out += [min(2.0, raw.count(c) / m) for c in MARKS]
    pairs = [0] * q.HASHED
    for a, b in zip(raw, raw[1:]):
        pairs[((a * 31 + b * 101) * 2654435761 % 2**32) >> 26] += 1
    return out + [math.sqrt(p / (n - 1)) if n > 1 else 0.0 for p in pairs]


def texts(n, seed):
    r = random.Random(seed)
    words = ["alpha", "Beta", "été", "x1", "##", "$$!!", "Über", "a.b", "don't", "AbC", "42", "Title-Case"]
    made = [r.choice([" ", "\n", "  "]).join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(n)]
    return ["", " \n ", "a", "é", "!!", "Aa", "same\nsame\nsame", *made]


def test_features():
    for t in texts(60, 1):
        assert np.allclose(q.features(t), slow_features(t), rtol=1e-5, atol=1e-6), t[:60]


@pytest.mark.parametrize("prior", [0.3, 0.95])
def test_steps_follow_the_risk(monkeypatch, prior):
    """Three steps from numeric slopes of the non-negative risk: a risk of unlabelled texts below 0 is climbed out of."""
    monkeypatch.setattr(q, "STEPS", 3)
    monkeypatch.setattr(q, "HIDDEN", 3)
    r = np.random.default_rng(2)
    pos, unl = (np.array([slow_features(t) for t in texts(14, s)]) for s in (3, 4))
    model = q.Model(pos, unl, prior)
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (pos, unl))
    r = np.random.default_rng(q.SEED)
    w = [r.standard_normal((q.N_FEATURES, 3)) / np.sqrt(q.N_FEATURES), np.zeros(3), r.standard_normal(3) / np.sqrt(3), np.zeros(1)]

    def sigmoid(x):
        return 1 / (1 + np.exp(-(np.tanh(x @ w[0] + w[1]) @ w[2] + w[3])))

    climbed = False
    first, second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in (1, 2, 3):

        def negative():
            return sigmoid(u).mean() - prior * sigmoid(p).mean()

        below = negative() < 0
        climbed |= below

        def risk(below=below):
            return -negative() if below else prior * (1 - sigmoid(p)).mean() + negative()

        slopes = []
        for x in w:
            g = np.zeros_like(x)
            for at in np.ndindex(x.shape):
                kept, ends = x[at], []
                for h in (1e-5, -1e-5):
                    x[at] = kept + h
                    ends.append(risk())
                x[at] = kept
                g[at] = (ends[0] - ends[1]) / 2e-5
            slopes.append(g + q.DECAY * x)
        for k, g in enumerate(slopes):
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            rate = q.RATE * (1 - step / 4) + 1e-4
            w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    assert climbed == (prior > 0.9)
    assert all(np.allclose(a, b, atol=2e-4) for a, b in zip(model.p, w))
    assert np.allclose(model.score(unl), sigmoid(u), atol=1e-3)

"""What the network of the secret scan is taught, and what its recall is counted over."""

from __future__ import annotations

import random

import numpy as np
from test_models import sample_texts

from voxtally.llm import secrets


def hot_keys(texts, seed):
    """The texts, a third of them with a key that no pattern knows; and these keys."""
    rng, out, keys = random.Random(seed), [], set()
    for i, t in enumerate(texts):
        if i % 3 == 0:
            shape = ("ghp_", 36, secrets._WIDE) if i % 2 else ("", 40, "0123456789ABCDEF")
            key = shape[0] + "".join(rng.choice(shape[2]) for _ in range(shape[1]))
            keys.add(key)
            t = f"{t[:200].rpartition(' ')[0]} {key} {t[200:]}"
        out.append(t)
    return out, keys


def test_keys_of_unknown_shape_are_not_taught_as_clean(spark):
    texts, keys = hot_keys(sample_texts(spark, 500), 1)
    rows, labels = secrets.labelled_findings(texts)
    assert not keys & {value for (_, value, _), label in zip(rows, labels) if label == 0}
    net = secrets.train(rows, labels, epochs=6)
    texts, keys = hot_keys(sample_texts(spark, 300, 600), 2)
    asked = [
        (t[max(0, a - secrets.CONTEXT) : a], t[a:b], t[b : b + secrets.CONTEXT])
        for t in texts
        for a, b in secrets.candidates(t, secrets.base_spans(t))
        if t[a:b] in keys
    ]
    assert len(asked) > 0.9 * len(keys)
    found = secrets.scores(net, asked) >= net.threshold
    for upper in (False, True):
        assert found[[(r[1].upper() == r[1]) == upper for r in asked]].mean() > 0.75, upper


def test_ordinary_runs():
    words = {"state", "reports", "market", "daily"}
    assert secrets.ordinary("reports/market/daily/2024", words)
    assert secrets.ordinary("2024-01-31T10:11:12Z", words)
    assert not secrets.ordinary("eyJhbGciOiJIUzI1NiJ9", words)
    assert not secrets.ordinary("stateX9kQ2vLm4TzR8wB", words)
    assert not secrets.ordinary("0F3A55D09C7E1B2A4D6F", words)


def test_recall_is_counted_over_what_a_scan_asks():
    assert secrets._asked("see ", "aB3dE5gH7jK9mN1pQ3sT", " there")
    assert not secrets._asked("token = ", "aB3dE5gH7jK9mN1pQ3sT", " there")
    assert not secrets._asked("see ", "deadbeef" * 4, " there")
    assert not secrets._asked("see ", "aB3dE5gH7j", " there")
    assert not secrets._asked("see ", "aBcdEfghIjklMnopQrst", " there")
    rng = np.random.default_rng(3)
    draw = lambda n, letters: "".join(rng.choice(list(letters), n))
    rows = [("id ", draw(30, "0123456789abcdef"), " x") for _ in range(300)]
    rows += [("id ", draw(30, secrets._WIDE), " x") for _ in range(60)]
    rows += [("id ", "-".join(["plain", "words", "here", str(k)]), " x") for k in range(300)]
    labels = [1] * 360 + [0] * 300
    net = secrets.train(rows, labels)
    held = np.random.default_rng(17).permutation(len(rows))[2 * len(rows) // 3 :]
    own = [rows[i] for i in held if labels[i] and secrets._asked(*rows[i])]
    assert (secrets.scores(net, own) >= net.threshold - 1e-9).mean() >= 0.95

"""Fitting by epochs: gradients, falling loss, the best epoch."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.operators import descent as D
from voxtally.operators.features import class_weights, index_labels


@pytest.fixture(scope="module")
def labelled(spark):
    words = {"positive": "good great fine", "negative": "bad poor sad", "neutral": "so then thus"}
    rows = []
    for i in range(240):
        label = sorted(words)[i % 3]
        own = words[label].split()[i % 2 :]
        rows.append((i, " ".join([*own, f"noise{i % 7}", "the"]), label))
    rows += [(1000, None, "neutral"), (1001, "", "negative")]
    df = spark.createDataFrame(rows, "id int, text string, label string").repartition(5)
    return index_labels(df).persist()


def test_gradients_equal_finite_differences(labelled):
    rows = D.sparse_rows(class_weights(labelled), 32).persist()
    weights = np.random.default_rng(1).normal(size=(3, 32))
    slope, loss, mass = D.gradient(rows, weights)
    assert mass == pytest.approx(rows.agg(F.sum("weight")).first()[0])
    used = sorted({c for r in rows.select("columns").collect() for c in r["columns"]})
    for c, j in [(0, used[0]), (1, used[-1]), (2, used[1])]:
        moved = weights.copy()
        moved[c, j] += 1e-5
        assert (D.gradient(rows, moved)[1] - loss) / 1e-5 == pytest.approx(slope[c, j], abs=1e-5)


def test_partial_sums_are_added_in_a_tree(labelled, monkeypatch):
    rows = D.sparse_rows(class_weights(labelled), 16).repartition(23)
    whole = D.gradient(rows, np.zeros((3, 16)))
    monkeypatch.setattr(D, "FAN", 2)
    tree = D.gradient(rows, np.zeros((3, 16)))
    assert np.allclose(whole[0], tree[0]) and whole[1:] == pytest.approx(tree[1:])


def test_loss_falls_and_the_best_epoch_is_returned(labelled):
    fit = D.fit_by_epochs(labelled, "id", 3, features=64, epochs=8, patience=8)
    losses = [e.loss for e in fit.epochs]
    assert len(losses) == 8 and all(a >= b for a, b in zip(losses, losses[1:])) and losses[-1] < losses[0] / 2
    best = max(e.f1 for e in fit.epochs)
    assert fit.epochs[fit.best].f1 == best and best > 0.9
    assert fit.best == min(k for k, e in enumerate(fit.epochs) if e.f1 == best)
    assert fit.weights.shape == (3, 64)


def test_fit_ends_when_it_is_not_beaten(labelled):
    fit = D.fit_by_epochs(labelled, "id", 3, features=64, epochs=30, patience=2)
    assert len(fit.epochs) < 30 and len(fit.epochs) - 1 - fit.best == 2

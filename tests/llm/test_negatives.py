"""Hard negatives against scores of all pairs in plain Python."""

from __future__ import annotations

import math
import random

import pytest

from voxtally.llm import negatives as module
from voxtally.llm.negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, size string, v int, place long"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def table(spark, rows):
    return spark.createDataFrame([(i, e, y, "x", "y", 1, None) for i, e, y in rows], SCHEMA)


def expected(rows, step=100, k=5):
    usable = []
    for i, e, y in rows:
        if i is None or e is None or y is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        usable.append((i, tuple(math.floor(256 * x) for x in e), y))
    usable = sorted(set(usable))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, e, y in usable:
        if i % step:
            continue
        others = [(-score(e, f), j, z) for j, f, z in usable if len(e) == len(f)]
        same = sorted((s, j) for s, j, z in others if z == y and j != i)[:k]
        other = sorted((s, j) for s, j, z in others if z != y)
        for s, j in same:
            fits = [(t, m) for t, m in other if 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(i, j, r, m, -s, -t) for r, (t, m) in enumerate(fits, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def vectors(seed, n, width=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(8)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        stretch = rng.choice([0.01, 1, 1, 5])
        rows.append((i, [stretch * (x + rng.gauss(0, 0.2)) for x in c], rng.randrange(4)))
    same = [0.5] * width
    rows += [(n + i, list(same), i % 3) for i in range(60)]
    rows += [(10 * n + 100 * i, [0.0] * width, i % 2) for i in range(4)]
    return rows


@pytest.mark.parametrize("bucket", [16, 8192])
def test_hard_negatives(spark, monkeypatch, bucket):
    monkeypatch.setattr(module, "SLAB", 4)
    monkeypatch.setattr(module, "LANE", 3)
    rows = vectors(1, 500)
    rows += [(9100, None, 1), (9200, [1.0] * 6, None), (9300, [None] * 6, 1), (9400, [float("nan")] * 6, 1)]
    rows += [(9500, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (9600, [], 1), (9700, [], 2), (9800, [], 1)]
    rows += [(20_000 + i, [random.Random(i).gauss(0, 1) for _ in range(3)], i % 2) for i in range(0, 900, 25)]
    want = expected(rows)
    assert len(want) > 100
    df = table(spark, rows)
    assert found(hard_negatives(df, module.F.col("vec_id") % 100 == 0, bucket=bucket)) == want


def test_pruning_leaves_few_rows_for_exact_scores():
    import numpy as np

    rng = np.random.default_rng(5)
    m = rng.normal(size=(2000, 8))
    m = np.round(256 * m / np.linalg.norm(m, axis=1)[:, None]).astype(np.int32)
    units = m / np.linalg.norm(m, axis=1)[:, None]
    sizes = np.linalg.norm(m, axis=1)
    row = {
        "ids": np.arange(2000).tobytes(),
        "labels": np.zeros(2000, np.int64).tobytes(),
        "width": 8,
        "vectors": m.tobytes(),
        "orders": np.ascontiguousarray(np.argsort(units, axis=0).astype(np.uint16).T).tobytes(),
        "shortest": float(sizes.min()),
        "longest": float(sizes.max()),
    }
    b = module._Bucket(row)
    left = 0
    for i in range(20):
        v = m[i].astype(np.int64)
        scores = m.astype(np.int64) @ v
        low = float(np.sort(scores)[-10])
        rows = b.candidates(v, float(np.linalg.norm(v)), low, 3)
        assert set(np.flatnonzero(scores >= low)) <= set(rows.tolist())
        left += len(rows)
        assert len(b.candidates(v, float(np.linalg.norm(v)), 1e12, 3)) == 0
    assert left < 20 * 1000


def test_hard_negatives_of_odd_tables(spark):
    anchors = module.F.col("vec_id") % 100 == 0
    assert found(hard_negatives(table(spark, []), anchors)) == []
    assert found(hard_negatives(table(spark, [(100, [1.0], 1)]), anchors)) == []
    rows = vectors(2, 120)
    assert found(hard_negatives(table(spark, rows + rows), anchors)) == expected(rows)
    far = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1e300, 0.0], 2), (3, [0.9, 0.0], 2)]
    # A component too large for exact scores takes no part.
    assert found(hard_negatives(table(spark, far), anchors)) == expected(far[:2] + far[3:])

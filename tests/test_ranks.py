"""Quantiles, ordered ids and frequent values against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.operators import features as E
from voxtally.operators import frequent as Q
from voxtally.operators import groups as G
from voxtally.operators import profile as P
from voxtally.operators import sides
from voxtally.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("rows_at_most", [100_000, 0])
def test_exact_quantiles(spark, monkeypatch, rows_at_most):
    monkeypatch.setattr(sides, "MAX_BROADCAST_ROWS", rows_at_most)
    rng = random.Random(1)
    groups = {"a": 300, "b": 1, "c": 2, None: 7, "hot": 2000, "none": 3}
    rows = []
    for g, n in groups.items():
        for _ in range(n):
            x = rng.choice([rng.randrange(10), rng.randrange(-(10**6), 10**7), 5])
            rows.append((g, None if g == "none" or rng.random() < 0.02 and n > 5 else x, rng.randrange(3)))
    df = spark.createDataFrame(rows, "g string, x long, y int")
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(r["g"], r["column"], r["share"]): r["value"] for r in exact_quantiles(df, ["g"], ["x", "y"], shares).collect()}
    want = {}
    for g in groups:
        for i, c in ((1, "x"), (2, "y")):
            values = [r[i] for r in rows if r[0] == g and r[i] is not None]
            for s in shares if values else ():
                want[g, c, s] = np.quantile(values, s)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert exact_quantiles(df.limit(0), ["g"], ["x"]).count() == 0


def test_quartiles_of_lengths(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x yy"), ("a", None), ("b", None)], "g string, text string")
    rows = P.text_length_quartiles(df, ["g"]).collect()
    assert [(r["g"], r["q50_chars"], r["q25_words"]) for r in rows] == [("a", 2.5, 1.25)]


def test_ids_in_order(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(20)]), f"t{i}") for i in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "k int, at int, text string").repartition(7)
    made = G.assign_ids_in_order(df, ["at"], "k", start=50)
    got = {r["k"]: r["id"] for r in made.collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {k: 51 + n for n, (k, _, _) in enumerate(order)}
    assert made.columns == ["k", "at", "text", "id"]
    plan = made._jdf.queryExecution().executedPlan().toString()
    # The only window runs over the counted ranges.
    assert "Window" not in plan
    assert G.assign_ids_in_order(df.limit(0), ["at"], "k").count() == 0


def test_most_frequent_values(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(8000)] + [None] * 50
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(5)
    want = sorted(Counter(w for w in words if w).items(), key=lambda x: (-x[1], x[0]))
    made = []
    original = Q.written
    monkeypatch.setattr(Q, "written", lambda d, p: made.append((p, original(d, p))) or made[-1][1])
    for n, capacity in ((5, 40), (20, 200), (300, 50), (20, 100_000), (10**6, 60)):
        made.clear()
        got = [tuple(r) for r in Q.most_frequent(df, "word", n, capacity).collect()]
        assert got == want[:n], (n, capacity)
        # What the tasks hand on is bounded by their summaries, and one row for the error of each.
        assert made[0][0] == "summaries" and made[0][1].count() <= 5 * (capacity + 1)
    numbers = spark.createDataFrame([(3,), (3,), (1,)], "x int")
    assert [tuple(r) for r in Q.most_frequent(numbers, "x", 5).collect()] == [(3, 2), (1, 1)]
    assert Q.most_frequent(numbers.limit(0), "x", 5).count() == 0


def test_vocabulary_by_summaries_is_the_vocabulary(spark):
    df = spark.createDataFrame([("a b a",), ("c b",), (None,), ("d e f g",)], "text string")
    for capacity in (2, 100):
        a = E.vocabulary_by_summaries(df, "text", 3, capacity).collect()
        assert a == E.vocabulary(df, "text", 3).collect()


def test_repeats_leave_wide_rows_where_they_are(spark, monkeypatch):
    df = spark.range(200).select("id", F.concat(F.lit("t"), F.least(F.col("id"), F.lit(190))).alias("text"))
    flagged = G.flag_repeats(df, ["text"], "id")
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    rows = {r["id"] for r in flagged.filter("is_duplicate").collect()}
    assert rows == set(range(191, 200))
    monkeypatch.setattr(sides, "MAX_BROADCAST_ROWS", 0)
    assert {r["id"] for r in G.flag_repeats(df, ["text"], "id").filter("is_duplicate").collect()} == rows
    assert G.drop_repeats(df, ["text"], "id").count() == 191

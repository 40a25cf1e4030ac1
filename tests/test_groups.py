"""Per-group operators against plain windows, with one group that dominates."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from voxtally.operators import groups as G
from voxtally.operators import sides


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 rows of which two thirds share a group and a text."""
    k = F.col("id")
    group = F.when(k % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (k % 7).cast("string")))
    text = F.when(k % 3 > 0, "copy").otherwise(F.concat(F.lit("t"), (k % 500).cast("string")))
    df = spark.range(2000).select("id", group.alias("g"), text.alias("text"), (k * 7 % 101).alias("x"))
    return df.repartition(7)


def md5_order(seed):
    return lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def by_group(rows):
    out = {}
    for r in rows:
        out.setdefault(r.g, []).append(r)
    return out


@pytest.mark.parametrize("spread", [None, "id"])
def test_top_n(skewed, spread):
    order = [F.col("x").desc(), F.col("id")]
    got = G.top_n_per_group(skewed, ["g"], order, 5, spread=F.col(spread) if spread else None)
    expected = set()
    for rows in by_group(skewed.collect()).values():
        expected |= {r.id for r in sorted(rows, key=lambda r: (-r.x, r.id))[:5]}
    assert {r.id for r in got.collect()} == expected
    assert got.columns == skewed.columns


def test_repeats(skewed):
    first = {}
    for r in skewed.collect():
        first[r.text] = min(first.get(r.text, r.id), r.id)
    flagged = G.flag_repeats(skewed, ["text"], "id").collect()
    assert len(flagged) == 2000
    assert all(r.is_duplicate == (first[r.text] != r.id) for r in flagged)
    assert {r.id for r in G.drop_repeats(skewed, ["text"], "id").collect()} == set(first.values())


def test_null_is_a_value_of_its_own_among_repeats(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, ""), (4, "-"), (5, "")], "id int, text string")
    flags = {r.id: r.is_duplicate for r in G.flag_repeats(df, ["text"], "id").collect()}
    assert flags == {1: False, 2: True, 3: False, 4: False, 5: True}


@pytest.mark.parametrize("share", [0.0, 0.1, 0.25, 1.0])
def test_split(skewed, share):
    split = G.split_by_share(skewed, ["g"], "id", share, seed=3).collect()
    assert len(split) == 2000
    for rows in by_group(split).values():
        ranked = sorted((r.id for r in rows), key=md5_order(3))
        expected = set(ranked[: int(share * len(rows) + 0.5)])
        assert {r.id for r in rows if r.is_test} == expected


def test_split_of_more_groups_than_are_broadcast(skewed, monkeypatch):
    monkeypatch.setattr(sides, "MAX_BROADCAST_ROWS", 0)
    split = G.split_by_share(skewed, ["g"], "id", 0.25, seed=3).collect()
    for rows in by_group(split).values():
        assert sum(r.is_test for r in rows) == int(0.25 * len(rows) + 0.5)


def test_bounded_broadcast_gives_up_on_large_sides(spark):
    small = sides.bounded_broadcast(spark.range(3), max_rows=3)
    assert small.count() == 3 and "broadcast" in small._jdf.queryExecution().logical().toString()
    large = spark.range(4)
    assert sides.bounded_broadcast(large, max_rows=3) is large


@pytest.mark.parametrize("n", [0, 1, 700, 2000, 5000])
def test_sample(skewed, n):
    ids = sorted((r.id for r in skewed.collect()), key=md5_order(42))
    got = {r.id for r in G.sample_exactly(skewed, "id", n).collect()}
    assert got == set(ids[:n])


def test_ids(skewed):
    got = {r.id: r.new for r in G.assign_ids(skewed, "id", "new", start=10).collect()}
    ranked = sorted(got, key=md5_order(0))
    assert [got[i] for i in ranked] == list(range(11, 2011))


def test_next_id_start(spark):
    assert G.next_id_start(spark.range(5), "id") == 4
    assert G.next_id_start(spark.range(0), "id") == 0


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "z")], "k string, t int, v string")
    got = {tuple(r) for r in G.latest_per_key(df, ["k"], ["t"]).collect()}
    assert got == {("a", 2, None), ("b", 1, "z")}

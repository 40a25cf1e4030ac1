"""Membership of a huge store: exact rows, few buckets read, measured errors of the filter."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from voxtally.operators.comments import unprocessed
from voxtally.operators.membership import KeyStore


def keys(spark, numbers):
    return spark.createDataFrame([(None if i is None else f"c{i}",) for i in numbers], "comment_id string")


def test_same_rows_as_the_anti_join(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "store"), buckets=8, words=32)
    asked = keys(spark, [*range(0, 400, 3), 5, 5, None, None])
    done = []
    assert store.unprocessed(asked).count() == asked.count()
    for number, part in enumerate((range(0, 100), range(90, 200), [], range(350, 360))):
        store.add(keys(spark, [*part, None]), number)
        done += part
        if number == 1:
            store.fold()
        want = unprocessed(asked, keys(spark, done))
        assert sorted(map(str, store.unprocessed(asked).collect())) == sorted(map(str, want.collect()))
    # A batch that is added again replaces itself.
    store.add(keys(spark, range(350, 360)), 3)
    store.fold()
    store.fold()
    wider = store.resize(256)
    for s in (wider, KeyStore(spark, str(tmp_path / "store"), buckets=8, words=256)):
        assert sorted(map(str, s.unprocessed(asked).collect())) == sorted(map(str, want.collect()))


def test_new_rows_read_no_keys_and_hits_read_their_bucket_only(spark, tmp_path, monkeypatch):
    store = KeyStore(spark, str(tmp_path / "store"), buckets=64, words=256)
    store.add(keys(spark, range(5000)), 0)
    read = []
    original = KeyStore._read

    def counted(self, kind, schema):
        df = original(self, kind, schema)
        if kind == "keys":
            read.append(df)
        return df

    monkeypatch.setattr(KeyStore, "_read", counted)
    new = keys(spark, range(90_000, 90_003))
    suspects = {r["bucket"] for r in store.suspects(new).collect()}
    assert store.known(new).count() == 0
    assert len(read) == (1 if suspects else 0)
    read.clear()
    one = keys(spark, [17])
    found = store.known(one)
    assert [r["key"] for r in found.collect()] == ["c17"]
    # The plan reads one of 64 folders of keys.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = ", plan)
    bucket = store.suspects(one).first()["bucket"]
    stored = read[0].filter(F.col("bucket") == bucket).count()
    assert 0 < stored < 5000 / 64 * 2


def test_errors_of_the_filter(spark, tmp_path):
    # Five keys to a word, as the default expects.
    store = KeyStore(spark, str(tmp_path / "store"), buckets=4, words=500)
    store.add(spark.range(10_000).select(F.concat(F.lit("a"), "id").alias("comment_id")), 0)
    new = spark.range(10_000).select(F.concat(F.lit("b"), "id").alias("comment_id"))
    wrong = store.suspects(new).count() / 10_000
    assert 0.001 < wrong < 0.06
    old = spark.range(10_000).select(F.concat(F.lit("a"), "id").alias("comment_id"))
    assert store.suspects(old).count() == 10_000

"""Stores and counts that grow by batches, and streams with keyed state."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from voxtally.streaming import batches as B
from voxtally.streaming import incremental as I
from voxtally.streaming import state as S

INT, STR = IntegerType(), StringType()
SCHEMA = StructType([StructField("id", STR), StructField("version", INT), StructField("text", STR)])


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return I.read_stream(spark, path, schema)


def contents(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return set(rows)


def newest(batches):
    best = {}
    for rows in batches:
        for r in rows:
            if r[0] is not None and (r[0] not in best or r[1] >= best[r[0]][1]):
                best[r[0]] = r
    return set(best.values())


def test_batch_store(spark, tmp_path):
    rng = random.Random(2)
    store = B.BatchStore(spark, str(tmp_path / "store"), SCHEMA, ["id"], ["version"], buckets=4)
    assert store.read().count() == 0
    store.fold()
    done = []
    for batch in range(6):
        ids = rng.sample(range(60), 25)
        # Versions go up and down, so that some rows are stale; equal ones go by the batch.
        rows = [(str(i), rng.randrange(4), f"{batch}-{i}") for i in ids] + [(None, 9, "no key")]
        done.append(rows)
        store.run(land(spark, str(tmp_path / "in"), rows, SCHEMA), lambda df: df)
        assert contents(store.read()) == newest(done)
        if batch in (1, 2, 4):
            store.fold()
            assert store.newer() == []
            assert contents(store.read()) == newest(done)
    # Another session knows nothing but the folder.
    again = B.BatchStore(spark, str(tmp_path / "store"), SCHEMA, ["id"], ["version"], buckets=4)
    assert contents(again.read()) == newest(done)
    again.forget()
    assert B.numbered_folders(spark, again.path, B.BATCH) == [5]
    assert B.numbered_folders(spark, again.path, B.SNAPSHOT) == [4]
    assert contents(again.read()) == newest(done)


def test_snapshot_is_not_shuffled_and_folded_batches_are_not_read(spark, tmp_path):
    store = B.BatchStore(spark, str(tmp_path / "store"), SCHEMA, ["id"], ["version"], buckets=4)
    for batch in range(2):
        rows = [(str(i), batch, "x") for i in range(50)]
        store.run(land(spark, str(tmp_path / "in"), rows, SCHEMA), lambda df: df)
        if not batch:
            store.fold()
    df = store.read()
    files = df.inputFiles()
    assert all("snapshot=0" in f or "batch=1" in f for f in files) and any("snapshot=0" in f for f in files)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # The only shuffle is that of the batches; the snapshot is read by its buckets.
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    parts = {f.rpartition("_")[2][:5] for f in files if "snapshot=0" in f}
    assert parts == {f"0000{k}" for k in range(4)}
    store.fold()
    # Folding keeps one file for each bucket.
    assert len(store.read().inputFiles()) == 4


def test_a_fold_that_was_cut_off_is_done_again(spark, tmp_path):
    store = B.BatchStore(spark, str(tmp_path / "store"), SCHEMA, ["id"], ["version"], buckets=4)
    rows = [(str(i), 0, "x") for i in range(20)]
    store.run(land(spark, str(tmp_path / "in"), rows, SCHEMA), lambda df: df)
    left = tmp_path / "store" / "snapshot=0"
    left.mkdir()
    (left / "part-00000-x_00000.c000.snappy.parquet").write_bytes(b"half a file")
    assert contents(store.read()) == set(rows)
    store.fold()
    assert store.folded() == 0 and contents(store.read()) == set(rows)


EVENTS = StructType([StructField("id", INT), StructField("at", INT), StructField("what", STR)])


def test_first_of_key_keeps_late_rows(spark, tmp_path):
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    arrivals = [
        [(1, 50, "a"), (1, 40, "b"), (2, 10, "c")],
        [(1, 40, "again"), (3, 1, "late by far"), (1, 60, "later")],
        [(1, 5, "first after all"), (2, 10, "c"), (4, None, "no time"), (None, 3, "no key")],
    ]
    for rows in arrivals:
        # Every run starts a new query on the progress of the one before.
        stream = land(spark, source, rows, EVENTS)
        S.work_off(S.first_of_key(stream, ["id"], ["at", "what"]), sink, progress)
    given = {tuple(r) for r in spark.read.parquet(sink).collect()}
    assert given == {
        (1, 40, "b", False),
        (2, 10, "c", False),
        (1, 40, "again", True),
        (3, 1, "late by far", False),
        (1, 5, "first after all", True),
        (4, None, "no time", False),
        (None, 3, "no key", False),
    }
    # Files that are delivered once more add nothing.
    before = len(given)
    for rows in arrivals:
        stream = land(spark, source, rows, EVENTS)
        S.work_off(S.first_of_key(stream, ["id"], ["at", "what"]), sink, progress)
    assert spark.read.parquet(sink).count() == before


CHANGES = StructType(
    [
        StructField("id", INT),
        StructField("req", INT),
        StructField("label", STR),
        StructField("version", INT),
        StructField("deleted", BooleanType()),
    ]
)


def test_counts_follow_changes_and_deletions(spark, tmp_path):
    rng = random.Random(6)
    counts = S.RunningCounts(spark, str(tmp_path / "counts"), ["req", "label"])
    with pytest.raises(FileNotFoundError):
        counts.read()
    known = {}
    for batch in range(5):
        rows = []
        for i in rng.sample(range(80), 40):
            version = rng.choice([batch, batch, batch, max(0, batch - 2), None])
            rows.append((i, rng.choice([1, 2, None]), rng.choice(["x", "y", None]), version, rng.choice([False, None, True])))
        # Keys come once in a batch here, so the newest version is clear.
        for i, req, label, version, deleted in rows:
            if version is not None and (i not in known or version > known[i][0]):
                known[i] = (version, bool(deleted), req, label)
        counts.run(land(spark, str(tmp_path / "in"), rows, CHANGES), ["id"])
        if batch in (1, 3):
            counts.fold()
        want = Counter((req, label) for _, deleted, req, label in known.values() if not deleted)
        assert {(r["req"], r["label"]): r["n"] for r in counts.read().collect()} == dict(want)
    assert len(counts._parts()[2]) == 2


def test_deletion_wins_within_a_batch(spark, tmp_path):
    counts = S.RunningCounts(spark, str(tmp_path / "counts"), ["req", "label"])
    rows = [(1, 1, "x", 0, False), (1, 1, "x", 0, True), (2, 1, "x", 0, False), (2, 1, "y", 1, False)]
    counts.run(land(spark, str(tmp_path / "in"), rows, CHANGES), ["id"])
    assert [tuple(r) for r in counts.read().collect()] == [(1, "y", 1)]


def _worked_off(rows, checkpoint):
    """What a stateful stream gives, and the rows of its state."""
    given = []
    with S.rocksdb(rows.sparkSession):
        writer = rows.writeStream.foreachBatch(lambda df, _: given.extend(tuple(r) for r in df.collect()))
        running = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        running.awaitTermination()
    return given, running.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_state_is_asked_for_buckets_not_for_keys(spark, tmp_path):
    source, counted, firsts = (str(tmp_path / n) for n in ("in", "counted", "firsts"))
    landed = [
        [(i, i % 3, "x", 0, False) for i in range(600)],
        [(i, i % 3, "y" if i % 2 else "x", 1, i % 5 == 0) for i in range(300, 900)],
    ]
    stream = land(spark, source, landed[0], CHANGES)
    given, state = _worked_off(S.signed_rows(stream, ["id"], ["req", "label"], buckets=4), counted)
    assert Counter(given) == Counter((i % 3, "x", 1) for i in range(600)) and state <= 4
    first, state = _worked_off(S.first_of_key(stream, ["id"], ["version"], buckets=4), firsts)
    assert {r[:-1] for r in first} == set(landed[0]) and len(first) == 600 and state <= 4

    stream = land(spark, source, landed[1], CHANGES)
    given, state = _worked_off(S.signed_rows(stream, ["id"], ["req", "label"], buckets=4), counted)
    want = Counter()
    for i, req, label, _, deleted in landed[1]:
        if deleted or label == "y":
            want[(req, "x", -1)] += i < 600
        if not deleted and (label == "y" or i >= 600):
            want[(req, label, 1)] += 1
    assert Counter(given) == want and state <= 4
    first, state = _worked_off(S.first_of_key(stream, ["id"], ["version"], buckets=4), firsts)
    assert {r[:-1] for r in first} == set(landed[1][300:]) and len(first) == 300 and state <= 4


def test_keys_of_a_state_are_equal_as_those_of_a_group(spark, tmp_path):
    ddl = "number double, time timestamp, bytes binary, text string, at int"
    noon, nan = datetime(2024, 5, 1, 12), float("nan")
    keys = [(0.0, None, None, "a"), (nan, None, None, None), (None,) * 4, (None, None, None, "null"), (None, None, None, "")]
    keys += [(1.0, noon, None, 'a"b'), (1.0, noon.replace(microsecond=1), None, 'a"b'), (1.0, None, bytearray(b"\xff"), "a")]
    keys += [(1.0, None, bytearray(b"\xfe"), "a"), (None, None, None, "a")]
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for number in range(2):
        df = spark.createDataFrame([(*k, number) for k in keys] + [(-0.0, None, None, "a", number)], ddl)
        df.coalesce(1).write.mode("append").parquet(source)
        stream = I.read_stream(spark, source, df.schema)
        S.work_off(S.first_of_key(stream, ["number", "time", "bytes", "text"], ["at"], buckets=2), sink, progress)
        assert spark.read.parquet(sink).count() == len(keys)


def test_state_provider_is_put_back(spark):
    before = spark.conf.get(S.PROVIDER)
    with S.rocksdb(spark):
        assert spark.conf.get(S.PROVIDER) == S.ROCKSDB
    assert spark.conf.get(S.PROVIDER) == before
    assert spark.range(3).select(F.max("id")).first()[0] == 2

"""Life cycles against an automaton in plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from voxtally.operators.lifecycle import LEGAL_NEXT, LifeCycle
from voxtally.schemas import REQUEST_STATUSES

SCHEMA = "req_id int, status string, ts timestamp_ntz, event_id long"


def judged(events):
    """Illegal events and last states, event by event."""
    state, bad = {}, set()
    for req, status, ts, event in sorted((e for e in events if e[0] is not None), key=lambda e: (e[0], e[2], e[3])):
        now = state.setdefault(req, None)
        fine = status in REQUEST_STATUSES and (
            status == now or (status == "NEW" if now is None else status in LEGAL_NEXT[now])
        )
        if fine:
            state[req] = status
        else:
            bad.add((req, event, now, status if status in REQUEST_STATUSES else None))
    return bad, state


def table(spark, events):
    rows = [(r, s, t, e) for r, s, t, e in events]
    return spark.createDataFrame(rows, "req_id int, status string, t int, event_id long").select(
        "req_id", "status", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "event_id"
    )


def test_finalized_never_becomes_new_again(spark):
    life = ["NEW", "LOCKED", "FETCHED", "PREDICTED_MODEL", "FINALIZED", "NEW", "RESPONDED", "FAILED"]
    events = [(1, s, k, k) for k, s in enumerate(life)]
    found = LifeCycle(table(spark, events))
    assert {tuple(r) for r in found.violations().collect()} == {(1, 5, "FINALIZED", "NEW"), (1, 7, "RESPONDED", "FAILED")}
    assert {tuple(r) for r in found.states().collect()} == {(1, "RESPONDED")}


@pytest.mark.parametrize("chunk", [1, 7, 64, 65_536])
def test_chunks_of_any_size_agree(spark, chunk):
    rng = random.Random(chunk)
    steps = [*REQUEST_STATUSES, "UNKNOWN", None]
    # A third of all events are those of one request; times repeat.
    events = [
        (7 if rng.random() < 0.33 else rng.choice([*range(40), None]), rng.choice(steps), rng.randrange(300), e)
        for e in range(900)
    ]
    order = sorted(range(300))
    events += [(50, LEGAL[k % len(LEGAL)], order[k], 1000 + k) for k in range(200)]
    bad, state = judged(events)
    found = LifeCycle(table(spark, events), chunk=chunk)
    rows = [tuple(r) for r in found.violations().collect()]
    assert len(rows) == len(bad) and set(rows) == bad
    assert {tuple(r) for r in found.states().collect()} == set(state.items())


LEGAL = ["NEW", "LOCKED", "FETCHED", "PREPROCESSED", "PREDICTED_MODEL", "FINALIZED"]


def test_no_events(spark):
    found = LifeCycle(table(spark, []))
    assert found.violations().count() == found.states().count() == 0


def test_a_hot_request_is_spread_over_many_chunks(spark):
    events = spark.range(0, 40_000, 1, 8).select(
        F.lit(1).alias("req_id"),
        F.when(F.col("id") % 2 == 0, "NEW").otherwise("LOCKED").alias("status"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("event_id"),
    )
    found = LifeCycle(events, chunk=1000)
    sizes = [len(r["codes"]) for r in found.log.select("codes").collect()]
    assert max(sizes) <= 1000 and len(sizes) >= 40
    # From the second event on the request is locked, and no NEW is legal.
    assert found.violations().count() == 19_999
    assert found.violations().filter("state_before <> 'LOCKED' or state_asked <> 'NEW'").count() == 0


def test_keys_may_be_text(spark):
    events = [("a", "NEW", 1, 1), ("a", "FETCHED", 2, 2), ("b", "LOCKED", 1, 3)]
    df = spark.createDataFrame(events, "video string, status string, ts int, event_id long")
    found = LifeCycle(df, key="video")
    assert {tuple(r) for r in found.violations().collect()} == {("a", 2, "NEW", "FETCHED"), ("b", 3, None, "LOCKED")}

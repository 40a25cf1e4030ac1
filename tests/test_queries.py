"""Every registered query against its SQL, and what their plans must not contain."""

from __future__ import annotations

import pytest
from check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
PYTHON_ALLOWED = {"score_batches", "attach_predictions"}
# These run jobs of their own before they return.
EAGER = {"train_classifier", "csv_round_trip"} | {
    "incremental_preprocess",
    "deduplicated_stream",
    "streaming_label_counts",
    "snapshot_and_newer_batches",
    "first_events_of_stream",
    "label_counts_after_changes",
    "training_epochs",
}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, queries()[name], oracle_sql()[name], FOLDER) == []


@pytest.mark.parametrize("name", sorted(set(queries()) - EAGER))
def test_plan(spark, name):
    plan = queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan
    assert ("ArrowEvalPython" in plan) == (name in PYTHON_ALLOWED)


@pytest.mark.parametrize("name", ["request_sentiment_report", "prediction_backlog"])
def test_patterns_are_matched_once(spark, name):
    plan = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    # The link pattern is the first of the cleaning chain.
    assert plan.count("http[^") == 1


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries()["stratified_split"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "text:string" not in plan.split("Physical Plan")[1]
    plan = queries()["oldest_pending"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_training_keeps_the_best_candidate(spark):
    rows = queries()["train_classifier"](spark, FOLDER).collect()
    best = [r for r in rows if r.is_best]
    assert len(best) == 1 and best[0].f1_weighted == max(r.f1_weighted for r in rows)
    assert all(0 <= r.accuracy <= 1 for r in rows)


def test_entry(spark):
    assert entry(spark).count() > 0

"""Joins with a request that owns most comments: the hot partition is split."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxtally.operators import comments as C
from voxtally.operators import results as S
from voxtally.operators import sides
from voxtally.operators.profile import value_counts


@pytest.fixture
def small_thresholds(spark, monkeypatch):
    """What counts as too large, for one task or to broadcast, is set to the size of the test data."""
    monkeypatch.setattr(sides, "MAX_BROADCAST_ROWS", 100)
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def comments(spark):
    req = F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") % 900).cast("int"))
    text = F.concat(F.md5(F.col("id").cast("string")), F.sha2(F.col("id").cast("string"), 512))
    return spark.range(0, 60_000, 1, 8).select(
        F.col("id").cast("string").alias("comment_id"), req.alias("req_id"), text.alias("text")
    )


@pytest.fixture(scope="module")
def requests(spark):
    r = F.col("id").cast("int")
    return spark.range(900).select(
        r.alias("req_id"),
        F.col("id").alias("user_id"),
        F.concat(F.lit("u"), "id").alias("video_url"),
        F.when(r % 2 == 1, "FETCHED").otherwise("NEW").alias("status"),
    )


def final_plan(df):
    rows = len(df.collect())
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_semi_join_on_requests_is_split(spark, small_thresholds, comments, requests):
    expected = comments.filter("req_id % 2 = 1").count()
    rows, plan = final_plan(C.for_requests_in_status(comments, requests))
    assert rows == expected and "skew=true" in plan


def test_pending_reviews_are_split(spark, small_thresholds, comments, requests):
    queue = comments.withColumn("status", F.lit("PENDING"))
    raw = comments.select("comment_id", F.lit("v").alias("video_id"))
    rows, plan = final_plan(S.pending_reviews(queue, raw, requests))
    assert rows == 60_000 and "skew=true" in plan


def test_repeated_keys_on_the_finished_side_are_reduced_before_the_join(
    spark, small_thresholds, comments
):
    done = comments.select(F.lit("0").alias("comment_id"), "text").unionByName(
        comments.select(F.lit("3").alias("comment_id"), "text")
    )
    rows, plan = final_plan(C.unprocessed(comments, done))
    assert rows == 59_998 and "HashAggregate" in plan


def test_the_total_of_value_counts_reuses_the_counts(spark, comments):
    df = value_counts(comments, "req_id", order=False)
    rows, plan = final_plan(df)
    assert rows == 600 and "ReusedExchange" in plan.split("Initial Plan")[0]


def test_few_requests_leave_the_comments_where_they_are(spark, comments, requests):
    fetched = C.for_requests_in_status(comments, requests)
    plan = fetched._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan

"""How often an operator reads what it is given."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxtally.operators import groups as G
from voxtally.operators import results as S
from voxtally.operators import sides
from voxtally.operators import tables as M


@pytest.fixture
def counted(spark, tmp_path):
    """Makes a table of one partition that leaves a file whenever it is computed."""

    def make(df):
        folder = tmp_path / uuid.uuid4().hex
        folder.mkdir()
        place = str(folder)

        def read(batches):
            open(f"{place}/{uuid.uuid4().hex}", "w").close()
            yield from (pa.RecordBatch.from_arrays(b.columns, b.schema.names) for b in batches)

        return df.coalesce(1).mapInArrow(read, df.schema), lambda: len(list(folder.iterdir()))

    return make


def test_a_side_is_computed_once(spark, counted):
    side, passes = counted(spark.range(10))
    small = sides.bounded_broadcast(side)
    for _ in range(2):
        assert spark.range(20).join(small, "id").count() == 10
    assert passes() == 1


def test_a_settled_side_beyond_the_bound_is_written(spark, counted):
    side, passes = counted(spark.range(10))
    large = sides.settled(side, "side", max_rows=3)
    for _ in range(2):
        assert spark.range(20).join(large, "id").count() == 10
    # Once to see that it is large, once to write it.
    assert passes() == 2
    assert "broadcast" not in large._jdf.queryExecution().analyzed().toString()


def test_wide_rows_do_not_come_to_the_driver(spark):
    wide = spark.range(2).select(F.repeat(F.lit("x"), sides.MAX_ROW_BYTES + 1).alias("k"))
    assert sides.fetched_rows(wide) is None
    assert sides.fetched_rows(spark.range(0)).num_rows == 0


def test_split_reads_its_rows_three_times_at_most(spark, counted):
    rows, passes = counted(spark.range(300).select("id", (F.col("id") % 3).alias("label")))
    out = G.split_by_share(rows, ["label"], "id", 0.2)
    before = passes()
    assert out.filter("is_test").count() == 60
    # Counts per range, the rows of one range of each label, and then the comparison.
    assert before <= 2 and passes() == before + 1


def test_finalizing_reads_predictions_twice(spark, counted):
    given = spark.range(30).select(
        F.col("id").cast("string").alias("comment_id"),
        (F.col("id") % 3).cast("int").alias("req_id"),
        F.lit("x").alias("model_prediction"),
        F.lit(0.5).alias("model_confidence"),
    )
    predictions, passes = counted(given)
    requests, asked = counted(
        spark.range(3).select(
            F.col("id").cast("int").alias("req_id"), F.col("id").alias("user_id"), F.lit("PREDICTED_MODEL").alias("status")
        )
    )
    raw = given.select("comment_id", F.lit("t").alias("text_display"))
    due = S.finalizable(predictions, raw, requests)
    assert due.count() == 30
    assert passes() == 2 and asked() == 1


def test_upsert_computes_its_delta_once(spark, counted):
    delta, passes = counted(spark.range(5).select("id", F.lit("new").alias("text"), F.lit(1).alias("t")))
    old = spark.range(10).select("id", F.lit("old").alias("text"))
    new = M.upsert(old, delta, ["id"], ["text"], ["t"])
    assert new.filter("text = 'new'").count() == 5
    assert passes() == 1


def test_replacing_a_group_reads_requests_once(spark, counted):
    requests, passes = counted(spark.createDataFrame([(1, "u"), (2, "u"), (3, "w")], "req_id int, video_url string"))
    ddl = "comment_id string, video_id string, req_id int"
    old, stored = counted(spark.createDataFrame([("a", "v", 1), ("b", "v", 3), ("c", "q", 1)], ddl))
    delta = spark.createDataFrame([("d", "v", 2)], ddl)
    new = M.replace_group(old, delta, requests)
    assert {r["comment_id"] for r in new.collect()} == {"b", "c", "d"}
    assert passes() == 1 and stored() == 1

"""Nothing is lost: late rows, outer blanks, nested values, large sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.operators import groups as G
from voxtally.operators import profile as P
from voxtally.operators import sides
from voxtally.sources.files import read_labeled_csv, write_csv
from voxtally.streaming import incremental as I


def test_late_rows_stay(spark, tmp_path):
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for ids, day in (([1], "2024-01-30"), ([2, 1], "2024-01-01"), ([3], "2024-01-31")):
        df = spark.createDataFrame([(i, day) for i in ids], "id int, day string")
        df = df.select("id", F.col("day").cast("timestamp_ntz").alias("ts")).coalesce(1)
        df.write.mode("append").parquet(source)
        I.run_incremental(I.read_stream(spark, source, df.schema), lambda s: s, sink, progress)
    rows = I.read_first(spark, sink, ["id"], ["ts"]).collect()
    assert {r.id: r.ts.day for r in rows} == {1: 1, 2: 1, 3: 31}
    I.compact(spark, sink, str(tmp_path / "compacted"), ["id"], ["ts"])
    rows = spark.read.parquet(str(tmp_path / "compacted")).collect()
    assert {r.id: r.ts.day for r in rows} == {1: 30, 2: 1, 3: 31}


def test_csv_keeps_outer_blanks(spark, tmp_path):
    cells = ["  lead", "trail  ", "\ta\t", "x\n", '"quoted", comma', " "]
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(cells)], "id string, text string")
    write_csv(df, str(tmp_path / "csv"))
    back = read_labeled_csv(spark, str(tmp_path / "csv"))
    assert {r.id: r.text for r in back.collect()} == dict((str(i), c) for i, c in enumerate(cells))


def test_nested_values_are_told_apart(spark):
    lists = [["a, b"], ["a", "b"], ["null"], [None], ["a, b"], None]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, tags array<string>")
    assert sorted(r.id for r in G.drop_repeats(df, ["tags"], "id").collect()) == [0, 1, 2, 3, 5]
    assert P.duplicate_stats(df, ["tags"]).first()[0:3] is not None
    zeros = spark.createDataFrame([(1, 0.0), (2, -0.0), (3, 1.0)], "id int, x double")
    assert sorted(r.id for r in G.drop_repeats(zeros, ["x"], "id").collect()) == [1, 3]


def test_sides_are_counted_in_rows_and_bytes(spark, monkeypatch):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 100).alias("k"))
    assert "broadcast" in sides.bounded_broadcast(wide)._jdf.queryExecution().logical().toString()
    monkeypatch.setattr(sides, "MAX_BROADCAST_BYTES", 999)
    assert sides.bounded_broadcast(wide) is wide

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxtally.functions import labels as L
from voxtally.operators import labels as ops
from voxtally.sources import files


def column(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_normalize(spark):
    rows = [" Positive ", "SAD day", "suprise", "", None]
    assert column(spark, rows, L.normalize_label("c")) == ["positive", "sad day", "suprise", "", None]
    fixed = L.normalize_label("c", "capitalize", L.SPELLING_FIXES)
    assert column(spark, rows, fixed) == ["Positive", "Sad day", "Surprise", "", None]


def test_null_like_labels_are_dropped(spark):
    df = spark.createDataFrame([(x,) for x in ("nan", "None", " ", "", None, "ok")], "label string")
    assert [r.label for r in ops.drop_null_like_labels(df).collect()] == ["ok"]


def test_lookup_keeps_the_last_entry_and_does_not_multiply_rows(spark):
    mapping = spark.createDataFrame(
        [("joy ", "a", 1), ("joy", "b", 2), ("sad", "c", 3)], "sentiment string, class string, pos int"
    )
    df = spark.createDataFrame([(1, " joy"), (2, "odd"), (3, None)], "id int, s string")
    got = ops.lookup_label(df, "s", mapping, default="Neutral", position="pos")
    assert {r.id: r.emotion_class for r in got.collect()} == {1: "b", 2: "Neutral", 3: "Neutral"}
    assert [r.s for r in ops.unmapped_labels(df, "s", mapping).collect()] == ["odd"]


def test_columns_are_found_by_preference(spark):
    df = spark.createDataFrame([("x", "y", "z")], "cleaned_test string, text string, emotion string")
    got = ops.with_standard_columns(df)
    assert sorted(got.columns) == ["label", "text"] and got.first().text == "x"
    other = spark.createDataFrame([(1, "y")], "n int, body string")
    assert ops.resolve_column(other, ["text"], "string") == "body"
    assert ops.resolve_column(other, ["text"], "first") == "n"
    with pytest.raises(ValueError):
        ops.resolve_column(other, ["text"])


def test_names_of_classes(spark):
    parsed = L.parse_id2label(F.lit('{"id2label": {"0": "positive"}}'))
    assert column(spark, ["0", "7"], L.label_name(F.col("c").cast("int"), parsed)) == [
        "positive",
        "class_7",
    ]
    assert column(spark, ["0", "7"], L.label_name(F.col("c").cast("int"), {7: "x"})) == ["class_0", "x"]


def test_symbols(spark):
    assert column(spark, ["JOY", "odd", None], L.decorate_label("c")) == ["😊", "•", "•"]
    assert column(spark, ["NEW", "new"], L.decorate_status("c")) == ["🟡", "⚪"]


def test_confidence_rules(spark):
    number = F.col("c").cast("double")
    assert column(spark, ["0.5", "0.6", "0.7", None], L.is_low_confidence(number)) == [
        True,
        False,
        False,
        False,
    ]
    any_low = L.any_low_confidence([number, F.lit(0.9)], 0.7)
    assert column(spark, ["0.5", "0.7", None], any_low) == [True, False, False]
    fallback = L.confidence_fallback(F.lit("joy"), number)
    assert column(spark, ["0.49", "0.5"], fallback) == ["neutral", "joy"]


def test_verdicts(spark):
    got = column(spark, ["0.85", "0.75", "0.65", "0.1", None], L.accuracy_verdict(F.col("c").cast("double")))
    assert got == ["EXCELLENT", "GOOD", "ACCEPTABLE", "NEEDS MORE WORK", None]


def test_the_last_entry_of_an_annotation_file_wins(spark, tmp_path):
    for name, lines in (("a.csv", ["joy,first", '"two\nlines",x', "joy,second"]), ("b.csv", ["sad,s", "joy,third", "sad,t"])):
        (tmp_path / name).write_text("\n".join(["sentiment,class", *lines]) + "\n")
    mapping = files.read_annotations(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "joy"), (2, "sad"), (3, "two\nlines"), (4, "odd")], "id int, s string")
    got = ops.lookup_label(df, "s", mapping, position="position")
    assert {r.id: r.emotion_class for r in got.collect()} == {1: "third", 2: "t", 3: "x", 4: None}
    with pytest.raises(ValueError, match="no position"):
        ops.lookup_label(df, "s", mapping.drop("position"))
    # Entries that only say the same again are no trouble.
    same = spark.createDataFrame([("joy", "a"), ("joy ", "a")], "sentiment string, class string")
    assert ops.lookup_label(df, "s", same).filter("emotion_class = 'a'").count() == 1

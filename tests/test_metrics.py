"""Metrics against the published evaluation figures, and their corner cases."""

from __future__ import annotations

import pytest

from voxtally.functions.labels import SENTIMENTS
from voxtally.operators import metrics as M

# Rows are the truth; one matrix that gives every published figure.
GOLDEN = [[177, 16, 6], [4, 190, 6], [12, 38, 148]]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [
        (SENTIMENTS[i], SENTIMENTS[j])
        for i, line in enumerate(GOLDEN)
        for j, n in enumerate(line)
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, "truth string, predicted string")


def test_published_report(golden):
    report = {r.label: r for r in M.classification_report(M.outcome_counts(golden)).collect()}
    published = {
        "negative": (0.92, 0.89, 0.90, 199),
        "neutral": (0.78, 0.95, 0.86, 200),
        "positive": (0.93, 0.75, 0.83, 198),
    }
    for label, figures in published.items():
        r = report[label]
        assert (round(r.precision, 2), round(r.recall, 2), round(r.f1, 2), r.support) == figures


def test_published_totals(golden):
    counts = M.outcome_counts(golden)
    report = M.classification_report(counts)
    total = M.accuracy(counts).first()
    f1 = M.f1_scores(report).first()
    assert total.samples == 597 and round(total.accuracy, 3) == 0.863
    assert round(f1.f1_weighted, 3) == 0.862 and round(f1.f1_macro, 2) == 0.86
    averages = {r.average: r for r in M.average_scores(report).collect()}
    for r in averages.values():
        assert (round(r.precision, 2), round(r.recall, 2), round(r.f1, 2)) == (0.87, 0.86, 0.86)
    # Recall weighted by support is the accuracy.
    assert averages["weighted avg"].recall == pytest.approx(total.accuracy)


def test_confusion_matrix(golden):
    rows = M.confusion_matrix(M.outcome_counts(golden), SENTIMENTS).collect()
    assert {(r.truth_index, r.predicted_index): r.n for r in rows} == {
        (i, j): n for i, line in enumerate(GOLDEN) for j, n in enumerate(line)
    }
    assert sum(r.n for r in rows) == 597


def test_classes_without_rows_score_zero(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "a")], "truth string, predicted string")
    report = {r.label: r for r in M.classification_report(M.outcome_counts(df)).collect()}
    assert (report["b"].precision, report["b"].recall, report["b"].f1, report["b"].support) == (0, 0, 0, 0)
    assert (report["c"].precision, report["c"].recall, report["c"].f1, report["c"].support) == (0, 0, 0, 1)


def test_summary_per_file(golden):
    both = golden.selectExpr("'x' AS file", "*").union(golden.selectExpr("'y'", "truth", "truth"))
    got = {r.file: r for r in M.evaluation_summary(both, ["file"]).collect()}
    assert round(got["x"].accuracy, 3) == 0.863 and got["x"].verdict == "EXCELLENT"
    assert got["y"].accuracy == 1 and got["y"].f1_macro == 1 and got["y"].samples == 597
    assert [round(got["x"][f"f1_{c}"], 2) for c in ("negative", "neutral", "positive")] == [0.90, 0.86, 0.83]
    assert M.evaluation_summary(both, ["file"], labels=["absent"]).first().f1_absent == 0


def test_unknown_truth_is_wrong(spark):
    df = spark.createDataFrame([(None, "a"), ("a", "a")], "truth string, predicted string")
    assert M.misclassified(df).count() == 1

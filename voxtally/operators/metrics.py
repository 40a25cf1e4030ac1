"""Classification metrics.

Every figure comes from one table of counts per (truth, prediction): a single
aggregation over the rows, combined on the map side, after which only K x K
counts are left. ``by`` columns give the same figures per file or source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.labels import SENTIMENTS, accuracy_verdict


def outcome_counts(
    df: DataFrame, truth: str = "truth", predicted: str = "predicted", by: Sequence[str] = ()
) -> DataFrame:
    """Rows per (truth, prediction); the input of the other functions here."""
    return df.groupBy(
        *by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")
    ).agg(F.count("*").alias("n"))


def with_correct_flag(
    df: DataFrame, truth: str = "truth", predicted: str = "predicted", name: str = "correct"
) -> DataFrame:
    return df.withColumn(name, F.col(truth).eqNullSafe(F.col(predicted)))


def misclassified(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return df.filter(~F.col(truth).eqNullSafe(F.col(predicted)))


def _hits() -> Column:
    return F.when(F.col("truth").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(F.lit(0))


def accuracy(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    grouped = counts.groupBy(*by).agg(F.sum(_hits()).alias("_hits"), F.sum("n").alias("samples"))
    return grouped.select(
        *by, F.try_divide(F.col("_hits"), F.col("samples")).alias("accuracy"), "samples"
    )


def class_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The report with the hits of every class.

    Each count is booked once for its true and once for its predicted class, so no
    join is needed.
    """
    none = F.lit(0).cast("long")

    def booked_for(label: str, support: Column, predicted: Column, hits: Column) -> Column:
        return F.struct(
            F.col(label).alias("label"),
            support.alias("t"),
            predicted.alias("p"),
            hits.alias("h"),
        )

    booking = F.array(
        booked_for("truth", F.col("n"), none, _hits()),
        booked_for("predicted", none, F.col("n"), none),
    )
    booked = counts.select(*by, F.inline(booking)).filter(F.col("label").isNotNull())
    sums = booked.groupBy(*by, "label").agg(
        F.sum("t").alias("support"), F.sum("p").alias("_predicted"), F.sum("h").alias("_hits")
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("_hits"), F.col("_predicted")), zero)
    recall = F.coalesce(F.try_divide(F.col("_hits"), F.col("support")), zero)
    f1 = F.coalesce(
        F.try_divide(F.lit(2.0) * F.col("_hits"), F.col("_predicted") + F.col("support")), zero
    )
    return sums.select(
        *by,
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        "support",
        F.col("_hits").alias("hits"),
    )


def classification_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as truth or prediction.

    A figure whose denominator is 0 is 0.
    """
    return class_scores(counts, by).drop("hits")


def _mean(column: str, weighted: bool) -> Column:
    if not weighted:
        return F.avg(column)
    return F.try_divide(F.sum(F.col(column) * F.col("support")), F.sum("support"))


def average_scores(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The ``macro avg`` (plain mean) and ``weighted avg`` (by support) rows of a report."""
    scores = ("precision", "recall", "f1")
    kinds = {"macro avg": False, "weighted avg": True}
    means = [_mean(c, w).alias(f"{c}/{k}") for k, w in kinds.items() for c in scores]
    both = report.groupBy(*by).agg(*means, F.sum("support").alias("support"))
    rows = [
        F.struct(F.lit(k).alias("average"), *[F.col(f"{c}/{k}").alias(c) for c in scores])
        for k in kinds
    ]
    return both.select(*by, F.inline(F.array(*rows)), "support")


def f1_scores(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return report.groupBy(*by).agg(
        _mean("f1", True).alias("f1_weighted"), _mean("f1", False).alias("f1_macro")
    )


def confusion_matrix(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """All cells over a fixed label list, in its order, cells without rows being 0."""
    names = F.array(*[F.lit(x) for x in labels])
    cells = (
        counts.sparkSession.range(1)
        .select(F.posexplode(names).alias("truth_index", "truth"))
        .select("*", F.posexplode(names).alias("predicted_index", "predicted"))
    )
    filled = cells.join(counts, ["truth", "predicted"], "left")
    return filled.select(
        "truth_index",
        "predicted_index",
        "truth",
        "predicted",
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def confusion_table(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The matrix with one column per predicted label."""
    wide = confusion_matrix(counts, labels).groupBy("truth_index", "truth")
    return wide.pivot("predicted", list(labels)).agg(F.first("n")).drop("truth_index")


def per_class_confidence(
    df: DataFrame,
    truth: str = "truth",
    predicted: str = "predicted",
    confidence: str = "confidence",
) -> DataFrame:
    """Hits, rows, accuracy and mean confidence per true class."""
    hit = F.col(truth).eqNullSafe(F.col(predicted)).cast("int")
    return df.groupBy(F.col(truth).alias("label")).agg(
        F.sum(hit).alias("correct"),
        F.count("*").alias("total"),
        F.avg(hit).alias("accuracy"),
        F.avg(confidence).alias("avg_confidence"),
    )


def overall_confidence(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    return df.agg(F.avg(confidence).alias("avg_confidence"))


def evaluation_summary(
    df: DataFrame,
    by: Sequence[str],
    truth: str = "truth",
    predicted: str = "predicted",
    labels: Sequence[str] = SENTIMENTS,
) -> DataFrame:
    """One row per evaluated file: samples, accuracy, both F1 means, the F1 of each of
    ``labels`` (``f1_<label>``, 0 for a class the file does not have) and the verdict.

    The rows are read once. Per class and file the report keeps the hits as well, so
    nothing is joined.
    """
    report = class_scores(outcome_counts(df, truth, predicted, by), by)
    per_class = [
        F.coalesce(F.max(F.when(F.col("label") == x, F.col("f1"))), F.lit(0.0)).alias(f"f1_{x}") for x in labels
    ]
    summary = report.groupBy(*by).agg(
        F.sum("support").alias("samples"),
        F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
        _mean("f1", True).alias("f1_weighted"),
        _mean("f1", False).alias("f1_macro"),
        *per_class,
    )
    return summary.withColumn("verdict", accuracy_verdict("accuracy"))

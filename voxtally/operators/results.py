"""Final results, the review queue, and the figures reported per request."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtally.functions.labels import (
    EXPORT_BELOW,
    LABEL_DEFAULT_SYMBOL,
    LABEL_SYMBOLS,
    REVIEW_BELOW,
    TOP_LABEL_DEFAULT_SYMBOL,
    any_low_confidence,
    decorate_label,
    decorate_status,
    is_low_confidence,
)
from voxtally.operators.comments import predictions_with_text, unprocessed
from voxtally.operators.requests import requests_to_finalize
from voxtally.operators.sides import bounded_broadcast

# Fixed values -----------------------------------------------------------------
SOURCE_MODEL = "MODEL"
PENDING = "PENDING"
EXPORT_LIMIT = 1000
RECENT_SHOWN = 20
# ------------------------------------------------------------------------------


def finalizable(predictions: DataFrame, raw: DataFrame, requests: DataFrame) -> DataFrame:
    """Predictions of the requests that are to be finalised, with their text."""
    due = bounded_broadcast(requests_to_finalize(requests, predictions).select("req_id"))
    return predictions_with_text(predictions.join(due, "req_id", "left_semi"), raw)


def finalize(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows to add to the final results; comments that are in there already are left out."""
    fresh = rows if existing is None else unprocessed(rows, existing)
    return fresh.select(
        "comment_id",
        "req_id",
        F.col("model_prediction").alias("emotion_class"),
        F.lit(SOURCE_MODEL).alias("source"),
    )


def enqueue_review(
    rows: DataFrame, existing: DataFrame | None = None, threshold: float = REVIEW_BELOW
) -> DataFrame:
    """Rows to add to the review queue: uncertain predictions with their text."""
    unsure = rows.filter(is_low_confidence("model_confidence", threshold))
    fresh = unsure if existing is None else unprocessed(unsure, existing)
    return fresh.select(
        "comment_id",
        "req_id",
        F.col("text_display").alias("text"),
        "model_prediction",
        F.col("model_confidence").alias("confidence"),
        F.lit(PENDING).alias("status"),
    )


def pending_only(queue: DataFrame) -> DataFrame:
    return queue.filter(F.col("status") == PENDING)


def pending_reviews(queue: DataFrame, raw: DataFrame, requests: DataFrame) -> DataFrame:
    """Open reviews with the video they belong to and the user who asked.

    Rows are put in order by the caller; a view over this table is read filtered
    more often than whole.
    """
    return (
        pending_only(queue)
        .join(raw.select("comment_id", "video_id"), "comment_id", "left")
        .join(bounded_broadcast(requests.select("req_id", "user_id", "video_url")), "req_id", "left")
        .drop("status")
    )


def review_order(df: DataFrame, *tie_breakers: str) -> DataFrame:
    """Least certain first, rows without a confidence last."""
    return df.orderBy(F.col("confidence").asc_nulls_last(), *tie_breakers)


def review_export(
    queue: DataFrame, preprocessed: DataFrame, limit: int | None = None
) -> DataFrame:
    """The least certain open reviews with the cleaned text and a column to label in.

    The limit is applied before the cleaned text is looked up: it depends on the
    queue alone, and the join cannot add or remove rows.
    """
    rows = review_order(pending_only(queue), "comment_id")
    rows = rows if limit is None else rows.limit(limit)
    cleaned = preprocessed.select("comment_id", F.col("text_unicode").alias("cleaned_text"))
    joined = rows.join(cleaned, "comment_id", "left")
    return add_blank_label(
        joined.select("comment_id", "text", "cleaned_text", "model_prediction", "confidence"),
        "manual_label",
    )


def review_queue_file(queue: DataFrame) -> DataFrame:
    """Columns of the review file: all open reviews with an empty label."""
    rows = pending_only(queue).select(
        "req_id",
        "comment_id",
        "text",
        F.col("model_prediction").alias("prediction"),
        "confidence",
        "status",
    )
    return add_blank_label(review_order(rows, "comment_id"), "label")


def low_confidence_export(
    predictions: DataFrame,
    preprocessed: DataFrame,
    confidences: Sequence[str] = ("model_confidence",),
    threshold: float = EXPORT_BELOW,
    limit: int | None = None,
) -> DataFrame:
    """Predictions below the threshold in any confidence column, with cleaned text."""
    cleaned = preprocessed.select("comment_id", F.col("text_unicode").alias("cleaned_text"))
    unsure = predictions.filter(any_low_confidence(confidences, threshold))
    joined = unsure.join(cleaned, "comment_id").select(
        "comment_id", "req_id", "model_prediction", *confidences, "cleaned_text"
    )
    if limit is not None:
        first = [F.col(c).asc_nulls_last() for c in confidences]
        joined = joined.orderBy(*first, "comment_id").limit(limit)
    return add_blank_label(joined, "manual_label")


def add_blank_label(df: DataFrame, name: str = "label") -> DataFrame:
    """An empty column for annotators to fill in."""
    return df.withColumn(name, F.lit(""))


def recent_predictions(predictions: DataFrame, raw: DataFrame, n: int = RECENT_SHOWN) -> DataFrame:
    """The newest predictions of comments that still exist, with the text."""
    known = predictions.join(raw.select("comment_id"), "comment_id", "left_semi")
    newest = known.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(n)
    return predictions_with_text(newest, raw).select(
        "req_id",
        F.col("text_display").alias("original_text"),
        "model_prediction",
        "model_confidence",
        "created_at",
    )


def label_counts(df: DataFrame, by: Sequence[str] = ("req_id",), label: str = "emotion_class") -> DataFrame:
    return df.groupBy(*by, label).agg(F.count("*").alias("n"))


def label_shares(counts: DataFrame, by: Sequence[str] = ("req_id",)) -> DataFrame:
    """Share in percent, to one decimal, of each count ``n`` within its request.

    The window runs over the counted labels, a handful of rows per request.
    """
    total = F.sum("n").over(Window.partitionBy(*by))
    share = F.round(F.col("n") * F.lit(100.0).cast("decimal(4,1)") / total, 1)
    return counts.withColumn("percentage", share.cast("double"))


def request_label_stats(
    results: DataFrame, by: Sequence[str] = ("req_id",), label: str = "emotion_class"
) -> DataFrame:
    """Rows and share of every label per request."""
    return label_shares(label_counts(results, by, label), by)


def top_label_per_request(
    results: DataFrame, by: Sequence[str] = ("req_id",), label: str = "emotion_class"
) -> DataFrame:
    """Most frequent label per request with its share; equal counts go by name."""
    counts = label_counts(results, by, label)
    best = F.min_by(F.struct(label, "n"), F.struct(-F.col("n"), F.col(label))).alias("_top")
    grouped = counts.groupBy(*by).agg(best, F.sum("n").alias("total"))
    share = F.round(F.col("_top.n") * F.lit(100.0).cast("decimal(4,1)") / F.col("total"), 1)
    return grouped.select(
        *by,
        F.col(f"_top.{label}").alias("top_label"),
        F.col("_top.n").alias("top_count"),
        share.cast("double").alias("top_percent"),
        "total",
    )


def total_per_request(df: DataFrame, by: Sequence[str] = ("req_id",), name: str = "total") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def result_message(
    results: DataFrame,
    symbols: Mapping[str, str] = LABEL_SYMBOLS,
    label: str = "emotion_class",
) -> DataFrame:
    """The text a user gets about a finished request.

    Only counted labels are gathered per request, never comments.
    """
    counts = label_counts(results, ("req_id",), label)
    entry = F.struct((-F.col("n")).alias("order"), F.col(label).alias("label"))
    grouped = counts.groupBy("req_id").agg(
        F.sum("n").alias("total"), F.sort_array(F.collect_list(entry)).alias("entries")
    )
    top = F.col("entries")[0]
    percent = F.round(-top["order"] * F.lit(100.0).cast("decimal(4,1)") / F.col("total"), 1)
    lines = F.transform(
        "entries",
        lambda e: F.concat(
            decorate_label(e["label"], symbols, LABEL_DEFAULT_SYMBOL),
            F.lit(" "),
            e["label"],
            F.lit(": "),
            (-e["order"]).cast("string"),
            F.lit(" comments"),
        ),
    )
    message = F.concat(
        F.lit("✅ Analysis Complete!\n\nRequest #"),
        F.col("req_id").cast("string"),
        F.lit(" has been processed.\n\n📝 "),
        F.col("total").cast("string"),
        F.lit(" comments analyzed\n"),
        decorate_label(top["label"], symbols, TOP_LABEL_DEFAULT_SYMBOL),
        F.lit(" Top emotion: "),
        top["label"],
        F.lit(" ("),
        (-top["order"]).cast("string"),
        F.lit(" comments, "),
        percent.cast("decimal(5,1)").cast("string"),
        F.lit("%)\n\n📊 Full breakdown:\n"),
        F.array_join(lines, "\n"),
        F.lit("\n\nUse /status_"),
        F.col("req_id").cast("string"),
        F.lit(" to view detailed results."),
    )
    return grouped.select("req_id", message.alias("message"))


def status_message(requests_with_count: DataFrame) -> DataFrame:
    """The short text that answers a question for the state of a request."""
    return requests_with_count.select(
        "req_id",
        F.concat(
            decorate_status("status"),
            F.lit(" Request #"),
            F.col("req_id").cast("string"),
            F.lit("\nStatus: "),
            F.col("status"),
            F.lit("\nComments: "),
            F.col("comment_count").cast("string"),
        ).alias("message"),
    )


def training_export(training: DataFrame) -> DataFrame:
    """Labelled training rows, newest first."""
    rows = training.filter(F.col("label").isNotNull())
    rows = rows.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
    return rows.select("comment_text", "label", "source", "confidence", "created_at")

"""From landed comments to text that a model can read."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions import text as T
from voxtally.functions.charsets import BURMESE
from voxtally.operators.groups import top_n_per_group
from voxtally.operators.sides import bounded_broadcast
from voxtally.schemas import COMMENT_PAGE_DDL

# Fixed values -----------------------------------------------------------------
PROCESSED_BY = "base_model"
REJECT_NULL, REJECT_SCRIPT, REJECT_SHORT = "NULL_TEXT", "NOT_SCRIPT", "TOO_SHORT"
# ------------------------------------------------------------------------------


def flatten_comment_pages(
    pages: DataFrame,
    json: str = "body",
    video: str = "video_id",
    page: str = "page",
    max_per_video: int | None = None,
) -> DataFrame:
    """Response pages to one row per comment, all of them unless ``max_per_video`` is given.

    With it the first comments in page order are kept, as when paging stops at the limit.
    """
    parsed = pages.select(video, page, F.from_json(json, COMMENT_PAGE_DDL).alias("_body"))
    items = parsed.select(video, page, F.posexplode("_body.items").alias("position", "_item"))
    top = F.col("_item.snippet.topLevelComment")
    flat = items.select(
        video,
        page,
        "position",
        top["id"].alias("comment_id"),
        top["snippet"]["textDisplay"].alias("text_display"),
    )
    if max_per_video is None:
        return flat
    order = [F.col(page), F.col("position")]
    return top_n_per_group(flat, [video], order, max_per_video, spread=F.struct(page, "position"))


def preprocess(
    df: DataFrame,
    text: str = "text_display",
    ranges: str = BURMESE,
    keep: str = BURMESE,
    min_ratio: float = 0.3,
    min_length: int = 5,
    rules: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Add ``text_unicode``, ``tokens``, ``token_count`` and ``reject_reason``.

    Rejected rows stay, with the reason and without text, so that they count as
    seen and are not read again in every run. Cleaning only runs on rows that
    pass the script filter, and the cleaned text comes out of a generator: a later
    filter on the outcome then cannot be moved below it, where the patterns would
    be matched a second time.
    """
    source = F.col(text)
    in_script = T.is_script(source, ranges, min_ratio)
    cleaned = F.when(in_script, T.clean_text(T.apply_rewrite_rules(source, rules), keep))
    staged = df.select("*", F.explode(F.array(cleaned)).alias("_clean"))
    long_enough = F.col("_clean").isNotNull() & T.has_min_length("_clean", min_length)
    reason = (
        F.when(long_enough, F.lit(None).cast("string"))
        .when(F.col("_clean").isNotNull(), F.lit(REJECT_SHORT))
        .when(source.isNull(), F.lit(REJECT_NULL))
        .otherwise(F.lit(REJECT_SCRIPT))
    )
    staged = staged.withColumn("text_unicode", F.when(long_enough, F.col("_clean")))
    return (
        staged.withColumn("reject_reason", reason)
        .withColumn("tokens", T.tokenize("text_unicode"))
        .withColumn("token_count", F.when(F.col("tokens").isNotNull(), F.size("tokens")))
        .drop("_clean")
    )


def accepted(df: DataFrame) -> DataFrame:
    """Rows of :func:`preprocess` that passed."""
    return df.filter(F.col("reject_reason").isNull())


def preprocessed_rows(df: DataFrame, by: str = PROCESSED_BY, at: Column | None = None) -> DataFrame:
    """Accepted rows of :func:`preprocess` with who made them and when (now, if that is not given).

    With ``tables.as_rows_of`` they are rows of the table of preprocessed comments.
    """
    at = F.current_timestamp() if at is None else at
    made = accepted(df).withColumn("processed_by", F.lit(by))
    return made.withColumn("processed_at", at.cast("timestamp_ntz"))


def unprocessed(source: DataFrame, done: DataFrame, key: str = "comment_id") -> DataFrame:
    """Rows whose key the finished table does not have yet.

    The finished side is reduced to its distinct keys first; this uses the same
    shuffle as the join and takes the weight off keys that occur often.
    """
    return source.join(done.select(key).distinct(), key, "left_anti")


def for_requests_in_status(
    df: DataFrame, requests: DataFrame, status: str | Sequence[str] = "FETCHED"
) -> DataFrame:
    """Rows that belong to a request in one of the given states.

    Such requests are few as a rule; their ids then go to the comments and not the
    comments to the requests.
    """
    wanted = [status] if isinstance(status, str) else list(status)
    ids = requests.filter(F.col("status").isin(wanted)).select("req_id")
    return df.join(bounded_broadcast(ids), "req_id", "left_semi")


def preprocessing_backlog(
    raw: DataFrame, requests: DataFrame, *done: DataFrame, status: str = "FETCHED"
) -> DataFrame:
    """Comments of fetched requests that were neither accepted nor rejected yet."""
    pending = for_requests_in_status(raw, requests, status)
    return reduce(unprocessed, done, pending)


def prediction_backlog(
    preprocessed: DataFrame, raw: DataFrame, predictions: DataFrame
) -> DataFrame:
    """Preprocessed comments that still exist and have no prediction.

    Keys decide first; the texts take part in one join.
    """
    open_keys = unprocessed(raw.select("comment_id"), predictions)
    return preprocessed.join(open_keys, "comment_id", "left_semi")


def predictions_with_text(predictions: DataFrame, raw: DataFrame) -> DataFrame:
    """Predictions next to the text they were made for."""
    return predictions.join(raw.select("comment_id", "text_display"), "comment_id")


def take_batch(df: DataFrame, n: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """The whole backlog, or its first ``n`` rows where a run has to stay small."""
    if n is None:
        return df
    if not order:
        raise ValueError("a limited batch needs an order, else it differs from run to run")
    return df.orderBy(*order).limit(n)


def fetched_for_export(raw: DataFrame, requests: DataFrame) -> DataFrame:
    """Comments of fetched requests, oldest first."""
    fetched = for_requests_in_status(raw, requests, "FETCHED")
    return fetched.select("req_id", "comment_id", "text_display", "scraped_at").orderBy(
        F.col("scraped_at").asc_nulls_last(), "comment_id"
    )

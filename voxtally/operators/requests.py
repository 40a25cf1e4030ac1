"""The life of a request: submission, state, and what a user sees of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.functions.urls import extract_video_id, is_video_url
from voxtally.operators.groups import top_n_per_group
from voxtally.schemas import ACTIVE_STATUSES, REQUEST_STATUSES

# Fixed values -----------------------------------------------------------------
REQUESTS_SHOWN = 5
# ------------------------------------------------------------------------------


def current_status(
    events: DataFrame, key: str = "req_id", status: str = "status", order: Sequence[str] = ("ts", "event_id")
) -> DataFrame:
    """State of every request: that of its latest life-cycle event."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status))


def oldest_pending(requests: DataFrame, n: int = 1, status: str = "NEW") -> DataFrame:
    """The ``n`` requests that have waited longest."""
    waiting = requests.filter(F.col("status") == status)
    return waiting.orderBy(F.col("created_at").asc_nulls_last(), "req_id").limit(n)


def has_new(requests: DataFrame, status: str = "NEW") -> DataFrame:
    """One row that tells whether any request is waiting; stops at the first one."""
    return (
        requests.filter(F.col("status") == status)
        .limit(1)
        .agg((F.count("*") > 0).alias("has_new"))
    )


def valid_submissions(submissions: DataFrame, url: str = "video_url") -> DataFrame:
    """Submitted addresses that point at a video, with its id."""
    found = submissions.filter(is_video_url(url))
    # Out of a generator, so that the filter on it does not extract a second time.
    found = found.select("*", F.explode(F.array(extract_video_id(url))).alias("video_id"))
    return found.filter(F.col("video_id").isNotNull())


def latest_requests_per_user(requests: DataFrame, n: int = REQUESTS_SHOWN) -> DataFrame:
    """The newest ``n`` requests of every user."""
    order = [F.col("created_at").desc_nulls_last(), F.col("req_id").desc()]
    return top_n_per_group(requests, ["user_id"], order, n)


def request_status_with_count(requests: DataFrame, raw: DataFrame) -> DataFrame:
    """Every request with the number of its comments, 0 included.

    Comments are counted before the join, so a request with very many of them
    joins as a single row.
    """
    counts = raw.groupBy("req_id").agg(F.count("comment_id").alias("comment_count"))
    joined = requests.join(counts, "req_id", "left")
    return joined.withColumn("comment_count", F.coalesce("comment_count", F.lit(0)))


def requests_to_finalize(requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predicted requests that have at least one prediction, with their user."""
    predicted = predictions.filter(F.col("model_prediction").isNotNull()).select("req_id").distinct()
    waiting = requests.filter(F.col("status") == "PREDICTED_MODEL").select("req_id", "user_id")
    return waiting.join(predicted, "req_id", "left_semi")


def status_summary(
    requests: DataFrame, all_statuses: bool = False, statuses: Sequence[str] = REQUEST_STATUSES
) -> DataFrame:
    """Requests per state; with ``all_statuses`` also the states that none is in."""
    counts = requests.groupBy("status").agg(F.count("*").alias("requests"))
    if not all_statuses:
        return counts
    known = requests.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    joined = known.join(counts, "status", "left")
    return joined.withColumn("requests", F.coalesce("requests", F.lit(0)))


def transition(
    requests: DataFrame,
    ids: DataFrame,
    to: str,
    only_from: Sequence[str] | None = None,
) -> DataFrame:
    """The requests table after moving the given requests to another state.

    ``only_from`` guards the move: requests in any other state stay as they are.
    """
    if to not in REQUEST_STATUSES:
        raise ValueError(f"unknown status: {to}")
    hit = ids.select("req_id").distinct().withColumn("_hit", F.lit(True))
    moves = F.col("_hit").isNotNull()
    if only_from is not None:
        moves = moves & F.col("status").isin(*only_from)
    moved = requests.join(hit, "req_id", "left")
    moved = moved.withColumn("status", F.when(moves, F.lit(to)).otherwise(F.col("status")))
    return moved.select(*requests.columns)


def fully_predicted(
    requests: DataFrame, backlog: DataFrame, predictions: DataFrame
) -> DataFrame:
    """Requests with predictions and nothing left to predict."""
    done = predictions.select("req_id").distinct()
    done = done.join(backlog.select("req_id").distinct(), "req_id", "left_anti")
    return requests.select("req_id").join(done, "req_id", "left_semi")


def mark_predicted(
    requests: DataFrame, backlog: DataFrame, predictions: DataFrame
) -> DataFrame:
    """The requests table after fetched requests with nothing left to predict moved on."""
    done = fully_predicted(requests, backlog, predictions)
    return transition(requests, done, "PREDICTED_MODEL", only_from=["FETCHED"])


def mark_finalized(requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """The requests table after the requests that are to be finalised moved on."""
    done = requests_to_finalize(requests, predictions)
    return transition(requests, done, "FINALIZED", only_from=["PREDICTED_MODEL"])


def fail_unusable(
    requests: DataFrame,
    raw: DataFrame,
    only_from: Sequence[str] = ("LOCKED",),
    url: str = "video_url",
) -> DataFrame:
    """The requests table after requests without a video or without comments have failed."""
    taken = requests.filter(F.col("status").isin(*only_from)).select(
        "req_id", extract_video_id(url).isNull().alias("_invalid")
    )
    filled = raw.select("req_id").distinct()
    empty = taken.filter(~F.col("_invalid")).join(filled, "req_id", "left_anti")
    failed = taken.filter("_invalid").unionByName(empty)
    return transition(requests, failed, "FAILED", only_from=only_from)


def _active(requests: DataFrame, statuses: Sequence[str]) -> DataFrame:
    active = requests.filter(F.col("status").isin(*statuses))
    return active.groupBy("user_id", "video_url").agg(
        F.min_by(F.struct("req_id", "status"), "req_id").alias("_existing")
    )


def route_submissions(
    requests: DataFrame, submissions: DataFrame, active: Sequence[str] = ACTIVE_STATUSES
) -> DataFrame:
    """What happens to each submitted (user, address) pair, once per pair.

    ``existing_req_id`` and ``existing_status`` name the active request the user
    is referred to; they are NULL where a new request is to be made, which then
    carries the time of the earliest submission.
    """
    asked = submissions.groupBy("user_id", "video_url").agg(F.min("created_at").alias("created_at"))
    joined = asked.join(_active(requests, active), ["user_id", "video_url"], "left")
    return joined.select(
        "user_id",
        "video_url",
        "created_at",
        F.col("_existing.req_id").alias("existing_req_id"),
        F.col("_existing.status").alias("existing_status"),
    )


def new_requests(
    requests: DataFrame, submissions: DataFrame, active: Sequence[str] = ACTIVE_STATUSES
) -> DataFrame:
    """Requests to insert, without ids; ``tables.as_rows_of`` gives those."""
    routed = route_submissions(requests, submissions, active)
    fresh = routed.filter(F.col("existing_req_id").isNull())
    return fresh.select("user_id", "video_url", F.lit("NEW").alias("status"), "created_at")

"""Requests, backlogs, results and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.functions.labels import LABEL_DEFAULT_SYMBOL, LABEL_SYMBOLS, STATUS_SYMBOLS
from voxtally.functions.labels import TOP_LABEL_DEFAULT_SYMBOL
from voxtally.operators import comments as C
from voxtally.operators import groups as G
from voxtally.operators import requests as R
from voxtally.operators import results as S
from voxtally.operators import tables as M
from voxtally.operators.lifecycle import LEGAL_NEXT, LifeCycle
from voxtally.plans.bindings import STATUS_OF_EVENT, WATCH, sql_case
from voxtally.plans.registry import query
from voxtally.schemas import FINAL_RESULTS, REQUESTS, REVIEW_QUEUE


def _shown(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _sql_shown(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


@query("current_status", "SELECT CAST(req_id AS BIGINT) AS req_id, status FROM requests", ["requests"])
def current_status(t):
    return R.current_status(t.life_cycle())


_LEGAL = ", ".join(f"('{a}', '{b}')" for a, nexts in LEGAL_NEXT.items() for b in nexts)
# Every event in turn, with the state before it and the one it leads to.
_LIFE = f"""
    WITH RECURSIVE e AS (
        SELECT user_id AS req_id, event_id, {sql_case("event_type", STATUS_OF_EVENT)} AS status,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r
        FROM events),
    legal(before, after) AS (VALUES {_LEGAL}),
    life AS (
        SELECT req_id, event_id, r, CAST(NULL AS VARCHAR) AS before, status,
               CASE WHEN status = 'NEW' THEN status END AS state
        FROM e WHERE r = 1
        UNION ALL
        SELECT e.req_id, e.event_id, e.r, life.state, e.status,
               CASE WHEN (life.state IS NULL AND e.status = 'NEW') OR e.status = life.state
                         OR EXISTS (SELECT 1 FROM legal WHERE before = life.state AND after = e.status)
                    THEN e.status ELSE life.state END
        FROM life JOIN e ON e.req_id = life.req_id AND e.r = life.r + 1)"""


@query(
    "illegal_transitions",
    f"""{_LIFE}
    SELECT req_id, event_id, before AS state_before, status AS state_asked
    FROM life WHERE state IS DISTINCT FROM status""",
)
def illegal_transitions(t):
    return LifeCycle(t.life_cycle()).violations()


@query(
    "legal_status",
    f"""{_LIFE}
    SELECT req_id, max_by(state, r) AS status FROM (
        SELECT req_id, r, coalesce(state, '') AS state FROM life)
    GROUP BY req_id""",
)
def legal_status(t):
    return LifeCycle(t.life_cycle()).states().withColumn("status", F.coalesce("status", F.lit("")))


@query(
    "oldest_pending",
    f"""SELECT req_id, video_url, {_sql_shown("created_at")} AS created_at FROM submissions
        WHERE status = 'NEW' ORDER BY submissions.created_at, req_id LIMIT 25""",
    ["submissions"],
)
def oldest_pending(t):
    return R.oldest_pending(t.submissions, 25).select("req_id", "video_url", _shown("created_at"))


@query("has_new", "SELECT count(*) > 0 AS has_new FROM requests WHERE status = 'NEW'", ["requests"])
def has_new(t):
    return R.has_new(t.requests)


@query(
    "latest_requests_per_user",
    f"""SELECT user_id, req_id, video_url, status, {_sql_shown("created_at")} AS created_at
        FROM (SELECT *, row_number() OVER (
                  PARTITION BY user_id ORDER BY created_at DESC, req_id DESC) AS r
              FROM submissions)
        WHERE r <= 5""",
    ["submissions"],
)
def latest_requests_per_user(t):
    rows = R.latest_requests_per_user(t.submissions)
    return rows.select("user_id", "req_id", "video_url", "status", _shown("created_at"))


_WITH_COUNT = """
    SELECT r.req_id, r.video_url, r.status, count(c.comment_id) AS comment_count
    FROM requests r LEFT JOIN raw_comments c ON r.req_id = c.req_id
    GROUP BY r.req_id, r.video_url, r.status"""


@query("request_status_with_count", _WITH_COUNT, ["requests", "raw_comments"])
def request_status_with_count(t):
    rows = R.request_status_with_count(t.requests, t.raw_comments)
    return rows.select("req_id", "video_url", "status", "comment_count")


@query(
    "status_message",
    f"""SELECT req_id, {sql_case("status", STATUS_SYMBOLS, "⚪")} || ' Request #' || req_id
               || chr(10) || 'Status: ' || status || chr(10) || 'Comments: ' || comment_count
               AS message
        FROM ({_WITH_COUNT})""",
    ["requests", "raw_comments"],
)
def status_message(t):
    return S.status_message(R.request_status_with_count(t.requests, t.raw_comments))


@query("status_summary", "SELECT status, count(*) AS requests FROM requests GROUP BY status", ["requests"])
def status_summary(t):
    return R.status_summary(t.requests)


@query(
    "status_summary_all",
    """SELECT s.status, count(r.req_id) AS requests
       FROM (VALUES ('NEW'), ('LOCKED'), ('FETCHED'), ('PREPROCESSED'), ('PREDICTED_MODEL'),
                    ('FINALIZED'), ('RESPONDED'), ('FAILED')) AS s(status)
       LEFT JOIN requests r ON r.status = s.status GROUP BY s.status""",
    ["requests"],
)
def status_summary_all(t):
    return R.status_summary(t.requests, all_statuses=True)


@query(
    "requests_to_finalize",
    """SELECT DISTINCT p.req_id, r.user_id FROM predictions p JOIN requests r ON p.req_id = r.req_id
       WHERE r.status = 'PREDICTED_MODEL' AND p.model_prediction IS NOT NULL""",
    ["predictions", "requests"],
)
def requests_to_finalize(t):
    return R.requests_to_finalize(t.requests, t.predictions)


@query(
    "transition_requests",
    """SELECT req_id, user_id, video_url,
              CASE WHEN status = 'FETCHED' AND req_id IN (SELECT req_id FROM predictions)
                   THEN 'PREDICTED_MODEL' ELSE status END AS status
       FROM requests""",
    ["requests", "predictions"],
)
def requests_moved(t):
    moved = R.transition(t.requests, t.predictions, "PREDICTED_MODEL", only_from=["FETCHED"])
    return moved.drop("created_at")


# Comments with a label, and those of requests with a large event, have a prediction.
_LEFT = """
    SELECT p.req_id FROM preprocessed_comments p
    WHERE p.comment_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)
      AND p.req_id NOT IN (SELECT user_id FROM events WHERE value > 200)"""


def _left(t):
    made = t.given("labels").select(F.col("doc_id").cast("string").alias("comment_id"))
    ready = t.given("events").filter("value > 200").select(F.col("user_id").alias("req_id")).distinct()
    of_ready = t.raw_comments.join(ready, "req_id", "left_semi").select("comment_id")
    return C.prediction_backlog(t.preprocessed_comments, t.raw_comments, made.union(of_ready))


@query(
    "fully_predicted_requests",
    f"""SELECT req_id FROM requests r
       WHERE req_id IN (SELECT req_id FROM predictions)
         AND req_id NOT IN ({_LEFT})""",
    ["requests", "predictions", "preprocessed_comments"],
)
def fully_predicted_requests(t):
    return R.fully_predicted(t.requests, _left(t), t.predictions)


@query(
    "requests_after_prediction",
    f"""SELECT req_id, user_id, video_url,
              CASE WHEN status = 'FETCHED' AND req_id IN (SELECT req_id FROM predictions)
                        AND req_id NOT IN ({_LEFT})
                   THEN 'PREDICTED_MODEL' ELSE status END AS status
        FROM requests""",
    ["requests", "predictions", "preprocessed_comments"],
)
def requests_after_prediction(t):
    return R.mark_predicted(t.requests, _left(t), t.predictions).drop("created_at")


@query(
    "requests_after_finalizing",
    """SELECT req_id, user_id, video_url,
              CASE WHEN status = 'PREDICTED_MODEL' AND req_id IN (
                        SELECT req_id FROM predictions WHERE model_prediction IS NOT NULL)
                   THEN 'FINALIZED' ELSE status END AS status
       FROM requests""",
    ["requests", "predictions"],
)
def requests_after_finalizing(t):
    return R.mark_finalized(t.requests, t.predictions).drop("created_at")


_SITE = WATCH.removesuffix("watch?v=")


@query(
    "unusable_requests_failed",
    f"""SELECT req_id, user_id, video_url,
              CASE WHEN status = 'LOCKED' AND (video_url = '{_SITE}'
                        OR req_id NOT IN (SELECT req_id FROM raw_comments))
                   THEN 'FAILED' ELSE status END AS status
        FROM (SELECT * REPLACE (CASE WHEN video_url = '{WATCH}error' THEN '{_SITE}' ELSE video_url END
                                AS video_url) FROM requests)""",
    ["requests", "raw_comments"],
)
def unusable_requests_failed(t):
    # Some addresses lose their video.
    url = F.when(F.col("video_url") == WATCH + "error", F.lit(_SITE)).otherwise(F.col("video_url"))
    return R.fail_unusable(t.requests.withColumn("video_url", url), t.raw_comments).drop("created_at")


_RUN_AT, _SECONDS = "2024-06-01 12:00:00", "yyyy-MM-dd HH:mm:ss"


def _sql_number(key: str) -> str:
    """Numbers from 1 in the seeded order of a key."""
    return f"row_number() OVER (ORDER BY md5('0:' || {key}), {key})"


_ROUTED = """
    SELECT s.user_id, s.video_url, min(s.created_at) AS created_at, min(r.req_id) AS existing_req_id
    FROM submissions s LEFT JOIN requests r ON r.user_id = s.user_id AND r.video_url = s.video_url
         AND r.status IN ('NEW', 'LOCKED', 'FETCHED')
    GROUP BY s.user_id, s.video_url"""


@query(
    "route_submissions",
    f"""SELECT user_id, video_url, {_sql_shown("created_at")} AS created_at, existing_req_id,
               (SELECT status FROM requests q WHERE q.req_id = existing_req_id) AS existing_status
        FROM ({_ROUTED}) x""",
    ["submissions", "requests"],
)
def submissions_routed(t):
    routed = R.route_submissions(t.requests, t.submissions)
    return routed.select(
        "user_id", "video_url", _shown("created_at"), "existing_req_id", "existing_status"
    )


@query(
    "insert_if_absent",
    f"""SELECT req_id, user_id, video_url, status, {_sql_shown("created_at")} AS created_at FROM (
            SELECT req_id, user_id, video_url, status, created_at FROM requests UNION ALL
            SELECT CAST((SELECT max(req_id) FROM requests) + {_sql_number("user_id || ' ' || video_url")}
                        AS INTEGER), user_id, video_url, 'NEW', created_at FROM ({_ROUTED})
            WHERE existing_req_id IS NULL)""",
    ["submissions", "requests"],
)
def requests_with_new(t):
    fresh = R.new_requests(t.requests, t.submissions)
    last = G.next_id_start(t.requests, "req_id")
    fresh = M.as_rows_of(REQUESTS, fresh, ["user_id", "video_url"], after=last)
    both = t.requests.select("req_id", "user_id", "video_url", "status", _shown("created_at"))
    return both.unionByName(
        fresh.select("req_id", "user_id", "video_url", "status", _shown("created_at"))
    )


# Backlogs ---------------------------------------------------------------------
@query(
    "unprocessed_comments",
    """SELECT comment_id, req_id FROM raw_comments
       WHERE comment_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""",
    ["raw_comments"],
)
def unprocessed_comments(t):
    done = t.given("labels").select(F.col("doc_id").cast("string").alias("comment_id"))
    return C.unprocessed(t.raw_comments, done).select("comment_id", "req_id")


@query(
    "comments_of_fetched_requests",
    """SELECT comment_id, req_id, text_display FROM raw_comments
       WHERE req_id IN (SELECT req_id FROM requests WHERE status = 'FETCHED')""",
    ["raw_comments", "requests"],
)
def comments_of_fetched_requests(t):
    rows = C.for_requests_in_status(t.raw_comments, t.requests)
    return rows.select("comment_id", "req_id", "text_display")


@query(
    "preprocessing_backlog",
    """SELECT comment_id, req_id FROM raw_comments
       WHERE req_id IN (SELECT req_id FROM requests WHERE status = 'FETCHED')
         AND comment_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""",
    ["raw_comments", "requests"],
)
def preprocessing_backlog(t):
    done = t.given("labels").select(F.col("doc_id").cast("string").alias("comment_id"))
    rows = C.preprocessing_backlog(t.raw_comments, t.requests, done)
    return rows.select("comment_id", "req_id")


@query(
    "first_backlog_batch",
    """SELECT comment_id, req_id FROM raw_comments
       WHERE req_id IN (SELECT req_id FROM requests WHERE status = 'FETCHED')
       ORDER BY scraped_at, comment_id LIMIT 500""",
    ["raw_comments", "requests"],
)
def first_backlog_batch(t):
    rows = C.preprocessing_backlog(t.raw_comments, t.requests)
    return C.take_batch(rows, 500, ["scraped_at", "comment_id"]).select("comment_id", "req_id")


@query(
    "prediction_backlog",
    """SELECT p.comment_id, p.req_id, p.text_unicode FROM preprocessed_comments p
       JOIN raw_comments USING (comment_id)
       WHERE p.comment_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""",
    ["preprocessed_comments", "raw_comments"],
)
def prediction_backlog(t):
    made = t.given("labels").select(F.col("doc_id").cast("string").alias("comment_id"))
    rows = C.prediction_backlog(t.preprocessed_comments, t.raw_comments, made)
    return rows.select("comment_id", "req_id", "text_unicode")


@query(
    "predictions_with_text",
    """SELECT p.comment_id, p.model_prediction, p.model_confidence, r.text_display
       FROM predictions p JOIN raw_comments r USING (comment_id)""",
    ["predictions", "raw_comments"],
)
def predictions_with_text(t):
    rows = C.predictions_with_text(t.predictions, t.raw_comments)
    return rows.select("comment_id", "model_prediction", "model_confidence", "text_display")


@query(
    "fetched_for_export",
    f"""SELECT c.req_id, c.comment_id, c.text_display, {_sql_shown("scraped_at")} AS scraped_at
        FROM raw_comments c JOIN requests r ON r.req_id = c.req_id WHERE r.status = 'FETCHED'""",
    ["raw_comments", "requests"],
)
def fetched_for_export(t):
    rows = C.fetched_for_export(t.raw_comments, t.requests)
    return rows.select("req_id", "comment_id", "text_display", _shown("scraped_at"))


# Results ----------------------------------------------------------------------
_DUE = """
    SELECT p.*, c.text_display FROM predictions p JOIN raw_comments c USING (comment_id)
    WHERE p.req_id IN (SELECT req_id FROM requests WHERE status = 'PREDICTED_MODEL')
      AND p.req_id IN (SELECT req_id FROM predictions WHERE model_prediction IS NOT NULL)"""
_DONE = "SELECT CAST(doc_id AS VARCHAR) FROM labels"


@query(
    "finalize_results",
    f"""SELECT CAST((SELECT max(doc_id) FROM labels) + {_sql_number("comment_id")} AS INTEGER) AS id,
               comment_id, req_id, model_prediction AS emotion_class, 'MODEL' AS source,
               '{_RUN_AT}' AS created_at
        FROM ({_DUE}) WHERE comment_id NOT IN ({_DONE})""",
    ["predictions", "raw_comments", "requests"],
)
def results_finalized(t):
    existing = t.given("labels").select(F.col("doc_id").cast("string").alias("comment_id"))
    last = G.next_id_start(t.given("labels"), "doc_id")
    new = M.as_rows_of(FINAL_RESULTS, S.finalize(t.finalizable(), existing), ["comment_id"], last, F.lit(_RUN_AT))
    return new.withColumn("created_at", F.date_format("created_at", _SECONDS))


@query(
    "enqueue_review",
    f"""SELECT CAST((SELECT max(doc_id) FROM labels) + {_sql_number("comment_id")} AS INTEGER) AS id,
               comment_id, req_id, text_display AS text, model_prediction,
               model_confidence AS confidence, 'PENDING' AS status, '{_RUN_AT}' AS created_at
        FROM ({_DUE}) WHERE model_confidence < 0.6 AND comment_id NOT IN ({_DONE})""",
    ["predictions", "raw_comments", "requests"],
)
def review_enqueued(t):
    existing = t.given("labels").select(F.col("doc_id").cast("string").alias("comment_id"))
    last = G.next_id_start(t.given("labels"), "doc_id")
    new = M.as_rows_of(REVIEW_QUEUE, S.enqueue_review(t.finalizable(), existing), ["comment_id"], last, F.lit(_RUN_AT))
    return new.withColumn("created_at", F.date_format("created_at", _SECONDS))


_STATS = """
    SELECT req_id, emotion_class, count(*) AS n,
           CAST(round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY req_id), 1) AS DOUBLE)
           AS percentage
    FROM final_results GROUP BY req_id, emotion_class"""


@query("request_label_stats", _STATS, ["final_results"])
def request_label_stats(t):
    return S.request_label_stats(t.final_results)


_TOP = f"""
    SELECT req_id, emotion_class AS top_label, n AS top_count, percentage AS top_percent,
           CAST(sum_n AS BIGINT) AS total
    FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY n DESC, emotion_class) AS r,
                 sum(n) OVER (PARTITION BY req_id) AS sum_n
          FROM ({_STATS}))
    WHERE r = 1"""


@query("top_label_per_request", _TOP, ["final_results"])
def top_label_per_request(t):
    return S.top_label_per_request(t.final_results)


@query(
    "predictions_per_request",
    "SELECT req_id, count(*) AS prediction_count FROM predictions GROUP BY req_id",
    ["predictions"],
)
def predictions_per_request(t):
    return S.total_per_request(t.predictions, name="prediction_count")


@query(
    "result_message",
    f"""
    WITH stats AS ({_STATS}), top AS ({_TOP}),
    lines AS (
        SELECT req_id, string_agg({sql_case("emotion_class", LABEL_SYMBOLS, LABEL_DEFAULT_SYMBOL)}
               || ' ' || emotion_class || ': ' || n || ' comments', chr(10)
               ORDER BY n DESC, emotion_class) AS body
        FROM stats GROUP BY req_id)
    SELECT req_id, '✅ Analysis Complete!' || chr(10) || chr(10) || 'Request #' || req_id
           || ' has been processed.' || chr(10) || chr(10) || '📝 ' || total || ' comments analyzed'
           || chr(10) || {sql_case("top_label", LABEL_SYMBOLS, TOP_LABEL_DEFAULT_SYMBOL)}
           || ' Top emotion: ' || top_label || ' (' || top_count || ' comments, '
           || CAST(CAST(top_percent AS DECIMAL(5,1)) AS VARCHAR) || '%)' || chr(10) || chr(10)
           || '📊 Full breakdown:' || chr(10) || body || chr(10) || chr(10)
           || 'Use /status_' || req_id || ' to view detailed results.' AS message
    FROM top JOIN lines USING (req_id)""",
    ["final_results"],
)
def result_message(t):
    return S.result_message(t.final_results)


@query(
    "recent_predictions",
    f"""SELECT req_id, text_display AS original_text, model_prediction, model_confidence,
               {_sql_shown("created_at")} AS created_at
        FROM (SELECT p.*, c.text_display FROM predictions p JOIN raw_comments c USING (comment_id)
              ORDER BY p.created_at DESC, p.id DESC LIMIT 20)""",
    ["predictions", "raw_comments"],
)
def recent_predictions(t):
    rows = S.recent_predictions(t.predictions, t.raw_comments)
    return rows.withColumn("created_at", _shown("created_at"))


# Reviews ----------------------------------------------------------------------
@query(
    "pending_reviews",
    f"""SELECT q.id, q.comment_id, q.req_id, q.text, q.model_prediction, q.confidence,
               c.video_id, r.user_id, r.video_url, {_sql_shown("q.created_at")} AS created_at
        FROM review_queue q LEFT JOIN raw_comments c USING (comment_id)
        LEFT JOIN requests r ON q.req_id = r.req_id WHERE q.status = 'PENDING'""",
    ["review_queue", "raw_comments", "requests"],
)
def pending_reviews(t):
    rows = S.pending_reviews(t.review_queue, t.raw_comments, t.requests)
    return rows.withColumn("created_at", _shown("created_at"))


@query(
    "review_export",
    """SELECT q.comment_id, q.text, p.text_unicode AS cleaned_text, q.model_prediction, q.confidence,
              '' AS manual_label
       FROM review_queue q LEFT JOIN preprocessed_comments p USING (comment_id)
       WHERE q.status = 'PENDING' ORDER BY q.confidence, q.comment_id LIMIT 1000""",
    ["review_queue", "preprocessed_comments"],
)
def review_export(t):
    return S.review_export(t.review_queue, t.preprocessed_comments, limit=S.EXPORT_LIMIT)


@query(
    "review_queue_file",
    """SELECT req_id, comment_id, text, model_prediction AS prediction, confidence, status, '' AS label
       FROM review_queue WHERE status = 'PENDING'""",
    ["review_queue"],
)
def review_queue_file(t):
    return S.review_queue_file(t.review_queue)


@query(
    "low_confidence_export",
    """SELECT p.comment_id, p.req_id, p.model_prediction, p.model_confidence,
              c.text_unicode AS cleaned_text, '' AS manual_label
       FROM predictions p JOIN preprocessed_comments c USING (comment_id)
       WHERE p.model_confidence < 0.7 ORDER BY p.model_confidence, p.comment_id LIMIT 1000""",
    ["predictions", "preprocessed_comments"],
)
def low_confidence_export(t):
    return S.low_confidence_export(t.predictions, t.preprocessed_comments, limit=S.EXPORT_LIMIT)


@query(
    "training_export",
    f"""SELECT d.text AS comment_text, l.label, d.source, p.model_confidence AS confidence,
               {_sql_shown("p.created_at")} AS created_at
        FROM documents d JOIN labelled l USING (doc_id) JOIN predictions p ON p.id = d.doc_id
        WHERE l.label IS NOT NULL""",
    ["labelled", "predictions"],
)
def training_export(t):
    scores = t.predictions.select(
        F.col("id"), F.col("model_confidence").alias("confidence"), "created_at"
    )
    training = t.labelled.withColumnRenamed("text", "comment_text").join(
        scores, F.col("doc_id") == F.col("id")
    )
    return S.training_export(training).withColumn("created_at", _shown("created_at"))

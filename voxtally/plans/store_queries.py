"""Table changes, files, and incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxtally.operators import tables as M
from voxtally.operators.comments import accepted, preprocess, preprocessed_rows
from voxtally.operators.labels import lookup_label
from voxtally.operators.membership import KeyStore
from voxtally.operators.results import label_shares
from voxtally.plans.bindings import ACCENTS, LATIN, MIN_RATIO
from voxtally.plans.registry import query
from voxtally.schemas import PREPROCESSED_COMMENTS
from voxtally.session import shared_folder
from voxtally.sources.files import read_annotations, read_labeled_csv, write_csv
from voxtally.streaming import incremental as I
from voxtally.streaming import state as S
from voxtally.streaming.batches import BatchStore


# Changes ----------------------------------------------------------------------
@query(
    "upsert_comments",
    """
    WITH stored AS (SELECT doc_id, 'stored' AS video_id, text AS body FROM labelled),
    delta AS (
        SELECT conv_id AS doc_id, role AS video_id, text AS body FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
            FROM conversations)
        WHERE r = 1)
    SELECT coalesce(s.doc_id, d.doc_id) AS comment_id, coalesce(s.video_id, d.video_id) AS video_id,
           coalesce(d.body, s.body) AS text_display
    FROM stored s FULL JOIN delta d ON s.doc_id = d.doc_id""",
    ["labelled"],
)
def comments_upserted(t):
    stored = t.labelled.select(
        F.col("doc_id").alias("comment_id"),
        F.lit("stored").alias("video_id"),
        F.col("text").alias("text_display"),
    )
    # A comment that is scraped several times arrives as several turns.
    delta = t.given("conversations").select(
        F.col("conv_id").alias("comment_id"),
        F.col("role").alias("video_id"),
        F.col("text").alias("text_display"),
        "turn",
    )
    return M.upsert(stored, delta, ["comment_id"], ["text_display"], latest_by=["turn"])


@query(
    "replace_comments_of_video",
    f"""
    WITH requests_of_comments AS (
        SELECT req_id, video_url, status FROM requests),
    stored AS (
        SELECT comment_id, split_part(q.video_url, '=', 2) AS video_id, c.req_id, text_display
        FROM raw_comments c JOIN requests_of_comments q USING (req_id)),
    delta AS (
        SELECT 'again-' || s.comment_id AS comment_id, s.video_id, s.req_id, s.text_display
        FROM stored s JOIN requests_of_comments q USING (req_id) WHERE q.status = 'LOCKED')
    SELECT * FROM stored s
    WHERE NOT EXISTS (
        SELECT 1 FROM delta d JOIN requests_of_comments q ON d.req_id = q.req_id
        WHERE d.video_id = s.video_id AND s.req_id IN (
            SELECT o.req_id FROM requests_of_comments o WHERE o.video_url = q.video_url))
    UNION ALL SELECT * FROM delta""",
    ["requests", "raw_comments"],
)
def comments_of_video_replaced(t):
    requests = t.requests
    video = F.split_part("video_url", F.lit("="), F.lit(2))
    stored = t.raw_comments.drop("video_id").join(requests, "req_id")
    stored = stored.withColumn("video_id", video)
    again = stored.filter(F.col("status") == "LOCKED")
    columns = ["comment_id", "video_id", "req_id", "text_display"]
    delta = again.withColumn("comment_id", F.concat(F.lit("again-"), "comment_id")).select(*columns)
    return M.replace_group(stored.select(*columns), delta, requests)


_FAILED = "SELECT req_id FROM requests WHERE status = 'FAILED'"


@query(
    "cascade_delete",
    f"""SELECT comment_id, req_id, emotion_class FROM final_results WHERE comment_id NOT IN (
            SELECT comment_id FROM raw_comments WHERE req_id IN ({_FAILED}))""",
    ["requests", "raw_comments", "final_results"],
)
def deleted_in_cascade(t):
    gone = t.requests.filter(F.col("status") == "FAILED")
    comments = t.raw_comments.join(gone.select("req_id"), "req_id", "left_semi")
    rows = M.cascade_delete(t.final_results, comments, "comment_id", "comment_id")
    return rows.select("comment_id", "req_id", "emotion_class")


@query(
    "set_null_delete",
    f"""SELECT id, CASE WHEN req_id NOT IN ({_FAILED}) THEN comment_id END AS comment_id, req_id, status
        FROM review_queue""",
    ["requests", "review_queue"],
)
def deleted_with_null(t):
    gone = t.requests.filter(F.col("status") == "FAILED")
    comments = t.raw_comments.join(gone.select("req_id"), "req_id", "left_semi")
    rows = M.cascade_delete(t.review_queue, comments, "comment_id", "comment_id", "set_null")
    return rows.select("id", "comment_id", "req_id", "status")


def _after_requests(t):
    """The store after failed requests, two levels above results and reviews, are deleted."""
    store = {
        "requests": t.requests,
        "raw_comments": t.raw_comments,
        "final_results": t.final_results,
        "review_queue": t.review_queue,
    }
    return M.cascade(store, "requests", t.requests.filter(F.col("status") == "FAILED"))


@query(
    "results_after_requests",
    f"""SELECT comment_id, req_id, emotion_class FROM final_results WHERE comment_id NOT IN (
            SELECT comment_id FROM raw_comments WHERE req_id IN ({_FAILED}))""",
    ["requests", "raw_comments", "final_results"],
)
def results_after_requests(t):
    return _after_requests(t)["final_results"].select("comment_id", "req_id", "emotion_class")


@query(
    "reviews_after_requests",
    f"""SELECT id, CASE WHEN req_id NOT IN ({_FAILED}) THEN comment_id END AS comment_id, req_id, status
        FROM review_queue""",
    ["requests", "review_queue"],
)
def reviews_after_requests(t):
    return _after_requests(t)["review_queue"].select("id", "comment_id", "req_id", "status")


@query(
    "export_for_annotation",
    """SELECT c.text_display AS text, '' AS label FROM raw_comments c
       JOIN requests r ON r.req_id = c.req_id WHERE r.status = 'FETCHED'""",
    ["raw_comments", "requests"],
)
def exported_for_annotation(t):
    return M.export_and_mark(t.raw_comments, t.requests)[0]


@query(
    "requests_after_export",
    """SELECT req_id, user_id, video_url,
              CASE WHEN status = 'FETCHED' AND req_id IN (SELECT req_id FROM raw_comments)
                   THEN 'FAILED' ELSE status END AS status
       FROM requests""",
    ["raw_comments", "requests"],
)
def requests_after_export(t):
    return M.export_and_mark(t.raw_comments, t.requests)[1].drop("created_at")


# Files ------------------------------------------------------------------------
@query(
    "csv_round_trip",
    """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role,
              nullif(text, '') AS text
       FROM conversations""",
)
def csv_round_trip(t):
    path = shared_folder(t.spark, "csv")
    write_csv(t.given("conversations"), path)
    return read_labeled_csv(t.spark, path)


# Incremental runs -------------------------------------------------------------
def _stream(t, name: str):
    # The braces make it a pattern: it then may stand for a file or for a folder of files.
    path = f"{t.folder}/{{{name}}}.parquet"
    return I.read_stream(t.spark, path, t.given(name).schema)


def _comments(stream, *more: str):
    return stream.select(
        F.col("doc_id").cast("string").alias("comment_id"),
        F.substr("source", F.lit(4)).cast("int").alias("req_id"),
        F.col("text").alias("text_display"),
        *more,
    )


@query(
    "incremental_preprocess",
    "SELECT comment_id, req_id, text_unicode FROM preprocessed_comments",
    ["preprocessed_comments"],
)
def preprocessed_incrementally(t):
    def stage(batch):
        rows = preprocess(_comments(batch), ranges=ACCENTS, keep=LATIN, min_ratio=MIN_RATIO)
        # Rejected rows count as seen, but what was read of them is not needed again.
        return rows.select("comment_id", "req_id", "text_unicode", "reject_reason")

    sink = shared_folder(t.spark, "preprocessed")
    I.run_incremental(_stream(t, "documents"), stage, sink, shared_folder(t.spark, "progress"))
    rows = accepted(t.spark.read.parquet(sink))
    return rows.select("comment_id", "req_id", "text_unicode")


@query(
    "deduplicated_stream",
    "SELECT event_id, user_id, event_type FROM events",
)
def stream_deduplicated(t):
    sink = shared_folder(t.spark, "events")
    # The same events arrive in two runs; the second brings all of them late.
    for _ in range(2):
        I.run_incremental(
            _stream(t, "events"),
            lambda s: s.select("event_id", "user_id", "event_type", "ts"),
            sink,
            shared_folder(t.spark, "progress"),
        )
    return I.read_first(t.spark, sink, ["event_id"], ["ts"]).drop("ts")


@query(
    "streaming_label_counts",
    """SELECT CAST(substr(source, 4) AS INTEGER) AS req_id, lang AS label, count(*) AS n
       FROM documents GROUP BY ALL""",
)
def labels_counted_in_stream(t):
    labelled = _stream(t, "documents").select(
        F.substr("source", F.lit(4)).cast("int").alias("req_id"), F.col("lang").alias("label")
    )
    sink = shared_folder(t.spark, "counts")
    by = ["req_id", "label"]
    I.run_label_counts(labelled, by, sink, shared_folder(t.spark, "progress"))
    return I.read_label_counts(t.spark, by, sink)


# Stores that are read while they grow ---------------------------------------------
def _arrivals(t, rows, purpose: str):
    """Lands the rows by their column ``arrival``, one after another, and yields the stream of what has landed.

    The rows are computed once.
    """
    staged, landing = shared_folder(t.spark, f"{purpose}-staged"), shared_folder(t.spark, f"{purpose}-landed")
    rows.write.partitionBy("arrival").parquet(staged)
    schema = rows.drop("arrival").schema
    arrivals = sorted(r[0] for r in t.spark.read.parquet(staged).select("arrival").distinct().collect())
    for arrival in arrivals:
        t.spark.read.schema(schema).parquet(f"{staged}/arrival={arrival}").write.mode("append").parquet(landing)
        yield I.read_stream(t.spark, landing, schema)


@query(
    "snapshot_and_newer_batches",
    "SELECT comment_id, req_id, text_unicode FROM preprocessed_comments",
    ["preprocessed_comments"],
)
def preprocessed_in_snapshots(t):
    # A comment comes as an empty draft, then as it is, and then once more as an old version
    # in capitals, in three of four batches; the draft and the old version must not win.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4)).cast("int")
    versions = F.explode(F.array(F.lit(0), F.lit(2), F.lit(1))).alias("version")
    rows = t.documents.select("doc_id", "source", "text", part.alias("part"), versions)
    moved = F.when(F.col("version") == 0, -1).when(F.col("version") == 1, 1).otherwise(0)
    text = F.when(F.col("version") == 2, F.col("text")).when(F.col("version") == 1, F.upper("text"))
    rows = rows.select("doc_id", "source", text.alias("text"), "version", (F.col("part") + moved).alias("arrival"))
    rows = rows.filter("arrival between 0 and 3")

    def stage(batch):
        made = preprocess(_comments(batch, "version"), ranges=ACCENTS, keep=LATIN, min_ratio=MIN_RATIO)
        return made.select("comment_id", "req_id", "text_unicode", "reject_reason", "version")

    schema = "comment_id string, req_id int, text_unicode string, reject_reason string, version int"
    store = BatchStore(
        t.spark, shared_folder(t.spark, "snapshots"), StructType.fromDDL(schema), ["comment_id"], ["version"], buckets=8
    )
    for number, stream in enumerate(_arrivals(t, rows, "comments")):
        store.run(stream, stage)
        if number in (1, 2):
            store.fold()
    return accepted(store.read()).select("comment_id", "req_id", "text_unicode")


@query(
    "first_events_of_stream",
    """SELECT user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (
           SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events)
       WHERE r = 1""",
)
def first_events(t):
    # The events of afternoons arrive first, then all of them, most of these late, and then all again.
    late = F.when(F.hour("ts") >= 12, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2)))
    rows = t.events.select("user_id", "event_type", "event_id", "ts", F.explode(late).alias("arrival"))
    sink, progress = shared_folder(t.spark, "firsts"), shared_folder(t.spark, "progress")
    key, order = ["user_id", "event_type"], ["ts", "event_id"]
    for stream in _arrivals(t, rows, "events"):
        S.work_off(S.first_of_key(stream, key, order), sink, progress)
    first = I.read_first(t.spark, sink, key, order)
    return first.select(*key, "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(
    "label_counts_after_changes",
    """
    WITH kept AS (
        SELECT c.req_id, CASE WHEN d.n_chars >= 1500 THEN 'long' ELSE d.lang END AS label
        FROM documents d JOIN raw_comments c ON c.comment_id = CAST(d.doc_id AS VARCHAR)
        WHERE c.req_id NOT IN (SELECT req_id FROM requests WHERE status = 'FAILED')),
    counted AS (SELECT req_id, label, count(*) AS n FROM kept GROUP BY ALL)
    SELECT req_id, label, n, CAST(round(n * 100.0 / sum(n) OVER (PARTITION BY req_id), 1) AS DOUBLE) AS percentage
    FROM counted""",
    ["raw_comments", "requests"],
)
def labels_after_changes(t):
    # All comments are labelled, then long ones get another label, and those of failed requests
    # are deleted in cascade, while the first labels arrive once more.
    docs = t.documents.select(
        "doc_id", F.substr("source", F.lit(4)).cast("int").alias("req_id"), "lang", (F.col("n_chars") >= 1500).alias("long")
    )
    failed = t.requests.filter("status = 'FAILED'").select("req_id", F.lit(True).alias("gone"))
    docs = docs.join(failed, "req_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    change = lambda arrival, version, label, deleted: F.struct(
        F.lit(arrival).alias("arrival"), F.lit(version).alias("version"), label.alias("label"), F.lit(deleted).alias("deleted")
    )
    steps = F.array(
        change(0, 0, F.col("lang"), False),
        F.when(F.col("long"), change(1, 1, F.lit("long"), False)),
        F.when(F.col("gone"), change(2, 2, F.lit(None).cast("string"), True)),
        change(2, 0, F.col("lang"), False),
    )
    rows = docs.select("doc_id", "req_id", F.explode(steps).alias("c")).filter("c is not null")
    counts = S.RunningCounts(t.spark, shared_folder(t.spark, "counts"), ["req_id", "label"])
    for number, stream in enumerate(_arrivals(t, rows.select("doc_id", "req_id", "c.*"), "changes")):
        counts.run(stream, ["doc_id"])
        if number == 1:
            counts.fold()
    return label_shares(counts.read())


@query(
    "unprocessed_with_filter",
    """SELECT comment_id, req_id FROM raw_comments
       WHERE comment_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""",
    ["raw_comments"],
)
def unprocessed_with_filter(t):
    # Finished comments come in three batches, two of which are folded.
    store = KeyStore(t.spark, shared_folder(t.spark, "finished"), buckets=16, words=1 << 10)
    done = t.given("labels").select(F.col("doc_id").cast("string").alias("comment_id"))
    part = F.pmod(F.xxhash64("comment_id"), F.lit(3))
    for number in range(3):
        store.add(done.filter(part == number), number)
        if number == 1:
            store.fold()
    return store.unprocessed(t.raw_comments).select("comment_id", "req_id")


@query(
    "preprocessed_table_rows",
    """SELECT comment_id, req_id, text_unicode, array_to_string(tokens, ' ') AS tokens, 'base_model' AS processed_by,
              '2024-06-01 12:00:00' AS processed_at
       FROM preprocessed_comments""",
    ["preprocessed_comments"],
)
def preprocessed_as_table(t):
    at = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    rows = M.as_rows_of(PREPROCESSED_COMMENTS, preprocessed_rows(t.all_preprocessed, at=at), ["comment_id"], at=at)
    shown = F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss")
    return rows.withColumns({"tokens": F.array_join("tokens", " "), "processed_at": shown})


@query(
    "lookup_label_of_file",
    """WITH last AS (
           SELECT role AS sentiment, arg_max(CAST(conv_id AS VARCHAR), conv_id * 1000 + turn) AS class
           FROM conversations GROUP BY role)
       SELECT c.conv_id, c.turn, l.class AS emotion_class
       FROM conversations c LEFT JOIN last l ON c.role = l.sentiment""",
)
def label_looked_up_in_file(t):
    # An annotation file in several parts that lists its keys again and again.
    turns = t.given("conversations")
    listed = turns.repartitionByRange(3, "conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    path = shared_folder(t.spark, "annotations")
    write_csv(listed.select(F.col("role").alias("sentiment"), F.col("conv_id").alias("class")), path)
    mapping = read_annotations(t.spark, path)
    return lookup_label(turns.select("conv_id", "turn", "role"), "role", mapping, position="position").drop("role")

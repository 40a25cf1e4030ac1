"""Changes to tables, requests, results, files, catalogue and streams."""

from __future__ import annotations

import uuid
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.operators import comments as C
from voxtally.operators import requests as R
from voxtally.operators import results as S
from voxtally.operators import tables as M
from voxtally.operators.comments import flatten_comment_pages
from voxtally.operators.features import encode_fixed_length, index_labels, vocabulary
from voxtally.operators.scoring import score_batches, score_linear
from voxtally.schemas import TABLES
from voxtally.session import shared_folder
from voxtally.sources import catalog, files, jdbc
from voxtally.streaming import incremental as I


def rows(df):
    return {tuple(r) for r in df.collect()}


# Changes ----------------------------------------------------------------------
def test_upsert(spark):
    ddl = "k int, req int, text string, t int"
    old = spark.createDataFrame([(1, 10, "a", 0), (2, 20, "b", 0)], ddl)
    delta = spark.createDataFrame([(2, 99, "x", 1), (2, 98, "y", 2), (3, 30, "z", 1)], ddl)
    new = M.upsert(old, delta, ["k"], ["text", "t"], ["t"])
    assert rows(new) == {(1, 10, "a", 0), (2, 20, "y", 2), (3, 30, "z", 1)}
    assert rows(M.upsert(new, delta, ["k"], ["text", "t"], ["t"])) == rows(new)


def test_upsert_beyond_the_bound_gives_the_same_rows(spark, monkeypatch):
    ddl = "k int, l string, text string, t int, kept string"
    old = spark.createDataFrame([(1, "a", "a", 0, "p"), (2, "a", None, 0, None), (None, "a", "n", 0, "q")], ddl)
    delta = [(2, "a", "y", 2), (2, "a", "x", 1), (2, "b", None, 1), (None, "a", "m", 3)]
    delta = spark.createDataFrame(delta, "k int, l string, text string, t int")
    made = []
    for bound in (100, 0):
        monkeypatch.setattr("voxtally.operators.sides.MAX_BROADCAST_ROWS", bound)
        new = M.upsert(old, delta, ["k", "l"], ["text"], ["t"])
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == (bound == 0)
        made.append(rows(new))
    assert made[0] == made[1] == {
        (1, "a", "a", 0, "p"),
        (2, "a", "y", 0, None),
        (2, "b", None, 1, None),
        (None, "a", "n", 0, "q"),
        (None, "a", "m", 3, None),
    }


def test_rows_fit_the_tables(spark):
    at = F.lit("2024-06-01 12:00:00")
    found = spark.createDataFrame(
        [("a", 1, "neutral", 0.4, "t"), ("b", 1, None, None, None)],
        "comment_id string, req_id int, model_prediction string, model_confidence double, text_display string",
    )
    asked = spark.createDataFrame([(7, "u", "NEW", None)], "user_id long, video_url string, status string, created_at timestamp_ntz")
    texts = C.preprocess(spark.createDataFrame([("a", 1, "x")], "comment_id string, req_id int, text_display string"))
    for name, df, key in (
        ("final_results", S.finalize(found), ["comment_id"]),
        ("review_queue", S.enqueue_review(found), ["comment_id"]),
        ("requests", asked, ["user_id", "video_url"]),
        ("preprocessed_comments", texts.withColumn("processed_by", F.lit(C.PROCESSED_BY)), ["comment_id"]),
    ):
        out = M.as_rows_of(TABLES[name], df, key, after=10, at=at)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in TABLES[name].schema]
        if TABLES[name].primary_key not in df.columns:
            ids = [r[0] for r in out.select(TABLES[name].primary_key).collect()]
            assert sorted(ids) == list(range(11, 11 + df.count()))
        assert M.as_rows_of(TABLES[name], df.limit(0), key, after=10, at=at).count() == 0
    made = M.as_rows_of(TABLES["final_results"], S.finalize(found), ["comment_id"], at=at)
    assert {r.created_at for r in made.collect()} == {datetime(2024, 6, 1, 12)}


def test_cascade_over_the_graph(spark):
    store = {
        "requests": spark.createDataFrame([(1,), (2,)], "req_id int"),
        "raw_comments": spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "comment_id string, req_id int"),
        "predictions": spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, comment_id string"),
        "review_queue": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, comment_id string"),
    }
    gone = spark.createDataFrame([(1,), (1,)], "req_id int")
    after = {name: rows(df) for name, df in M.cascade(store, "requests", gone).items()}
    assert after == {
        "requests": {(2,)},
        "raw_comments": {("b", 2), ("c", None)},
        "predictions": {(2, "b"), (3, None)},
        "review_queue": {(1, None), (2, "b"), (3, "c")},
    }
    same = M.cascade(store, "requests", gone.limit(0))
    assert {n: rows(df) for n, df in same.items()} == {n: rows(df) for n, df in store.items()}


def test_stage_steps(spark):
    url = "https://www.youtube.com/watch?v=abcdefghijk"
    requests = spark.createDataFrame(
        [(1, url, "LOCKED"), (2, url, "LOCKED"), (3, "nowhere", "LOCKED"), (4, "nowhere", "NEW"),
         (5, url, "FETCHED"), (6, url, "FETCHED"), (7, url, "PREDICTED_MODEL"), (8, url, "PREDICTED_MODEL")],
        "req_id int, video_url string, status string",
    ).withColumn("user_id", F.lit(1).cast("long"))
    raw = spark.createDataFrame([(1,), (3,), (4,), (None,)], "req_id int")

    def states(df):
        return {r.req_id: r.status for r in df.collect()}

    before = states(requests)
    assert states(R.fail_unusable(requests, raw)) == before | {2: "FAILED", 3: "FAILED"}
    predictions = spark.createDataFrame(
        [(5, "x"), (6, "x"), (7, "x"), (8, None)], "req_id int, model_prediction string"
    )
    backlog = spark.createDataFrame([(6,)], "req_id int")
    assert states(R.mark_predicted(requests, backlog, predictions)) == before | {5: "PREDICTED_MODEL"}
    assert states(R.mark_finalized(requests, predictions)) == before | {7: "FINALIZED"}


def test_replace_group(spark):
    requests = spark.createDataFrame([(1, "u"), (2, "u"), (3, "w")], "req_id int, video_url string")
    ddl = "comment_id string, video_id string, req_id int"
    old = spark.createDataFrame([("a", "v", 1), ("b", "v", 3), ("c", "q", 1)], ddl)
    delta = spark.createDataFrame([("d", "v", 2)], ddl)
    new = M.replace_group(old, delta, requests)
    assert rows(new) == {("b", "v", 3), ("c", "q", 1), ("d", "v", 2)}
    assert rows(M.replace_group(new, delta, requests)) == rows(new)


def test_delete(spark):
    children = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, parent string")
    gone = spark.createDataFrame([("a",), ("a",)], "key string")
    assert rows(M.cascade_delete(children, gone, "parent", "key")) == {(2, "b"), (3, None)}
    assert rows(M.cascade_delete(children, gone, "parent", "key", "set_null")) == {
        (1, None),
        (2, "b"),
        (3, None),
    }


def make_requests(spark, *states):
    data = [(i, i % 2, f"u{i}", s, datetime(2024, 1, 1 + i)) for i, s in enumerate(states)]
    return spark.createDataFrame(
        data, "req_id int, user_id long, video_url string, status string, created_at timestamp_ntz"
    )


def test_transition_is_guarded(spark):
    requests = make_requests(spark, "FETCHED", "NEW", "FETCHED")
    ids = spark.createDataFrame([(0,), (0,), (1,)], "req_id int")
    moved = R.transition(requests, ids, "PREDICTED_MODEL", ["FETCHED"])
    assert {r.req_id: r.status for r in moved.collect()} == {
        0: "PREDICTED_MODEL",
        1: "NEW",
        2: "FETCHED",
    }
    with pytest.raises(ValueError):
        R.transition(requests, ids, "DONE")


def test_new_requests(spark):
    requests = make_requests(spark, "NEW", "FAILED")
    asked = spark.createDataFrame(
        [(0, "u0", datetime(2024, 5, 1)), (1, "u1", datetime(2024, 5, 3)), (1, "u1", datetime(2024, 5, 2))],
        "user_id long, video_url string, created_at timestamp_ntz",
    )
    fresh = R.new_requests(requests, asked)
    assert rows(fresh) == {(1, "u1", "NEW", datetime(2024, 5, 2))}
    routed = {r.user_id: r.existing_req_id for r in R.route_submissions(requests, asked).collect()}
    assert routed == {0: 0, 1: None}


def test_status_summary_and_has_new(spark):
    requests = make_requests(spark, "FETCHED", "FETCHED")
    summary = {r.status: r.requests for r in R.status_summary(requests, True).collect()}
    assert len(summary) == 8 and summary["FETCHED"] == 2 and sum(summary.values()) == 2
    assert not R.has_new(requests).first().has_new
    assert R.has_new(make_requests(spark, "NEW")).first().has_new


def test_finalizing_again_adds_nothing(spark):
    requests = make_requests(spark, "PREDICTED_MODEL", "FETCHED")
    raw = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "comment_id string, text_display string")
    predictions = spark.createDataFrame(
        [("a", 0, "joy", 0.5), ("b", 0, "joy", 0.6), ("c", 1, "joy", 0.1)],
        "comment_id string, req_id int, model_prediction string, model_confidence double",
    )
    due = S.finalizable(predictions, raw, requests)
    first, queue = S.finalize(due), S.enqueue_review(due)
    assert rows(first) == {("a", 0, "joy", "MODEL"), ("b", 0, "joy", "MODEL")}
    assert rows(queue) == {("a", 0, "x", "joy", 0.5, "PENDING")}
    assert S.finalize(due, first).count() == 0 and S.enqueue_review(due, queue).count() == 0


def test_backlog_counts_rejected_rows_as_seen(spark):
    requests = make_requests(spark, "FETCHED", "NEW")
    raw = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 1)], "comment_id string, req_id int")
    done = spark.createDataFrame([("a",)], "comment_id string")
    rejected = spark.createDataFrame([("b",), ("b",)], "comment_id string")
    left = C.preprocessing_backlog(raw, requests, done, rejected)
    assert [r.comment_id for r in left.collect()] == ["c"]
    with pytest.raises(ValueError):
        C.take_batch(raw, 5)


def test_message(spark):
    results = spark.createDataFrame(
        [(7, "joy"), (7, "sadness"), (7, "joy"), (8, "b"), (8, "a")], "req_id int, emotion_class string"
    )
    got = {r.req_id: r.message for r in S.result_message(results).collect()}
    assert "📝 3 comments analyzed\n😊 Top emotion: joy (2 comments, 66.7%)" in got[7]
    assert "\n😊 joy: 2 comments\n😢 sadness: 1 comments\n" in got[7]
    assert "📊 Top emotion: a (1 comments, 50.0%)" in got[8]
    top = {r.req_id: r.top_label for r in S.top_label_per_request(results).collect()}
    assert top == {7: "joy", 8: "a"}


def test_pages_stop_at_the_limit(spark):
    def page(*ids):
        items = ",".join(
            f'{{"snippet":{{"topLevelComment":{{"id":"{i}","snippet":{{"textDisplay":"t{i}"}}}}}}}}' for i in ids
        )
        return f'{{"items":[{items}],"nextPageToken":"n"}}'

    data = [("v", 0, page("a", "b")), ("v", 1, page("c", "d")), ("w", 0, page()), ("x", 0, page("e"))]
    pages = spark.createDataFrame(data, "video_id string, page int, body string")
    got = flatten_comment_pages(pages, max_per_video=3)
    assert {(r.video_id, r.comment_id, r.text_display) for r in got.collect()} == {
        ("v", "a", "ta"),
        ("v", "b", "tb"),
        ("v", "c", "tc"),
        ("x", "e", "te"),
    }


# Models -----------------------------------------------------------------------
def test_scores(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [900.0, 0.0])], "id int, x array<double>")
    got = {r.id: r for r in score_linear(df, "x", [[1, 0], [2, 0], [2, 0]], id2label={1: "b"}).collect()}
    e = np.exp([1.0, 2.0, 2.0])
    assert np.allclose(got[1].probabilities, e / e.sum()) and got[1].label == "b"
    # Equal probabilities go to the lowest class, and large logits do not overflow.
    assert got[2].class_id == 0 and got[2].label == "class_0"
    assert got[3].class_id == 1 and got[3].confidence == pytest.approx(0.5)


def test_batch_model_is_loaded_per_worker_and_sees_every_text(spark):
    def loader():
        return lambda texts: np.array([[0.25, 0.75] if t else [0.6, 0.4] for t in texts])

    df = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: (r.class_id, r.label, r.confidence) for r in score_batches(df, "text", loader, {0: "n"}).collect()}
    assert got == {1: (1, "class_1", 0.75), 2: (0, "n", 0.6), 3: (0, "n", 0.6)}


def test_encoding(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, "c"), (3, ""), (4, None)], "doc_id int, text string")
    vocab = vocabulary(df, "text", 2)
    assert {r.word: r.word_id for r in vocab.collect()} == {"b": 2, "a": 3}
    got = {r.doc_id: (r.input_ids, r.attention_mask) for r in encode_fixed_length(df, vocab, max_length=4).collect()}
    assert got == {
        1: ([2, 3, 2, 0], [1, 1, 1, 0]),
        2: ([1, 0, 0, 0], [1, 0, 0, 0]),
        3: ([0, 0, 0, 0], [0, 0, 0, 0]),
        4: ([0, 0, 0, 0], [0, 0, 0, 0]),
    }
    short = encode_fixed_length(df, vocab, max_length=2).filter("doc_id = 1").first()
    assert short.input_ids == [2, 3]


def test_label_ids(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "label string")
    assert rows(index_labels(df)) == {("a", 0), ("b", 1)}


# Files, catalogue -------------------------------------------------------------
def test_csv(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write('text,label\n"line one\nline ""two"", end",a\n,b\n')
    df = files.read_labeled_csv(spark, path)
    assert df.columns == ["text", "label"]
    assert rows(df) == {('line one\nline "two", end', "a"), (None, "b")}
    out = str(tmp_path / "out")
    files.write_csv(df, out)
    assert rows(files.read_labeled_csv(spark, out)) == rows(df)


def test_label_map(spark, tmp_path):
    path = tmp_path / "metadata.json"
    path.write_text('{\n "id2label": {"0": "x", "2": "y"}\n}')
    assert dict(files.read_label_map(spark, str(path))) == {0: "x", 2: "y"}


def test_comment_pages_are_read_as_text(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"items": []}\n')
    assert files.read_comment_pages(spark, str(tmp_path)).first().body == '{"items": []}'


def test_jdbc_url():
    assert jdbc.jdbc_url("postgresql", "h", 5432, "d") == "jdbc:postgresql://h:5432/d"
    with pytest.raises(ValueError):
        jdbc.jdbc_url("oracle", "h", 1, "d")


class Recorder:
    """Stands in for a session: notes what a reader is asked for."""

    def __init__(self, bounds):
        self.bounds, self.seen, self.read = bounds, {}, self

    def format(self, name):
        self.seen["format"] = name
        return self

    def options(self, **options):
        self.seen.update(options)
        return self

    def load(self):
        return self

    def agg(self, *_):
        return self

    def first(self):
        return self.bounds


def test_jdbc_reads_in_slices(spark):
    seen = jdbc.read_jdbc(Recorder((3, 90)), "jdbc:x", "raw_comments", "req_id", 8).seen
    assert seen["dbtable"] == "raw_comments" and seen["format"] == "jdbc"
    assert (seen["lowerBound"], seen["upperBound"], seen["numPartitions"]) == ("3", "90", "8")
    assert "partitionColumn" not in jdbc.read_jdbc(Recorder((None, None)), "jdbc:x", "t", "id").seen
    assert "partitionColumn" not in jdbc.read_jdbc(Recorder(None), "jdbc:x", "t").seen


def test_stamped_path():
    at = datetime(2024, 1, 31, 23, 59, 59)
    assert files.stamped_path("/x/", "review_queue", at) == "/x/review_queue_20240131_235959"


def test_comment_tables_meet_without_a_shuffle(spark):
    db = f"store_{uuid.uuid4().hex[:8]}"
    try:
        catalog.create_tables(spark, db, buckets=4)
        raw, predicted = spark.table(f"{db}.raw_comments"), spark.table(f"{db}.predictions")
        with_text = predicted.hint("merge").join(raw.select("comment_id", "text_display"), "comment_id")
        assert "Exchange" not in with_text._jdf.queryExecution().executedPlan().toString()
        # The keys of a bucketed table are made distinct where they are.
        left = raw.join(predicted.select("comment_id").distinct().hint("merge"), "comment_id", "left_anti")
        assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


def test_encoding_with_a_small_and_a_large_vocabulary(spark, monkeypatch):
    rows = [(1, "a b  c a"), (2, None), (3, ""), (4, "b " * 9), (5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "word string, word_id int")
    small = encode_fixed_length(df, vocab, max_length=5)
    assert "Exchange" not in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr("voxtally.operators.sides.MAX_BROADCAST_ROWS", 1)
    large = encode_fixed_length(df, vocab, max_length=5)
    got = [sorted(map(tuple, d.collect())) for d in (small, large)]
    assert got[0] == got[1]
    assert got[0][0] == (1, [2, 3, 1, 2, 0], [1, 1, 1, 1, 0]) and got[0][1] == (2, [0] * 5, [0] * 5)
    assert encode_fixed_length(df.limit(0), vocab).count() == 0
    assert encode_fixed_length(df, vocab.limit(0), max_length=2).filter("doc_id = 4").first().input_ids == [1, 1]


def test_catalog(spark):
    db = f"store_{uuid.uuid4().hex[:8]}"
    plan = catalog.create_tables(spark, db, dry_run=True)
    assert len(plan) == 1 + 8 and not spark.catalog.databaseExists(db)
    try:
        catalog.create_tables(spark, db)
        catalog.create_tables(spark, db)
        assert catalog.missing_tables(spark, db) == []
        assert spark.table(f"{db}.review_queue").columns == TABLES["review_queue"].schema.names
        catalog.register_views(spark, db)
        assert spark.table("v_pending_reviews").count() == 0
        assert spark.table("v_training_data_export").columns[:2] == ["comment_text", "label"]
        spark.sql(f"DROP TABLE {db}.predictions")
        assert catalog.missing_tables(spark, db) == ["predictions"]
        catalog.create_tables(spark, db, force=True)
        assert catalog.missing_tables(spark, db) == []
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


def test_audit(spark):
    requests = spark.createDataFrame(
        [(1, 1, "u", "NEW"), (1, 1, None, "ODD")], "req_id int, user_id long, video_url string, status string"
    )
    raw = spark.createDataFrame(
        [("a", 1, "v"), ("b", 5, "v" * 21), ("c", 5, None), ("d", None, "v")],
        "comment_id string, req_id int, video_id string",
    )
    found = catalog.audit_constraints({"requests": requests, "raw_comments": raw})
    violations = {(r.table_name, r.rule): r.violations for r in found.collect() if r.violations}
    assert violations == {
        ("requests", "unique:req_id"): 1,
        ("requests", "not_null:video_url"): 1,
        ("requests", "domain:status"): 1,
        ("raw_comments", "length:video_id"): 1,
        ("raw_comments", "foreign_key:req_id->requests"): 2,
    }


# Streams ----------------------------------------------------------------------
def test_incremental_run_takes_each_file_once(spark, tmp_path):
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def arrive(*data):
        df = spark.createDataFrame(list(data), "comment_id string, text_display string, n int")
        df.coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = I.read_stream(spark, source, spark.read.parquet(source).schema)
        I.run_incremental(stream, C.preprocess, sink, progress)
        return spark.read.parquet(sink)

    arrive(("a", "မြန်မာစာ", 1), ("b", "latin", 1))
    assert run().count() == 2
    assert run().count() == 2
    arrive(("a", "မြန်မာစာအသစ်", 2))
    assert run().count() == 3
    latest = I.read_latest(spark, sink, ["comment_id"], ["n"])
    assert {r.comment_id: r.text_unicode for r in latest.collect()} == {"a": "မြန်မာစာအသစ်", "b": None}


def test_counts_stay_current(spark, tmp_path):
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for labels, expected in ((["x", "y"], {"x": 1, "y": 1}), (["x"], {"x": 2, "y": 1})):
        df = spark.createDataFrame([(1, v) for v in labels], "req_id int, label string")
        df.coalesce(1).write.mode("append").parquet(source)
        stream = I.read_stream(spark, source, df.schema)
        I.run_label_counts(stream, ["req_id", "label"], sink, progress)
        got = I.read_label_counts(spark, ["req_id", "label"], sink)
        assert {r.label: r.n for r in got.collect()} == expected


def test_stream_drops_what_it_has_seen(spark, tmp_path):
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    df = spark.range(5).select("id", F.lit("2024-01-01").cast("timestamp_ntz").alias("ts")).coalesce(1)
    for _ in range(2):
        df.write.mode("append").parquet(source)
        stream = I.read_stream(spark, source, df.schema)
        I.run_incremental(stream, lambda s: I.deduplicated_dropping_late(s, ["id"], "ts", "1 hour"), sink, progress)
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(5))


def test_shared_folders_are_new(spark):
    assert shared_folder(spark, "x") != shared_folder(spark, "x")

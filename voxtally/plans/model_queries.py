"""Splits, samples, features, scoring and training."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from voxtally.functions.labels import confidence_fallback, is_low_confidence
from voxtally.operators import features as E
from voxtally.operators import groups as G
from voxtally.operators.results import label_shares
from voxtally.operators.scoring import attach_predictions, score_batches, score_linear
from voxtally.operators.descent import fit_by_epochs, gradient, sparse_rows
from voxtally.operators.training import split_support, train_classifier
from voxtally.plans.bindings import sql_tokens
from voxtally.plans.registry import query

# The stand-in model travels with the query: executors need not have this package.
register_pickle_by_value(sys.modules[__name__])

SENTIMENT_OF_CLASS = {0: "positive", 1: "negative", 2: "neutral"}


@query(
    "stratified_split",
    """SELECT doc_id, label, r <= round(0.2 * n) AS is_test
       FROM (SELECT doc_id, label, count(*) OVER (PARTITION BY label) AS n,
                    row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS r
             FROM labelled)""",
    ["labelled"],
)
def stratified_split(t):
    return G.split_by_share(t.labelled.select("doc_id", "label"), ["label"], "doc_id", 0.2, 42)


@query(
    "split_sizes",
    """SELECT lang, count(*) AS n, CAST(round(0.1 * count(*)) AS BIGINT) AS test_rows
       FROM documents GROUP BY lang""",
)
def split_sizes(t):
    split = G.split_by_share(t.documents.select("doc_id", "lang"), ["lang"], "doc_id", 0.1)
    return split.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("test_rows")
    )


@query(
    "sample_exactly",
    "SELECT doc_id, text FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 200",
)
def sample_of_documents(t):
    return G.sample_exactly(t.documents.select("doc_id", "text"), "doc_id", 200)


@query(
    "assign_ids",
    """SELECT doc_id, 1000 + row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) AS id
       FROM documents""",
)
def ids_assigned(t):
    return G.assign_ids(t.documents.select("doc_id"), "doc_id", "id", start=1000)


@query(
    "assign_ids_in_order",
    """SELECT req_id, 100 + row_number() OVER (ORDER BY created_at, req_id) AS id FROM submissions""",
    ["submissions"],
)
def ids_assigned_in_order(t):
    asked = t.submissions.select("req_id", "created_at")
    return G.assign_ids_in_order(asked, ["created_at"], "req_id", start=100).drop("created_at")


@query(
    "index_labels",
    "SELECT doc_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM labelled",
    ["labelled"],
)
def labels_indexed(t):
    return E.index_labels(t.labelled.select("doc_id", "label"))


@query(
    "class_weights",
    """SELECT doc_id, label, CASE label WHEN 'neutral' THEN 1.33::DOUBLE ELSE 0.89::DOUBLE END AS weight
       FROM labelled""",
    ["labelled"],
)
def rows_weighted(t):
    return E.class_weights(t.labelled.select("doc_id", "label"))


_VOCABULARY = f"""
    SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) + 1 AS INTEGER) AS word_id
    FROM (SELECT word, count(*) AS n
          FROM (SELECT unnest({sql_tokens("text")}) AS word FROM documents)
          GROUP BY word ORDER BY n DESC, word LIMIT 5000)"""


@query("vocabulary", _VOCABULARY)
def words_ranked(t):
    return E.vocabulary(t.texts, "text", 5000)


@query("vocabulary_by_summaries", _VOCABULARY)
def words_ranked_by_summaries(t):
    return E.vocabulary_by_summaries(t.texts, "text", 5000, capacity=20_000)


@query(
    "encode_fixed_length",
    f"""
    WITH vocab AS ({_VOCABULARY}),
    words AS (
        SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
        FROM (SELECT doc_id, {sql_tokens("text")}[1:64] AS w FROM documents)),
    ids AS (
        SELECT doc_id, list(coalesce(word_id, 1) ORDER BY pos) AS ids
        FROM words LEFT JOIN vocab USING (word) GROUP BY doc_id)
    SELECT d.doc_id,
           array_to_string(list_resize(coalesce(ids, []), 64, 0), ' ') AS input_ids,
           array_to_string(list_resize(list_transform(coalesce(ids, []), lambda x: 1), 64, 0), ' ')
           AS attention_mask
    FROM documents d LEFT JOIN ids USING (doc_id)""",
)
def texts_encoded(t):
    vocab = E.vocabulary(t.texts, "text", 5000)
    encoded = E.encode_fixed_length(t.texts, vocab, max_length=64)
    return encoded.select(
        "doc_id",
        F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join("attention_mask", " ").alias("attention_mask"),
    )


# Scoring ----------------------------------------------------------------------
CLASSES, WIDTH = 10, 64


def coefficient(c: int, j: int) -> float:
    return ((c * WIDTH + j) * 31 % 17 - 8) / 8.0


WEIGHTS = [[coefficient(c, j) for j in range(WIDTH)] for c in range(CLASSES)]

_SCORED = f"""
    WITH x AS (
        SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS j
        FROM embeddings),
    logits AS (
        SELECT vec_id, c, sum(v * (((c * {WIDTH} + j) * 31 % 17 - 8) / 8.0::DOUBLE)) AS z
        FROM x CROSS JOIN range({CLASSES}) r(c) GROUP BY vec_id, c),
    powers AS (SELECT vec_id, c, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM logits),
    probs AS (SELECT vec_id, c, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM powers)
    SELECT vec_id, CAST(c AS INTEGER) AS class_id,
           CASE c WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral'
                  ELSE 'class_' || c END AS label,
           round(p, 6) AS confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c) AS r FROM probs)
    WHERE r = 1"""


@query("score_linear", _SCORED)
def scored_linearly(t):
    scored = score_linear(
        t.given("embeddings").select("vec_id", "embedding"), "embedding", WEIGHTS, id2label=SENTIMENT_OF_CLASS
    )
    return scored.select("vec_id", "class_id", "label", F.round("confidence", 6).alias("confidence"))


def vowel_model():
    """A stand-in for a trained model: scores a text by how often some vowels occur in it."""

    def predict(texts):
        counts = np.array([[t.count(v) for v in "aeo"] for t in texts], dtype=float).reshape(-1, 3)
        shares = counts / np.array([[len(t) + 1.0] for t in texts]) * 10.0
        powers = np.exp(shares - shares.max(axis=1, keepdims=True))
        return powers / powers.sum(axis=1, keepdims=True)

    return predict


def _vowel_logit(v: str) -> str:
    return f"(length(text) - length(replace(text, '{v}', ''))) / (length(text) + 1.0::DOUBLE) * 10.0::DOUBLE"


_BATCH = f"""
    SELECT {{key}}, {{extra}} a, e, o, greatest(a, e, o) AS m,
           exp(a - m) + exp(e - m) + exp(o - m) AS s,
           CASE WHEN a = m THEN 0 WHEN e = m THEN 1 ELSE 2 END AS class_id, 1 / s AS confidence
    FROM (SELECT *, {_vowel_logit("a")} AS a, {_vowel_logit("e")} AS e, {_vowel_logit("o")} AS o
          FROM {{table}})"""
_NAME = "CASE class_id WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END"


@query(
    "score_batches",
    f"""SELECT doc_id, class_id, {_NAME} AS label, round(confidence, 6) AS confidence
        FROM ({_BATCH.format(key="doc_id", extra="", table="documents")})""",
)
def scored_in_batches(t):
    rows = t.texts.select("doc_id", "text")
    scored = score_batches(rows, "text", vowel_model, SENTIMENT_OF_CLASS)
    return scored.select("doc_id", "class_id", "label", F.round("confidence", 6).alias("confidence"))


@query(
    "attach_predictions",
    f"""SELECT doc_id, text, {_NAME} AS predicted, round(confidence, 6) AS confidence,
               label AS truth, label = {_NAME} AS correct
        FROM ({_BATCH.format(key="doc_id", extra="text, label,", table="labelled")})""",
    ["labelled"],
)
def predictions_attached(t):
    # Only rows with a label are scored.
    scored = score_batches(t.labelled.select("doc_id", "text"), "text", vowel_model, SENTIMENT_OF_CLASS)
    attached = attach_predictions(t.labelled, scored, "doc_id")
    return attached.withColumn("confidence", F.round("confidence", 6))


@query(
    "training_support",
    """SELECT label, count(*) FILTER (WHERE r > round(0.2 * n)) AS train_rows,
              count(*) FILTER (WHERE r <= round(0.2 * n)) AS held_out_rows,
              CASE label WHEN 'neutral' THEN 1.33::DOUBLE ELSE 0.89::DOUBLE END AS weight
       FROM (SELECT label, count(*) OVER (PARTITION BY label) AS n,
                    row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS r
             FROM labelled)
       GROUP BY label""",
    ["labelled"],
)
def support_of_training(t):
    return split_support(t.labelled, "doc_id")


@query("train_classifier")
def classifier_trained(t):
    rows = E.index_labels(t.labelled.select("doc_id", "text", "label"))
    best, fits = train_classifier(rows, "doc_id")
    return t.spark.createDataFrame(
        [(c.reg_param, c.accuracy, c.f1, c is best) for c in fits],
        "reg_param double, accuracy double, f1_weighted double, is_best boolean",
    )


EPOCH_FEATURES = 1 << 12


@query(
    "first_epoch_gradient",
    f"""
    WITH rows AS (
        SELECT doc_id, dense_rank() OVER (ORDER BY label) - 1 AS y, {sql_tokens("text")} AS words,
               CASE label WHEN 'neutral' THEN 1.33::DOUBLE ELSE 0.89::DOUBLE END AS weight
        FROM labelled),
    entries AS (
        SELECT doc_id, y, weight, len(words) AS n,
               ('0x' || substr(md5(unnest(words)), 1, 8))::BIGINT % {EPOCH_FEATURES} AS feature
        FROM rows),
    classes AS (SELECT DISTINCT y AS label_id FROM rows),
    sums AS (
        SELECT label_id, feature,
               sum(weight * (1.0::DOUBLE / (SELECT count(*) FROM classes) - (y = label_id)::INTEGER) / sqrt(n)) AS s
        FROM entries, classes GROUP BY label_id, feature)
    SELECT CAST(label_id AS INTEGER) AS label_id, CAST(f.feature AS INTEGER) AS feature,
           round(coalesce(s, 0) / (SELECT sum(weight) FROM rows), 9) + 0.0 AS gradient
    FROM classes CROSS JOIN (SELECT unnest(range({EPOCH_FEATURES})) AS feature) f LEFT JOIN sums USING (label_id, feature)""",
    ["labelled"],
)
def first_gradient(t):
    rows = E.class_weights(E.index_labels(t.labelled.select("doc_id", "text", "label")))
    classes = rows.agg(F.max("label_id")).first()[0] + 1
    sparse = sparse_rows(rows, EPOCH_FEATURES)
    slope, _, _ = gradient(sparse, np.zeros((classes, EPOCH_FEATURES)))
    # As many rows as the model has weights.
    cells = [(c, j, float(x)) for c, line in enumerate(slope) for j, x in enumerate(line)]
    out = t.spark.createDataFrame(cells, "label_id int, feature int, gradient double")
    return out.withColumn("gradient", F.round("gradient", 9) + F.lit(0.0))


@query("training_epochs")
def trained_by_epochs(t):
    rows = E.index_labels(t.labelled.select("doc_id", "text", "label"))
    fit = fit_by_epochs(rows, "doc_id", rows.agg(F.max("label_id")).first()[0] + 1, features=EPOCH_FEATURES, epochs=6)
    return t.spark.createDataFrame(
        [(e.number, e.loss, e.held_out_loss, e.accuracy, e.f1, k == fit.best) for k, e in enumerate(fit.epochs)],
        "epoch int, loss double, held_out_loss double, accuracy double, f1_weighted double, is_best boolean",
    )


# Flagship ---------------------------------------------------------------------
TEXT_WEIGHTS = [[1.2, -0.4, 0.3], [-0.8, 1.1, 0.2], [0.1, 0.2, -0.6]]
TEXT_BIAS = [-0.2, 0.1, 0.4]


def _text_features():
    """Three cheap measures of a cleaned comment that a linear model can weigh."""
    length = F.length("text_unicode").cast("double")
    words = F.col("token_count").cast("double")
    stops = F.length(F.regexp_replace("text_unicode", r"[^.!?]+", "")).cast("double")
    return F.array(length / (length + 500), words / (words + 100), stops / (stops + 10))


def _sql_logit(w, b) -> str:
    terms = (f"f{j} * ({x}::DOUBLE)" for j, x in enumerate(w))
    return f"({b}::DOUBLE + " + " + ".join(terms) + ")"


_LOGITS = ", ".join(
    f"{_sql_logit(w, b)} AS z{i}" for i, (w, b) in enumerate(zip(TEXT_WEIGHTS, TEXT_BIAS))
)


@query(
    "request_sentiment_report",
    rf"""
    WITH measured AS (
        SELECT req_id, length(text_unicode)::DOUBLE AS n, len(tokens)::DOUBLE AS w,
               length(regexp_replace(text_unicode, '[^.!?]+', '', 'g'))::DOUBLE AS s
        FROM preprocessed_comments),
    features AS (
        SELECT req_id, n / (n + 500) AS f0, w / (w + 100) AS f1, s / (s + 10) AS f2 FROM measured),
    logits AS (SELECT req_id, {_LOGITS} FROM features),
    scored AS (
        SELECT req_id, greatest(z0, z1, z2) AS m,
               CASE WHEN z0 = m THEN 'positive' WHEN z1 = m THEN 'negative' ELSE 'neutral' END AS best,
               1 / (exp(z0 - m) + exp(z1 - m) + exp(z2 - m)) AS confidence
        FROM logits),
    final AS (
        SELECT req_id, confidence, CASE WHEN confidence < 0.4 THEN 'neutral' ELSE best END AS label
        FROM scored)
    SELECT req_id, label AS emotion_class, count(*) AS n,
           CAST(round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY req_id), 1) AS DOUBLE)
           AS percentage,
           count(*) FILTER (WHERE confidence < 0.6) AS to_review
    FROM final GROUP BY req_id, label""",
    ["preprocessed_comments"],
)
def request_sentiment_report(t):
    rows = t.all_preprocessed.filter(F.col("reject_reason").isNull())
    features = rows.select("comment_id", "req_id", _text_features().alias("features"))
    scored = score_linear(features, "features", TEXT_WEIGHTS, TEXT_BIAS, SENTIMENT_OF_CLASS)
    final = scored.select(
        "req_id",
        confidence_fallback("label", "confidence", 0.4).alias("emotion_class"),
        is_low_confidence("confidence").alias("unsure"),
    )
    counts = final.groupBy("req_id", "emotion_class").agg(
        F.count("*").alias("n"), F.count_if("unsure").alias("to_review")
    )
    return label_shares(counts)

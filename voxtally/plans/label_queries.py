"""Label spelling, mapping and naming."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.functions import labels as L
from voxtally.operators import labels as ops
from voxtally.operators.results import add_blank_label
from voxtally.plans.bindings import sql_case, sql_strip
from voxtally.plans.registry import query

_LOWER = f"lower({sql_strip('sentiment')})"
_CAPITAL = (
    f"(upper(substr({sql_strip('event_type')}, 1, 1)) || lower(substr({sql_strip('event_type')}, 2)))"
)
FIXES = {"Signup": "Sign-up", "Click": "Clicked"}


@query(
    "normalize_label",
    f"""SELECT event_id, lower({sql_strip("event_type")}) AS lowered,
               coalesce({sql_case(_CAPITAL, FIXES)}, {_CAPITAL}) AS capitalized
        FROM events""",
)
def normalize_label(t):
    return t.events.select(
        "event_id",
        L.normalize_label("event_type", "lower").alias("lowered"),
        L.normalize_label("event_type", "capitalize", FIXES).alias("capitalized"),
    )


@query(
    "drop_null_like_labels",
    f"""SELECT doc_id, sentiment FROM annotations
        WHERE sentiment IS NOT NULL AND {_LOWER} NOT IN ('nan', 'none', '')""",
    ["annotations"],
)
def null_like_labels_dropped(t):
    return ops.drop_null_like_labels(t.annotations.select("doc_id", "sentiment"), "sentiment")


@query(
    "keep_labels",
    f"""SELECT doc_id, {_LOWER} AS label FROM annotations
        WHERE {_LOWER} IN ('negative', 'positive')""",
    ["annotations"],
)
def labels_kept(t):
    named = t.annotations.select("doc_id", L.normalize_label("sentiment").alias("label"))
    return ops.keep_labels(named, ["negative", "positive"])


@query(
    "standard_columns",
    "SELECT doc_id, text, lang, source, label FROM labelled",
    ["labelled"],
)
def standard_columns(t):
    renamed = t.labelled.withColumnsRenamed({"label": "Emotion", "text": "Cleaned_Test"})
    return ops.with_standard_columns(ops.lower_columns(renamed))


@query("select_existing_columns", "SELECT text, source AS origin FROM documents")
def existing_columns_selected(t):
    kept = ops.select_existing(t.documents, ["text", "emotion_class", "source", "platform"])
    return kept.withColumnsRenamed({"source": "origin"})


@query(
    "lookup_label",
    """SELECT d.doc_id, d.lang, m.class AS emotion_class, coalesce(m.class, 'Neutral') AS filled
       FROM documents d LEFT JOIN class_map m ON d.lang = m.sentiment""",
    ["class_map"],
)
def label_looked_up(t):
    rows = t.documents.select("doc_id", "lang")
    found = ops.lookup_label(rows, "lang", t.class_map)
    return found.withColumn("filled", F.coalesce("emotion_class", F.lit(ops.UNMAPPED_LABEL)))


@query(
    "lookup_label_last_entry",
    """WITH last AS (
           SELECT role AS sentiment, arg_max(CAST(conv_id AS VARCHAR), conv_id * 1000 + turn) AS class
           FROM conversations GROUP BY role)
       SELECT c.conv_id, c.turn, l.class AS emotion_class
       FROM conversations c LEFT JOIN last l ON c.role = l.sentiment""",
)
def label_looked_up_in_last_entry(t):
    turns = t.given("conversations")
    # An annotation table that lists its keys again and again.
    mapping = turns.select(
        F.col("role").alias("sentiment"),
        F.col("conv_id").cast("string").alias("class"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("entry"),
    )
    rows = turns.select("conv_id", "turn", "role")
    return ops.lookup_label(rows, "role", mapping, position="entry").drop("role")


@query(
    "label_synonyms",
    f"""SELECT doc_id, {sql_case(_LOWER, L.LABEL_SYNONYMS)} AS mapped FROM annotations""",
    ["annotations"],
)
def label_synonyms(t):
    name = L.normalize_label("sentiment")
    return t.annotations.select("doc_id", L.lookup(name, L.LABEL_SYNONYMS).alias("mapped"))


@query(
    "unmapped_labels",
    """SELECT DISTINCT lang FROM documents
       WHERE lang NOT IN (SELECT sentiment FROM class_map)""",
    ["class_map"],
)
def labels_without_class(t):
    return ops.unmapped_labels(t.documents, "lang", t.class_map)


@query("distinct_label_pairs", "SELECT DISTINCT lang, source FROM documents")
def distinct_label_pairs(t):
    return ops.distinct_pairs(t.documents, "lang", "source")


@query(
    "concat_datasets",
    """SELECT text, label, doc_id, NULL::VARCHAR AS role FROM labelled
       UNION ALL SELECT text, 'neutral', NULL, role FROM conversations""",
    ["labelled"],
)
def datasets_concatenated(t):
    extra = t.given("conversations").select("text", F.lit("neutral").alias("label"), "role")
    return ops.concat_datasets(t.labelled.select("text", "label", "doc_id"), extra)


@query(
    "decorate_label",
    f"""SELECT event_id, {sql_case("status", L.STATUS_SYMBOLS, L.STATUS_DEFAULT_SYMBOL)} AS status_symbol,
               {sql_case("lower(event_type)", {"click": "✓", "error": "✗"}, L.LABEL_DEFAULT_SYMBOL)} AS symbol
        FROM (SELECT event_id, event_type,
                     CASE event_type WHEN 'signup' THEN 'NEW' WHEN 'error' THEN 'FAILED'
                          ELSE 'OTHER' END AS status FROM events)""",
)
def label_decorated(t):
    status = (
        F.when(F.col("event_type") == "signup", "NEW")
        .when(F.col("event_type") == "error", "FAILED")
        .otherwise("OTHER")
    )
    symbols = {"click": "✓", "error": "✗"}
    return t.events.select(
        "event_id",
        L.decorate_status(status).alias("status_symbol"),
        L.decorate_label(F.upper("event_type"), symbols).alias("symbol"),
    )


@query(
    "label_name",
    """SELECT vec_id, CASE label WHEN 0 THEN 'positive' WHEN 1 THEN 'negative'
              WHEN 2 THEN 'neutral' ELSE 'class_' || label END AS name
       FROM embeddings""",
)
def label_named(t):
    metadata = F.lit('{"id2label": {"0": "positive", "1": "negative", "2": "neutral"}}')
    return t.given("embeddings").select(
        "vec_id", L.label_name("label", L.parse_id2label(metadata)).alias("name")
    )


@query("blank_label_column", "SELECT doc_id, text, '' AS manual_label FROM documents")
def blank_label_column(t):
    return add_blank_label(t.documents.select("doc_id", "text"), "manual_label")


@query(
    "confidence_fallback",
    """SELECT comment_id, model_confidence,
              CASE WHEN model_confidence < 0.5 THEN 'neutral' ELSE model_prediction END AS label
       FROM predictions""",
    ["predictions"],
)
def confidence_fallback(t):
    label = L.confidence_fallback("model_prediction", "model_confidence")
    return t.predictions.select("comment_id", "model_confidence", label.alias("label"))


@query(
    "low_confidence",
    "SELECT comment_id, model_prediction, model_confidence FROM predictions WHERE model_confidence < 0.6",
    ["predictions"],
)
def low_confidence(t):
    rows = t.predictions.filter(L.is_low_confidence("model_confidence"))
    return rows.select("comment_id", "model_prediction", "model_confidence")


@query(
    "low_confidence_any",
    """SELECT event_id FROM events WHERE value / 100 < 0.7 OR user_id / 150 < 0.7""",
)
def low_confidence_any(t):
    rows = t.events.select(
        "event_id", (F.col("value") / 100).alias("first"), (F.col("user_id") / 150).alias("second")
    )
    return rows.filter(L.any_low_confidence(["first", "second"])).select("event_id")

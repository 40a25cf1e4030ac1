"""Data-quality profiles, duplicates, constraints and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.functions.labels import SENTIMENTS, VERDICTS, WORST_VERDICT, accuracy_verdict
from voxtally.operators import groups as G
from voxtally.operators import metrics as M
from voxtally.operators import profile as P
from voxtally.plans.bindings import LEGACY, MODERN, sql_markers, sql_tokens
from voxtally.plans.registry import query
from voxtally.sources.catalog import audit_constraints, table_counts


def _rounded(df, *columns: str):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Profiles ---------------------------------------------------------------------
@query(
    "value_counts",
    """SELECT lang, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE
              AS percentage
       FROM documents WHERE lang IS NOT NULL GROUP BY lang""",
)
def value_counts(t):
    return _rounded(P.value_counts(t.documents, "lang"), "percentage")


@query(
    "value_counts_top",
    """SELECT source, n, round(n * 100.0 / total, 6)::DOUBLE AS percentage
       FROM (SELECT source, count(*) AS n, sum(count(*)) OVER () AS total
             FROM documents GROUP BY source)
       ORDER BY n DESC, source LIMIT 5""",
)
def value_counts_top(t):
    return _rounded(P.value_counts(t.documents, "source", top=5), "percentage")


_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) AS rows"
    " FROM missing"
    for c in ("doc_id", "text", "sentiment", "quality", "toxic")
)


@query(
    "missing_profile",
    f"""
    WITH missing AS (
        SELECT a.doc_id, a.text, a.sentiment, l.quality, l.toxic
        FROM annotations a LEFT JOIN labels l USING (doc_id))
    SELECT column_name, missing, round(missing * 100.0 / rows, 6)::DOUBLE AS percentage
    FROM ({_MISSING}) WHERE missing > 0""",
    ["annotations"],
)
def missing_profile(t):
    wide = t.annotations.select("doc_id", "text", "sentiment")
    wide = wide.join(t.given("labels"), "doc_id", "left")
    return _rounded(P.missing_profile(wide), "percentage")


@query(
    "n_unique",
    """SELECT 'lang' AS column_name, count(DISTINCT lang) AS n_unique FROM documents
       UNION ALL SELECT 'source', count(DISTINCT source) FROM documents
       UNION ALL SELECT 'text', count(DISTINCT text) FROM documents""",
)
def n_unique(t):
    return P.n_unique(t.documents, "lang", "source", "text")


@query("distinct_values", "SELECT DISTINCT event_type FROM events")
def distinct_values(t):
    return P.distinct_values(t.events, "event_type")


_DUPLICATES = """SELECT count(*) AS rows, count(*) - count(DISTINCT {key}) AS duplicates,
    round((count(*) - count(DISTINCT {key})) * 100.0 / count(*), 6)::DOUBLE AS percentage
    FROM documents"""


@query("duplicate_texts", _DUPLICATES.format(key="text"))
def duplicate_texts(t):
    return _rounded(P.duplicate_stats(t.documents, ["text"]), "percentage")


@query("duplicate_rows", _DUPLICATES.format(key="(text, lang, source, n_chars)"))
def duplicate_rows(t):
    return _rounded(P.duplicate_stats(t.documents.drop("doc_id")), "percentage")


@query(
    "flag_duplicates",
    """SELECT doc_id, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) > 1 AS is_duplicate
       FROM documents""",
)
def duplicates_flagged(t):
    return G.flag_repeats(t.documents, ["text", "lang"], "doc_id").select("doc_id", "is_duplicate")


@query(
    "dedup_texts",
    """SELECT doc_id, text, lang FROM (
           SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents)
       WHERE r = 1""",
)
def texts_deduplicated(t):
    return G.drop_repeats(t.documents, ["text"], "doc_id").select("doc_id", "text", "lang")


_LEGACY = f"{sql_markers('text', LEGACY)} > {sql_markers('text', MODERN)}"


@query(
    "encoding_audit",
    f"""SELECT CASE WHEN legacy THEN 'legacy' ELSE 'unicode' END AS encoding, count(*) AS n,
               round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS percentage
        FROM (SELECT {_LEGACY} AS legacy FROM documents) GROUP BY legacy""",
)
def encoding_audit(t):
    return _rounded(P.encoding_audit(t.texts, legacy=LEGACY, modern=MODERN), "percentage")


@query(
    "text_length_profile",
    f"""SELECT lang, count(*) AS n,
               min(c)::INTEGER AS min_chars, round(avg(c), 6) AS avg_chars, max(c)::INTEGER AS max_chars,
               min(w)::INTEGER AS min_words, round(avg(w), 6) AS avg_words, max(w)::INTEGER AS max_words
        FROM (SELECT lang, length(text) AS c, len({sql_tokens("text")}) AS w FROM documents)
        GROUP BY lang""",
)
def text_length_profile(t):
    return _rounded(P.text_length_profile(t.texts, ["lang"]), "avg_chars", "avg_words")


def _sql_quartiles(name: str, column: str) -> str:
    shares = (25, 50, 75)
    return ", ".join(f"round(quantile_cont({column}, {s / 100}), 6) AS q{s}_{name}" for s in shares)


@query(
    "text_length_quartiles",
    f"""SELECT source, {_sql_quartiles("chars", "c")}, {_sql_quartiles("words", "w")}
        FROM (SELECT source, length(text)::DOUBLE AS c, len({sql_tokens("text")})::DOUBLE AS w FROM documents)
        GROUP BY source""",
)
def text_length_quartiles(t):
    found = P.text_length_quartiles(t.texts, ["source"])
    return _rounded(found, *(c for c in found.columns if c != "source"))


@query(
    "value_counts_by_summaries",
    """SELECT source, n, round(n * 100.0 / total, 6)::DOUBLE AS percentage
       FROM (SELECT source, count(*) AS n, sum(count(*)) OVER () AS total
             FROM documents GROUP BY source)
       ORDER BY n DESC, source LIMIT 5""",
)
def value_counts_by_summaries(t):
    return _rounded(P.value_counts_by_summaries(t.documents, "source", 5, capacity=10), "percentage")


@query(
    "first_rows",
    "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 10",
)
def first_rows(t):
    return t.documents.select("doc_id", "lang", "source", "n_chars").orderBy("doc_id").limit(10)


# Constraints ------------------------------------------------------------------
def _store(t):
    return {
        "requests": t.requests,
        "raw_comments": t.raw_comments,
        "preprocessed_comments": t.preprocessed_comments,
        "predictions": t.predictions,
        "final_results": t.final_results,
        "review_queue": t.review_queue,
    }


_COUNTED = " UNION ALL ".join(
    f"SELECT 'total_{name}' AS metric, count(*) AS value FROM {name}"
    for name in (
        "requests",
        "raw_comments",
        "preprocessed_comments",
        "predictions",
        "final_results",
        "review_queue",
    )
)


@query(
    "table_counts",
    f"""{_COUNTED} UNION ALL
        SELECT 'pending_review', count(*) FROM review_queue WHERE status = 'PENDING'""",
    [
        "requests",
        "raw_comments",
        "preprocessed_comments",
        "predictions",
        "final_results",
        "review_queue",
    ],
)
def tables_counted(t):
    return table_counts(_store(t))


def _rule(table: str, rule: str, violations: str, source: str | None = None) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, {violations} AS violations "
        f"FROM {source or table}"
    )


def _where(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


_STATUSES = (
    "'NEW','LOCKED','FETCHED','PREPROCESSED','PREDICTED_MODEL','FINALIZED','RESPONDED','FAILED'"
)
_AUDIT = " UNION ALL ".join(
    [
        _rule("requests", "unique:req_id", "count(req_id) - count(DISTINCT req_id)"),
        _rule("requests", "not_null:req_id", _where("req_id IS NULL")),
        _rule("requests", "not_null:user_id", _where("user_id IS NULL")),
        _rule("requests", "not_null:video_url", _where("video_url IS NULL")),
        _rule("requests", "domain:status", _where(f"status NOT IN ({_STATUSES})")),
        _rule("raw_comments", "unique:comment_id", "count(comment_id) - count(DISTINCT comment_id)", "pages_in"),
        _rule("raw_comments", "not_null:comment_id", _where("comment_id IS NULL"), "pages_in"),
        _rule("raw_comments", "length:comment_id", _where("length(comment_id) > 50"), "pages_in"),
        _rule("raw_comments", "length:video_id", _where("length(video_id) > 20"), "pages_in"),
        "SELECT 'raw_comments', 'foreign_key:req_id->requests', "
        + _where("req_id IS NOT NULL AND req_id NOT IN (SELECT req_id FROM requests)")
        + " FROM pages_in",
    ]
)


@query(
    "audit_constraints",
    f"""
    WITH pages_in AS (
        SELECT url AS comment_id, split_part(url, '/', 3) AS video_id,
               CAST(page_id AS INTEGER) AS req_id FROM pages
        UNION ALL
        SELECT CAST(conv_id AS VARCHAR), role, CAST(turn AS INTEGER) FROM conversations)
    {_AUDIT}""",
    ["requests"],
)
def constraints_audited(t):
    # Pages and conversation turns as comments break most of the rules.
    pages = t.given("pages").select(
        F.col("url").alias("comment_id"),
        F.split_part("url", F.lit("/"), F.lit(3)).alias("video_id"),
        F.col("page_id").cast("int").alias("req_id"),
    )
    turns = t.given("conversations").select(
        F.col("conv_id").cast("string"), "role", F.col("turn").cast("int")
    )
    return audit_constraints({"requests": t.requests, "raw_comments": pages.union(turns)})


# Metrics ----------------------------------------------------------------------
_REPORT = """
    SELECT label,
           coalesce(h / nullif(p, 0), 0) AS precision, coalesce(h / nullif(s, 0), 0) AS recall,
           coalesce(2.0 * h / nullif(p + s, 0), 0)::DOUBLE AS f1, s AS support
    FROM (
        SELECT label, sum(s)::BIGINT AS s, sum(p)::BIGINT AS p, sum(h)::BIGINT AS h FROM (
            SELECT truth AS label, n AS s, 0 AS p, CASE WHEN truth = predicted THEN n ELSE 0 END AS h
            FROM outcomes
            UNION ALL SELECT predicted, 0, n, 0 FROM outcomes)
        GROUP BY label)"""


def _outcomes(t, by=()):
    return M.outcome_counts(t.evaluated.select("truth", "predicted", *by), by=by)


@query("outcome_counts", "SELECT truth, predicted, n FROM outcomes", ["outcomes"])
def outcome_counts(t):
    return _outcomes(t)


@query(
    "accuracy",
    """SELECT round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy,
              count(*) AS samples
       FROM evaluated""",
    ["evaluated"],
)
def accuracy(t):
    return _rounded(M.accuracy(_outcomes(t)), "accuracy")


@query(
    "classification_report",
    f"""SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(f1, 6) AS f1, support FROM ({_REPORT})""",
    ["outcomes"],
)
def classification_report(t):
    return _rounded(M.classification_report(_outcomes(t)), "precision", "recall", "f1")


@query(
    "report_averages",
    f"""
    WITH report AS ({_REPORT})
    SELECT 'macro avg' AS average, round(avg(precision), 6) AS precision,
           round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, sum(support)::BIGINT AS support
    FROM report
    UNION ALL
    SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
           round(sum(recall * support) / sum(support), 6),
           round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT
    FROM report""",
    ["outcomes"],
)
def report_averages(t):
    averages = M.average_scores(M.classification_report(_outcomes(t)))
    return _rounded(averages, "precision", "recall", "f1")


@query(
    "f1_scores",
    f"""SELECT round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(avg(f1), 6) AS f1_macro
        FROM ({_REPORT})""",
    ["outcomes"],
)
def f1_scores(t):
    return _rounded(
        M.f1_scores(M.classification_report(_outcomes(t))), "f1_weighted", "f1_macro"
    )


_LABELS = "(VALUES (0, 'negative'), (1, 'neutral'), (2, 'positive'), (3, 'mixed'))"


@query(
    "confusion_matrix",
    f"""SELECT a.i AS truth_index, b.i AS predicted_index, a.l AS truth, b.l AS predicted,
               coalesce(n, 0) AS n
        FROM {_LABELS} a(i, l) CROSS JOIN {_LABELS} b(i, l)
        LEFT JOIN outcomes o ON o.truth = a.l AND o.predicted = b.l""",
    ["outcomes"],
)
def confusion_matrix(t):
    return M.confusion_matrix(_outcomes(t), [*SENTIMENTS, "mixed"])


@query(
    "confusion_table",
    """SELECT truth,
              sum(CASE WHEN predicted = 'negative' THEN n ELSE 0 END)::BIGINT AS negative,
              sum(CASE WHEN predicted = 'neutral' THEN n ELSE 0 END)::BIGINT AS neutral,
              sum(CASE WHEN predicted = 'positive' THEN n ELSE 0 END)::BIGINT AS positive
       FROM outcomes GROUP BY truth""",
    ["outcomes"],
)
def confusion_table(t):
    return M.confusion_table(_outcomes(t), SENTIMENTS)


@query(
    "per_class_confidence",
    """SELECT truth AS label, count(*) FILTER (WHERE truth = predicted) AS correct,
              count(*) AS total,
              round(avg(CASE WHEN truth = predicted THEN 1 ELSE 0 END), 6) AS accuracy,
              round(avg(confidence), 6) AS avg_confidence
       FROM evaluated GROUP BY truth""",
    ["evaluated"],
)
def per_class_confidence(t):
    return _rounded(M.per_class_confidence(t.evaluated), "accuracy", "avg_confidence")


@query(
    "overall_confidence",
    "SELECT round(avg(confidence), 6) AS avg_confidence FROM evaluated",
    ["evaluated"],
)
def overall_confidence(t):
    return _rounded(M.overall_confidence(t.evaluated), "avg_confidence")


_BY_SOURCE = """
    SELECT source, label, sum(s)::BIGINT AS s, sum(p)::BIGINT AS p, sum(h)::BIGINT AS h FROM (
        SELECT source, truth AS label, 1 AS s, 0 AS p, CASE WHEN truth = predicted THEN 1 ELSE 0 END AS h
        FROM evaluated
        UNION ALL SELECT source, predicted, 0, 1, 0 FROM evaluated)
    GROUP BY source, label"""
_VERDICT = " ".join(f"WHEN accuracy >= {least} THEN '{name}'" for least, name in VERDICTS)


@query(
    "evaluation_summary",
    f"""SELECT source, samples, round(accuracy, 6) AS accuracy, round(f1_weighted, 6) AS f1_weighted,
               round(f1_macro, 6) AS f1_macro, round(f1_negative, 6) AS f1_negative,
               round(f1_neutral, 6) AS f1_neutral, round(f1_positive, 6) AS f1_positive,
               CASE {_VERDICT} ELSE '{WORST_VERDICT}' END AS verdict
        FROM (SELECT source, sum(s)::BIGINT AS samples, sum(h) / sum(s) AS accuracy,
                     sum(2.0 * h / (p + s) * s) / sum(s) AS f1_weighted,
                     avg(2.0 * h / (p + s)) AS f1_macro,
                     {", ".join(
                         f"coalesce(max(2.0 * h / (p + s)) FILTER (WHERE label = '{x}'), 0) AS f1_{x}"
                         for x in ("negative", "neutral", "positive"))}
              FROM ({_BY_SOURCE}) GROUP BY source)""",
    ["evaluated"],
)
def evaluation_summary(t):
    summary = M.evaluation_summary(t.evaluated, ["source"])
    per_class = ("f1_negative", "f1_neutral", "f1_positive")
    return _rounded(summary, "accuracy", "f1_weighted", "f1_macro", *per_class)


@query(
    "accuracy_verdict",
    f"""SELECT event_id, CASE {_VERDICT} ELSE '{WORST_VERDICT}' END AS verdict
        FROM (SELECT event_id, user_id / 150 AS accuracy FROM events)""",
)
def accuracy_verdicts(t):
    graded = accuracy_verdict(F.col("user_id") / 150)
    return t.events.select("event_id", graded.alias("verdict"))


@query(
    "correct_flag",
    "SELECT doc_id, truth, predicted, truth = predicted AS correct FROM evaluated",
    ["evaluated"],
)
def correct_flag(t):
    return M.with_correct_flag(t.evaluated.select("doc_id", "truth", "predicted"))


@query(
    "misclassified",
    """SELECT doc_id, substr(text, 1, 60) AS preview, truth, predicted, confidence
       FROM evaluated WHERE truth <> predicted""",
    ["evaluated"],
)
def rows_misclassified(t):
    wrong = M.misclassified(t.evaluated)
    preview = F.substring("text", 1, 60).alias("preview")
    return wrong.select("doc_id", preview, "truth", "predicted", "confidence")

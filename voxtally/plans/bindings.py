"""The comment store as it is derived from the given tables.

The given tables hold no comments, so each table of the store is defined over
them twice: as a DataFrame and as SQL. Both read the whole tables. Texts are in
European languages; the accented letters stand in for the script to filter by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions.charsets import KEPT_PUNCTUATION, NWS, WORD, WS, WS_MEMBERS
from voxtally.operators.comments import accepted, preprocess
from voxtally.operators.results import PENDING, finalizable
from voxtally.sources.files import read_table

# Fixed values -----------------------------------------------------------------
ACCENTS = r"\x{C0}-\x{FF}"
LATIN = r"A-Za-z\x{C0}-\x{FF}"
MIN_RATIO = 0.02
STATUS_OF_EVENT = {
    "signup": "NEW",
    "view": "LOCKED",
    "click": "FETCHED",
    "purchase": "PREDICTED_MODEL",
    "error": "FAILED",
}
WATCH = "https://www.youtube.com/watch?v="
LEGACY = ("é", "è", "ç")
MODERN = ("ä", "ö", "ü")
CLASS_OF_LANG = {"en": "positive", "fr": "negative", "de": "neutral"}
# ------------------------------------------------------------------------------


# SQL pieces ---------------------------------------------------------------------
def sql_replace(expr: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({expr}, '{pattern}', '{replacement}', 'g')"


def sql_collapse(expr: str) -> str:
    return f"trim({sql_replace(expr, WS + '+', ' ')}, ' ')"


def sql_strip(expr: str) -> str:
    return sql_replace(expr, f"^{WS}+|{WS}+$")


def sql_clean(expr: str, keep: str = LATIN) -> str:
    for pattern in (
        f"http{NWS}+",
        f"@{WORD}+",
        f"#{WORD}+",
        f"[^{keep}{WS_MEMBERS}{KEPT_PUNCTUATION}]+",
    ):
        expr = sql_replace(expr, pattern)
    return sql_collapse(expr)


def sql_tokens(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '{WS}+'), lambda w: w <> '')"


def sql_ratio(expr: str, ranges: str = ACCENTS) -> str:
    inside = f"length({sql_replace(expr, f'[^{ranges}]+')})"
    return f"({inside} / nullif(length({expr}), 0))"


def sql_markers(expr: str, markers: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({expr}, '{m}') AS INTEGER)" for m in markers) + ")"


def sql_case(expr: str, mapping: dict[str, str], default: str | None = None) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    otherwise = "" if default is None else f" ELSE '{default}'"
    return f"CASE {expr} {whens}{otherwise} END"


TABLE_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "submissions": (
        (),
        f"""
        SELECT CAST(event_id AS INTEGER) AS req_id, user_id, '{WATCH}' || event_type AS video_url,
               {sql_case("event_type", STATUS_OF_EVENT)} AS status, ts AS created_at
        FROM events""",
    ),
    "requests": (
        (),
        f"""
        SELECT CAST(user_id AS INTEGER) AS req_id, user_id,
               '{WATCH}' || max(event_type) FILTER (WHERE oldest = 1) AS video_url,
               max({sql_case("event_type", STATUS_OF_EVENT)}) FILTER (WHERE newest = 1) AS status,
               min(ts) AS created_at
        FROM (SELECT *,
                row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS oldest,
                row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS newest
              FROM events)
        GROUP BY user_id""",
    ),
    "raw_comments": (
        (),
        """
        SELECT CAST(doc_id AS VARCHAR) AS comment_id, lang AS video_id,
               CAST(substr(source, 4) AS INTEGER) AS req_id, text AS text_display,
               TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS scraped_at
        FROM documents""",
    ),
    "all_preprocessed": (
        ("raw_comments",),
        f"""
        SELECT *, CASE WHEN length(clean) >= 5 THEN clean END AS text_unicode,
               {sql_tokens("CASE WHEN length(clean) >= 5 THEN clean END")} AS tokens,
               CASE WHEN length(clean) >= 5 THEN NULL WHEN clean IS NOT NULL THEN 'TOO_SHORT'
                    WHEN text_display IS NULL THEN 'NULL_TEXT' ELSE 'NOT_SCRIPT' END AS reject_reason
        FROM (SELECT *, CASE WHEN {sql_ratio("text_display")} > {MIN_RATIO}
                        THEN {sql_clean("text_display")} END AS clean
              FROM raw_comments)""",
    ),
    "preprocessed_comments": (
        ("all_preprocessed",),
        """
        SELECT comment_id, req_id, text_unicode, tokens FROM all_preprocessed
        WHERE reject_reason IS NULL""",
    ),
    "predictions": (
        (),
        """
        SELECT CAST(doc_id AS INTEGER) AS id, CAST(doc_id AS VARCHAR) AS comment_id,
               CAST(substr(source, 4) AS INTEGER) AS req_id,
               CASE WHEN n_chars < 400 THEN 'negative' WHEN n_chars < 1500 THEN 'neutral'
                    ELSE 'positive' END AS model_prediction,
               ((doc_id * 37) % 1000) / 1000.0::DOUBLE AS model_confidence,
               TIMESTAMP '2024-02-01' + to_seconds(doc_id) AS created_at
        FROM documents""",
    ),
    "final_results": (
        ("predictions",),
        """
        SELECT id, comment_id, req_id, model_prediction AS emotion_class, 'MODEL' AS source
        FROM predictions""",
    ),
    "review_queue": (
        ("predictions", "raw_comments"),
        f"""
        SELECT p.id, p.comment_id, p.req_id, r.text_display AS text, p.model_prediction,
               p.model_confidence AS confidence,
               CASE WHEN p.model_prediction = 'neutral' THEN 'DONE' ELSE '{PENDING}' END AS status,
               p.created_at
        FROM predictions p JOIN raw_comments r USING (comment_id)
        WHERE p.model_confidence < 0.6""",
    ),
    "annotations": (
        (),
        """
        SELECT d.doc_id, d.text, d.lang, d.source,
               CASE WHEN l.toxic = 1 THEN ' Negative ' WHEN l.quality = 0 THEN 'NEUTRAL'
                    WHEN l.quality = 1 THEN 'positive'
                    WHEN d.lang = 'en' THEN 'nan' WHEN d.lang = 'fr' THEN 'None'
                    WHEN d.lang = 'de' THEN '' END AS sentiment
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    ),
    "labelled": (
        (),
        """
        SELECT d.doc_id, d.text, d.lang, d.source,
               CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 0 THEN 'neutral'
                    ELSE 'positive' END AS label
        FROM documents d JOIN labels l USING (doc_id)""",
    ),
    "evaluated": (
        ("labelled", "predictions"),
        """
        SELECT l.doc_id, l.text, l.lang, l.source, l.label AS truth,
               p.model_prediction AS predicted, p.model_confidence AS confidence
        FROM labelled l JOIN predictions p ON l.doc_id = p.id""",
    ),
    "outcomes": (
        ("evaluated",),
        "SELECT truth, predicted, count(*) AS n FROM evaluated GROUP BY ALL",
    ),
    "class_map": (
        (),
        "SELECT * FROM (VALUES "
        + ", ".join(f"('{k}', '{v}')" for k, v in CLASS_OF_LANG.items())
        + ") AS m(sentiment, class)",
    ),
}


def with_tables(sql: str, needs: Sequence[str]) -> str:
    """Put the definitions of the bound tables in front of a statement."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in TABLE_SQL[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return sql
    parts = ", ".join(f"{name} AS ({TABLE_SQL[name][1]})" for name in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {parts}, {body[5:]}"
    return f"WITH {parts} {body}"


# The same tables as DataFrames ----------------------------------------------------
def _seconds_after(start: str, seconds: Column) -> Column:
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def _status(event_type: Column) -> Column:
    first, *rest = STATUS_OF_EVENT.items()
    status = F.when(event_type == first[0], F.lit(first[1]))
    for event, name in rest:
        status = status.when(event_type == event, F.lit(name))
    return status


def _by_length(n_chars: Column) -> Column:
    return (
        F.when(n_chars < 400, "negative").when(n_chars < 1500, "neutral").otherwise("positive")
    )


def spread(df: DataFrame) -> DataFrame:
    """Distribute a given table that is one row group, and so one task, over the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """Given and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def given(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @property
    def documents(self) -> DataFrame:
        return self.given("documents")

    @property
    def texts(self) -> DataFrame:
        """Documents for work that costs much more per row than reading it does."""
        return spread(self.documents)

    @property
    def events(self) -> DataFrame:
        return self.given("events")

    @property
    def submissions(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").cast("int").alias("req_id"),
            "user_id",
            F.concat(F.lit(WATCH), "event_type").alias("video_url"),
            _status(F.col("event_type")).alias("status"),
            F.col("ts").alias("created_at"),
        )

    @property
    def requests(self) -> DataFrame:
        first = F.min_by("event_type", F.struct("ts", "event_id"))
        grouped = self.events.groupBy("user_id").agg(
            first.alias("first"),
            F.max_by("event_type", F.struct("ts", "event_id")).alias("last"),
            F.min("ts").alias("created_at"),
        )
        return grouped.select(
            F.col("user_id").cast("int").alias("req_id"),
            "user_id",
            F.concat(F.lit(WATCH), "first").alias("video_url"),
            _status(F.col("last")).alias("status"),
            "created_at",
        )

    @property
    def raw_comments(self) -> DataFrame:
        return self._raw_comments(self.documents)

    def _raw_comments(self, documents: DataFrame) -> DataFrame:
        return documents.select(
            F.col("doc_id").cast("string").alias("comment_id"),
            F.col("lang").alias("video_id"),
            F.substr("source", F.lit(4)).cast("int").alias("req_id"),
            F.col("text").alias("text_display"),
            _seconds_after("2024-01-01", F.col("doc_id")).alias("scraped_at"),
        )

    @property
    def all_preprocessed(self) -> DataFrame:
        rows = self._raw_comments(self.texts)
        return preprocess(rows, ranges=ACCENTS, keep=LATIN, min_ratio=MIN_RATIO)

    @property
    def preprocessed_comments(self) -> DataFrame:
        return accepted(self.all_preprocessed).select(
            "comment_id", "req_id", "text_unicode", "tokens"
        )

    @property
    def predictions(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").cast("int").alias("id"),
            F.col("doc_id").cast("string").alias("comment_id"),
            F.substr("source", F.lit(4)).cast("int").alias("req_id"),
            _by_length(F.col("n_chars")).alias("model_prediction"),
            ((F.col("doc_id") * 37) % 1000 / F.lit(1000.0)).alias("model_confidence"),
            _seconds_after("2024-02-01", F.col("doc_id")).alias("created_at"),
        )

    @property
    def final_results(self) -> DataFrame:
        p = self.predictions
        return p.select(
            "id",
            "comment_id",
            "req_id",
            F.col("model_prediction").alias("emotion_class"),
            F.lit("MODEL").alias("source"),
        )

    @property
    def review_queue(self) -> DataFrame:
        rows = self.predictions.filter("model_confidence < 0.6").join(
            self.raw_comments.select("comment_id", F.col("text_display").alias("text")),
            "comment_id",
        )
        status = F.when(F.col("model_prediction") == "neutral", "DONE").otherwise(PENDING)
        return rows.select(
            "id",
            "comment_id",
            "req_id",
            "text",
            "model_prediction",
            F.col("model_confidence").alias("confidence"),
            status.alias("status"),
            "created_at",
        )

    @property
    def annotations(self) -> DataFrame:
        joined = self.documents.join(self.given("labels"), "doc_id", "left")
        raw = (
            F.when(F.col("toxic") == 1, " Negative ")
            .when(F.col("quality") == 0, "NEUTRAL")
            .when(F.col("quality") == 1, "positive")
            .when(F.col("lang") == "en", "nan")
            .when(F.col("lang") == "fr", "None")
            .when(F.col("lang") == "de", "")
        )
        return joined.select("doc_id", "text", "lang", "source", raw.alias("sentiment"))

    @property
    def labelled(self) -> DataFrame:
        joined = self.documents.join(self.given("labels"), "doc_id")
        label = (
            F.when(F.col("toxic") == 1, "negative")
            .when(F.col("quality") == 0, "neutral")
            .otherwise("positive")
        )
        return joined.select("doc_id", "text", "lang", "source", label.alias("label"))

    @property
    def evaluated(self) -> DataFrame:
        scores = self.predictions.select(
            F.col("id").cast("long").alias("doc_id"),
            F.col("model_prediction").alias("predicted"),
            F.col("model_confidence").alias("confidence"),
        )
        return self.labelled.withColumnRenamed("label", "truth").join(scores, "doc_id")

    @property
    def class_map(self) -> DataFrame:
        return self.spark.createDataFrame(
            list(CLASS_OF_LANG.items()), "sentiment string, class string"
        )

    def finalizable(self) -> DataFrame:
        return finalizable(self.predictions, self.raw_comments, self.requests)

    def life_cycle(self) -> DataFrame:
        return self.events.select(
            F.col("user_id").alias("req_id"),
            _status(F.col("event_type")).alias("status"),
            "ts",
            "event_id",
        )


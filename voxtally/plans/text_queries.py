"""Text functions over all documents, addresses over all pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxtally.functions import text as T
from voxtally.functions.charsets import NWS, WORD
from voxtally.functions.urls import extract_video_id, is_video_url
from voxtally.operators.chains import linked_pages
from voxtally.operators.comments import flatten_comment_pages
from voxtally.operators.labels import drop_blank_text
from voxtally.operators.profile import drop_legacy_rows
from voxtally.operators.requests import valid_submissions
from voxtally.plans.bindings import (
    ACCENTS,
    LATIN,
    LEGACY,
    MIN_RATIO,
    MODERN,
    sql_clean,
    sql_collapse,
    sql_markers,
    sql_ratio,
    sql_replace,
    sql_strip,
    sql_tokens,
)
from voxtally.plans.registry import query

RULES = (("œ", "oe"), ("([éèê])n", "en"), ("ß", "ss"))


@query(
    "script_ratio",
    f"""SELECT doc_id, round({sql_ratio("text")}, 6) AS ratio,
               coalesce({sql_ratio("text")} > {MIN_RATIO}, false) AS in_script
        FROM documents""",
)
def script_ratio(t):
    return t.texts.select(
        "doc_id",
        F.round(T.script_ratio("text", ACCENTS), 6).alias("ratio"),
        T.is_script("text", ACCENTS, MIN_RATIO).alias("in_script"),
    )


@query("clean_text", f"SELECT doc_id, {sql_clean('text')} AS cleaned FROM documents")
def clean_text(t):
    return t.texts.select("doc_id", T.clean_text("text", LATIN).alias("cleaned"))


_LIGHT = sql_collapse(sql_replace(sql_replace("text", f"http{NWS}+|www{NWS}+"), f"@{WORD}+"))


@query("light_clean", f"SELECT doc_id, coalesce({_LIGHT}, '') AS cleaned FROM documents")
def light_clean(t):
    return t.texts.select("doc_id", T.light_clean("text").alias("cleaned"))


_REWRITTEN = "text"
for _pattern, _replacement in RULES:
    _REWRITTEN = sql_replace(_REWRITTEN, _pattern, _replacement)


@query("rewrite_rules", f"SELECT doc_id, {_REWRITTEN} AS converted FROM documents")
def rewrite_rules(t):
    return t.texts.select("doc_id", T.apply_rewrite_rules("text", RULES).alias("converted"))


_IS_LEGACY = f"coalesce({sql_markers('text', LEGACY)} > {sql_markers('text', MODERN)}, false)"


@query(
    "legacy_encoding_flag",
    f"""SELECT doc_id, {sql_markers("text", LEGACY)} AS legacy_score,
               {sql_markers("text", MODERN)} AS unicode_score, {_IS_LEGACY} AS is_legacy
        FROM documents""",
)
def legacy_encoding_flag(t):
    return t.texts.select(
        "doc_id",
        T.marker_score("text", LEGACY).alias("legacy_score"),
        T.marker_score("text", MODERN).alias("unicode_score"),
        T.is_legacy_encoded("text", LEGACY, MODERN).alias("is_legacy"),
    )


@query("drop_legacy_rows", f"SELECT doc_id, text FROM documents WHERE NOT {_IS_LEGACY}")
def legacy_rows_dropped(t):
    return drop_legacy_rows(t.texts.select("doc_id", "text"), legacy=LEGACY, modern=MODERN)


@query(
    "min_length",
    f"SELECT doc_id, text FROM documents WHERE length({sql_clean('text', ACCENTS)}) >= 5",
)
def min_length(t):
    cleaned = T.clean_text("text", ACCENTS)
    return t.texts.filter(T.has_min_length(cleaned, 5)).select("doc_id", "text")


@query(
    "tokenize",
    f"""SELECT doc_id, array_to_string({sql_tokens("text")}, '|') AS tokens,
               CAST(len({sql_tokens("text")}) AS INTEGER) AS token_count
        FROM documents""",
)
def tokenize(t):
    tokens = t.texts.select("doc_id", T.tokenize("text").alias("tokens"))
    return tokens.select(
        "doc_id", F.array_join("tokens", "|").alias("tokens"), F.size("tokens").alias("token_count")
    )


_SEGMENTED = sql_replace(sql_replace("text", f"[{LATIN}]+", r" \0 "), "[ÀÇÉÈÊàçéèêäöü]", r" \0")


@query(
    "segment_script_runs",
    f"SELECT doc_id, {sql_collapse(_SEGMENTED)} AS segmented FROM documents",
)
def segment_script_runs(t):
    segmented = T.segment_script_runs("text", LATIN, "[ÀÇÉÈÊàçéèêäöü]")
    return t.texts.select("doc_id", segmented.alias("segmented"))


@query(
    "preprocess_comments",
    """SELECT comment_id, req_id, text_unicode, array_to_string(tokens, '|') AS tokens,
              CAST(len(tokens) AS INTEGER) AS token_count, reject_reason
       FROM all_preprocessed""",
    ["all_preprocessed"],
)
def preprocess_comments(t):
    return t.all_preprocessed.select(
        "comment_id",
        "req_id",
        "text_unicode",
        F.array_join("tokens", "|").alias("tokens"),
        "token_count",
        "reject_reason",
    )


@query(
    "reject_reasons",
    """SELECT req_id, coalesce(reject_reason, 'ACCEPTED') AS outcome, count(*) AS n
       FROM all_preprocessed GROUP BY ALL""",
    ["all_preprocessed"],
)
def reject_reasons(t):
    outcome = F.coalesce("reject_reason", F.lit("ACCEPTED")).alias("outcome")
    return t.all_preprocessed.groupBy("req_id", outcome).agg(F.count("*").alias("n"))


@query("text_preview", "SELECT doc_id, substr(text, 1, 60) AS preview FROM documents")
def text_preview(t):
    return t.documents.select("doc_id", T.text_preview("text", 60).alias("preview"))


@query(
    "drop_blank_text",
    f"""SELECT conv_id, turn, {sql_strip("text")} AS text FROM conversations
        WHERE {sql_strip("text")} NOT IN ('', 'nan')""",
)
def blank_text_dropped(t):
    return drop_blank_text(t.given("conversations").select("conv_id", "turn", "text"))


_HOST = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"
_PATH = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"


@query(
    "video_id_of_page",
    f"""SELECT page_id, nullif(CASE
            WHEN contains({_HOST}, '.net') THEN regexp_replace({_PATH}, '^/+', '')
            WHEN contains({_HOST}, '.example.') AND contains({_PATH}, '.html')
                THEN split_part({_PATH}, '/', -1)
            WHEN contains({_HOST}, '.example.')
                THEN url_decode(regexp_extract({_QUERY}, '(?:^|&)page=([^&]+)', 1))
            END, '') AS video_id
        FROM pages""",
)
def video_id_of_page(t):
    found = extract_video_id(
        "url", short_host=".net", long_host=".example.", clip_segment=".html", parameter="page"
    )
    return t.given("pages").select("page_id", found.alias("video_id"))


@query(
    "video_url_flag",
    r"""SELECT page_id, regexp_matches(url, '\.example\.com/[a-z]+/|//blog\.|\?page=') AS is_video
        FROM pages""",
)
def video_url_flag(t):
    patterns = (r"\.example\.com/[a-z]+/", r"//blog\.", r"\?page=")
    return t.given("pages").select("page_id", is_video_url("url", patterns).alias("is_video"))


@query(
    "valid_submissions",
    """SELECT req_id, user_id, video_url, split_part(video_url, '=', 2) AS video_id
       FROM submissions""",
    ["submissions"],
)
def submissions_checked(t):
    return valid_submissions(t.submissions).select("req_id", "user_id", "video_url", "video_id")


@query(
    "flatten_comment_pages",
    """
    WITH items AS (
        SELECT conv_id AS video_id, turn AS page, string_split(text, '. ') AS parts
        FROM conversations),
    flat AS (
        SELECT video_id, page, unnest(parts) AS text_display,
               generate_subscripts(parts, 1) - 1 AS position
        FROM items),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY page, position) AS r FROM flat)
    SELECT video_id, page, CAST(position AS INTEGER) AS position,
           video_id || '-' || page || '-' || position AS comment_id, text_display
    FROM ranked WHERE r <= 40""",
)
def comment_pages_flattened(t):
    # Every turn becomes one response page, every sentence a comment on it.
    sentences = t.given("conversations").select(
        F.col("conv_id").alias("video_id"),
        F.col("turn").alias("page"),
        F.split("text", r"\. ").alias("parts"),
    )

    def item(text, position):
        name = F.concat_ws("-", "video_id", "page", position)
        comment = F.struct(name.alias("id"), F.struct(text.alias("textDisplay")).alias("snippet"))
        return F.struct(F.struct(comment.alias("topLevelComment")).alias("snippet"))

    body = F.to_json(F.struct(F.transform("parts", item).alias("items")))
    pages = sentences.select("video_id", "page", body.alias("body"))
    return flatten_comment_pages(pages, max_per_video=40)


@query(
    "pages_linked_by_token",
    """
    WITH numbered AS (
        SELECT conv_id AS video_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k,
               count(*) OVER (PARTITION BY conv_id) AS n
        FROM conversations)
    SELECT video_id, turn,
           CAST(CASE WHEN video_id % 10 = 4 THEN NULL WHEN video_id % 10 = 3 AND k > 1 THEN k - 2 ELSE k END
                AS INTEGER) AS page,
           CASE WHEN video_id % 10 = 4 THEN 'LOOP' WHEN video_id % 10 = 3 AND k > 1 THEN 'BROKEN'
                ELSE 'LINKED' END AS page_state
    FROM numbered""",
)
def pages_in_order_of_tokens(t):
    # Every turn is a page; what one names is the token of the next. Some chains are cut behind
    # their second page, some are closed to a circle.
    turns = t.given("conversations").select(F.col("conv_id").alias("video_id"), "turn")
    order = Window.partitionBy("video_id").orderBy("turn")
    token = lambda turn: F.md5(F.concat_ws("-", "video_id", turn))
    first = token(F.min("turn").over(Window.partitionBy("video_id")))
    k, kind = F.row_number().over(order) - 1, F.col("video_id") % 10
    following = F.lead("turn").over(order)
    names = F.when(following.isNotNull(), token(following)).when(kind == 4, first)
    pages = turns.select(
        "video_id",
        "turn",
        F.when((k > 0) | (kind == 4), token(F.col("turn"))).alias("page_token"),
        F.when((kind == 3) & (k == 1), F.lit("lost")).otherwise(names).alias("next_token"),
    )
    return linked_pages(pages).select("video_id", "turn", "page", "page_state")

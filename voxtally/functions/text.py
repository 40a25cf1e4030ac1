"""Script filter, cleaning, tokenising and encoding checks for comment text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtally.functions.charsets import (
    BURMESE,
    BURMESE_EXTENDED,
    BURMESE_SYLLABLE_START,
    KEPT_PUNCTUATION,
    LEGACY_MARKERS,
    NWS,
    UNICODE_MARKERS,
    WORD,
    WS,
    WS_MEMBERS,
)

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_spaces(c: ColumnLike) -> Column:
    """Every run of whitespace becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(_col(c), f"{WS}+", " "))


def strip(c: ColumnLike) -> Column:
    """Remove whitespace of any kind from both ends."""
    return F.regexp_replace(_col(c), f"^{WS}+|{WS}+$", "")


def script_ratio(c: ColumnLike, ranges: str = BURMESE) -> Column:
    """Share of the characters that lie in ``ranges``; NULL for empty text.

    The characters outside the ranges are removed run by run and the rest is
    measured, so no array of single matches is ever built.
    """
    c = _col(c)
    inside = F.length(F.regexp_replace(c, f"[^{ranges}]+", ""))
    return F.try_divide(inside, F.length(c))


def is_script(c: ColumnLike, ranges: str = BURMESE, min_ratio: float = 0.3) -> Column:
    """True where strictly more than ``min_ratio`` of the text is in the script."""
    return F.coalesce(script_ratio(c, ranges) > F.lit(min_ratio), F.lit(False))


def clean_text(c: ColumnLike, keep: str = BURMESE) -> Column:
    """Drop links, mentions, tags and every character that is not kept.

    The order matters: a link is removed before the mentions inside it could be
    taken for mentions of their own. Mentions and tags cannot run into each other
    and go in one pass.
    """
    c = F.regexp_replace(_col(c), f"http{NWS}+", "")
    c = F.regexp_replace(c, f"[@#]{WORD}+", "")
    c = F.regexp_replace(c, f"[^{keep}{WS_MEMBERS}{KEPT_PUNCTUATION}]+", "")
    return collapse_spaces(c)


def light_clean(c: ColumnLike) -> Column:
    """Drop links and mentions only; NULL and blank text give an empty string."""
    c = F.regexp_replace(_col(c), f"http{NWS}+|www{NWS}+", "")
    c = F.regexp_replace(c, f"@{WORD}+", "")
    return F.coalesce(collapse_spaces(c), F.lit(""))


def apply_rewrite_rules(c: ColumnLike, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply ``(pattern, replacement)`` pairs in their order.

    Meant for turning a legacy encoding into Unicode with the user's own table.
    Text for which the rules give nothing is kept as it was.
    """
    c = _col(c)
    return F.coalesce(reduce(lambda acc, rule: F.regexp_replace(acc, *rule), rules, c), c)


def marker_score(c: ColumnLike, markers: Sequence[str]) -> Column:
    """How many of the marker characters occur at least once."""
    c = _col(c)
    return reduce(lambda a, b: a + b, (F.contains(c, F.lit(m)).cast("int") for m in markers))


def is_legacy_encoded(
    c: ColumnLike,
    legacy: Sequence[str] = LEGACY_MARKERS,
    modern: Sequence[str] = UNICODE_MARKERS,
) -> Column:
    """True where more legacy than modern marker characters occur; NULL gives False."""
    return F.coalesce(marker_score(c, legacy) > marker_score(c, modern), F.lit(False))


def has_min_length(c: ColumnLike, n: int = 5) -> Column:
    return F.length(_col(c)) >= F.lit(n)


def tokenize(c: ColumnLike) -> Column:
    """Whitespace tokens, empty ones left out."""
    return F.array_remove(F.split(_col(c), f"{WS}+"), "")


def segment_script_runs(
    c: ColumnLike,
    ranges: str = BURMESE_EXTENDED,
    boundary: str = BURMESE_SYLLABLE_START,
) -> Column:
    """Put spaces around every run of the script and before each boundary in it.

    ``boundary`` must only match characters of ``ranges``; text outside the runs
    stays as it is, apart from whitespace being collapsed.
    """
    c = F.regexp_replace(_col(c), f"[{ranges}]+", " $0 ")
    return collapse_spaces(F.regexp_replace(c, boundary, " $0"))


def text_preview(c: ColumnLike, n: int = 60) -> Column:
    """The first ``n`` characters, for showing."""
    return F.substring(_col(c), 1, n)


def is_blank(c: ColumnLike) -> Column:
    """True for NULL, for whitespace only and for a stringified missing value."""
    s = strip(c)
    return s.isNull() | s.isin("", "nan")

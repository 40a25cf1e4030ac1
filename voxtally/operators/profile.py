"""Data-quality profiles: one aggregation per question, results in long form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from voxtally.functions.keys import compact, content_key
from voxtally.functions.text import is_legacy_encoded, tokenize
from voxtally.operators.frequent import CAPACITY, most_frequent
from voxtally.operators.quantiles import exact_quantiles


def _long(df: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot([], list(columns), name, value)


def value_counts(
    df: DataFrame, column: str, top: int | None = None, order: bool = True
) -> DataFrame:
    """Rows and share in percent per value, most frequent first, NULL left out.

    The total is a scalar subquery over the counted values. It reads the same
    shuffle as the counts, and no task has to see all values at once.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    shares = counts.withColumn("percentage", F.col("n") * F.lit(100.0) / total)
    if order or top is not None:
        shares = shares.orderBy(F.col("n").desc(), column)
    return shares if top is None else shares.limit(top)


def missing_profile(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """NULL (and NaN) rows per column with their share in percent."""
    checks = []
    for f in df.schema.fields:
        missing = F.col(f.name).isNull()
        if isinstance(f.dataType, DoubleType | FloatType):
            missing = missing | F.isnan(f.name)
        checks.append(F.count_if(missing).alias(f.name))
    counted = df.agg(*checks, F.count("*").alias("_rows"))
    long = counted.unpivot(["_rows"], df.columns, "column_name", "missing")
    profile = long.select(
        "column_name",
        "missing",
        F.try_divide(F.col("missing") * F.lit(100.0), F.col("_rows")).alias("percentage"),
    )
    return profile.filter(F.col("missing") > 0) if only_missing else profile


def n_unique(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values per column, NULL not counted. Long texts are told apart by digest."""
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    keys = {c: compact(c) if c in strings else F.col(c) for c in columns}
    counts = df.agg(*[F.countDistinct(key).alias(c) for c, key in keys.items()])
    return _long(counts, columns, "column_name", "n_unique")


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def duplicate_stats(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows, rows that repeat an earlier one, and their share in percent.

    ``subset`` names the columns that make two rows the same, all by default.
    """
    key = content_key(*(subset or df.columns), schema=df.schema)
    counted = df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("_distinct"))
    repeats = F.col("rows") - F.col("_distinct")
    return counted.select(
        "rows",
        repeats.alias("duplicates"),
        F.try_divide(repeats * F.lit(100.0), F.col("rows")).alias("percentage"),
    )


def encoding_audit(df: DataFrame, text: str = "text", **markers: Sequence[str]) -> DataFrame:
    """How many texts are in the legacy encoding and how many are not."""
    legacy = F.count_if(is_legacy_encoded(text, **markers))
    counted = df.agg(legacy.alias("legacy"), (F.count("*") - legacy).alias("unicode"))
    total = F.col("legacy") + F.col("unicode")
    long = counted.withColumn("_total", total).unpivot(
        ["_total"], ["legacy", "unicode"], "encoding", "n"
    )
    share = F.try_divide(F.col("n") * F.lit(100.0), F.col("_total"))
    return long.select("encoding", "n", share.alias("percentage"))


def drop_legacy_rows(df: DataFrame, text: str = "text", **markers: Sequence[str]) -> DataFrame:
    return df.filter(~is_legacy_encoded(text, **markers))


def with_text_lengths(df: DataFrame, text: str = "text") -> DataFrame:
    """Characters and whitespace-separated words of every text."""
    return df.withColumns(
        {"text_length_chars": F.length(text), "text_length_words": F.size(tokenize(text))}
    )


def text_length_profile(df: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    measured = with_text_lengths(df.select(*by, text), text)
    stats: Mapping[str, str] = {"chars": "text_length_chars", "words": "text_length_words"}
    aggs = [
        fn(col).alias(f"{label}_{name}")
        for name, col in stats.items()
        for label, fn in (("min", F.min), ("avg", F.avg), ("max", F.max))
    ]
    return measured.groupBy(*by).agg(F.count("*").alias("n"), *aggs)


def text_length_quartiles(df: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Exact quartiles of the lengths in characters and words per group, one row each."""
    stats = {"chars": "text_length_chars", "words": "text_length_words"}
    measured = with_text_lengths(df.select(*by, text), text)
    found = exact_quantiles(measured, by, list(stats.values()), (0.25, 0.5, 0.75))
    names = {f"q{round(s * 100)}_{n}": (c, s) for n, c in stats.items() for s in (0.25, 0.5, 0.75)}
    one = lambda c, s: F.max(F.when((F.col("column") == c) & (F.col("share") == s), F.col("value")))
    return found.groupBy(*by).agg(*(one(c, s).alias(name) for name, (c, s) in names.items()))


def value_counts_by_summaries(df: DataFrame, column: str, top: int, capacity: int = CAPACITY) -> DataFrame:
    """The rows of :func:`value_counts` with ``top``, for a column with very many values."""
    counts = most_frequent(df, column, top, capacity)
    total = df.agg(F.count(column)).scalar()
    shares = counts.withColumn("percentage", F.col("n") * F.lit(100.0) / total)
    return shares.orderBy(F.col("n").desc(), column)

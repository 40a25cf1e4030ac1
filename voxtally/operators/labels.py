"""Putting labels into shape for training and evaluation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from voxtally.functions.labels import SENTIMENTS, is_null_like
from voxtally.functions.text import is_blank, strip
from voxtally.operators.sides import bounded_broadcast

# Fixed values -----------------------------------------------------------------
TEXT_COLUMNS = ("cleaned_text", "cleaned_test", "text")
LABEL_COLUMNS = ("emotion_class", "emotion", "label")
UNMAPPED_LABEL = "Neutral"
# ------------------------------------------------------------------------------


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def resolve_column(
    df: DataFrame, candidates: Sequence[str], fallback: str | None = None
) -> str:
    """The first candidate the table has.

    ``fallback`` says what to do when it has none: ``"string"`` takes the first
    string column, ``"first"`` the first column, None raises.
    """
    for name in candidates:
        if name in df.columns:
            return name
    if fallback == "string":
        for f in df.schema.fields:
            if isinstance(f.dataType, StringType):
                return f.name
    elif fallback == "first" and df.columns:
        return df.columns[0]
    raise ValueError(f"none of {list(candidates)} in {df.columns}")


def with_standard_columns(
    df: DataFrame,
    text: Sequence[str] = TEXT_COLUMNS,
    label: Sequence[str] = LABEL_COLUMNS,
) -> DataFrame:
    """Rename whatever the text and label columns are called to ``text`` and ``label``."""
    names = {resolve_column(df, label): "label", resolve_column(df, text, "string"): "text"}
    taken = set(names.values()) - set(names)
    return df.drop(*taken).withColumnsRenamed(names)


def select_existing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Those of the columns that the table has, in the given order."""
    return df.select(*[c for c in columns if c in df.columns])


def drop_null_like_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(~is_null_like(strip(label)))


def keep_labels(
    df: DataFrame, domain: Sequence[str] = SENTIMENTS, label: str = "label"
) -> DataFrame:
    return df.filter(F.col(label).isin(*domain))


def drop_blank_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Leave out rows without text; the text of the others is stripped."""
    return df.filter(~is_blank(text)).withColumn(text, strip(text))


def lookup_label(
    df: DataFrame,
    column: str,
    mapping: DataFrame,
    source: str = "sentiment",
    target: str = "class",
    name: str = "emotion_class",
    default: str | None = None,
    position: str | None = None,
) -> DataFrame:
    """Map a raw label to its class through an annotation table.

    Keys are compared stripped. A key listed several times counts once, with the
    class of its last entry by ``position``, which ``read_annotations`` gives. Without a
    position no entry is the last one: a key with different classes is then an error. The
    table is sent to every task after it has been found to be small; a larger one is joined
    by shuffling, where labels with very many rows are split.
    """
    last = F.max_by(target, position) if position else F.max(target)
    unique = mapping.groupBy(strip(source).alias("_key")).agg(last.alias(name), F.count_distinct(target).alias("_classes"))
    if position is None:
        unclear = unique.filter("_classes > 1").select("_key").limit(5).collect()
        if unclear:
            raise ValueError(f"different classes and no position: {[r['_key'] for r in unclear]}")
    unique = unique.drop("_classes")
    keyed = df.withColumn("_key", strip(column))
    joined = keyed.join(bounded_broadcast(unique), "_key", "left").drop("_key")
    if default is None:
        return joined
    return joined.withColumn(name, F.coalesce(name, F.lit(default)))


def map_dataframe(spark, mapping: Mapping[str, str], source: str, target: str) -> DataFrame:
    """A Python mapping as a two-column table."""
    return spark.createDataFrame(list(mapping.items()), f"{source} string, {target} string")


def unmapped_labels(
    df: DataFrame, column: str, mapping: DataFrame, source: str = "sentiment"
) -> DataFrame:
    """Distinct labels the annotation table does not cover."""
    seen = df.select(strip(column).alias(column)).filter(F.col(column).isNotNull()).distinct()
    keys = mapping.select(strip(source).alias(column)).distinct()
    return seen.join(keys, column, "left_anti")


def distinct_pairs(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def concat_datasets(*parts: DataFrame) -> DataFrame:
    """Stack tables by column name; columns a table lacks become NULL."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first

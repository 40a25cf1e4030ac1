"""Digests used for grouping wide values and for reproducible orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType


def _printed(c: Column | str, schema: StructType | None) -> Column:
    """A value as text that differs wherever the values do.

    Needs the schema for nested values, which are printed as JSON with their NULLs, and for
    fractions, of which both zeros are one value.
    """
    kind = schema[c].dataType if schema is not None and isinstance(c, str) and c in schema.names else None
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(kind, (ArrayType, StructType, MapType)):
        return F.when(c.isNotNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}))
    if isinstance(kind, (DoubleType, FloatType)):
        c = c + F.lit(0.0).cast(kind)
    return c.cast("string")


def content_key(*cols: Column | str, schema: StructType | None = None) -> Column:
    """SHA-256 over the values of some columns, NULL kept apart from every value.

    Rows are grouped by this instead of by the text, so a shuffle carries 64
    characters per row however long the texts are. With the schema of the rows, nested
    columns may be among them.
    """
    parts = [F.coalesce(F.sha2(_printed(c, schema), 256), F.lit("-")) for c in cols]
    return parts[0] if len(parts) == 1 else F.sha2(F.concat_ws(":", *parts), 256)


def seeded_order(seed: int, key: Column | str) -> Column:
    """A pseudo-random order over a unique key that every run and engine repeats."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def compact(c: Column | str) -> Column:
    """A string, or its digest where it is longer than that would be; NULL stays NULL.

    Digests are marked and longer than every string that is kept, so the two
    cannot be mistaken for each other.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > 64, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c)

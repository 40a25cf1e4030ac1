"""Deciding whether one side of a join may go to every task, in one pass over what makes it."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.session import shared_folder

# Rows of a few key columns each, and the bytes of their values: some megabytes per executor.
MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 16 << 20
# A wider row makes its side a large one, so what is fetched to decide is bounded too.
MAX_ROW_BYTES = 1 << 10


def fetched_rows(df: DataFrame, max_rows: int | None = None) -> pa.Table | None:
    """The rows of ``df`` if they are few and narrow, else None.

    One pass computes the rows, their number and their bytes: at most one row more than
    the bound comes to the driver, none of them wider than ``MAX_ROW_BYTES``.
    """
    limit = MAX_BROADCAST_ROWS if max_rows is None else max_rows
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    sized = df.select("*", (size > MAX_ROW_BYTES).alias("_wide"))
    narrow = [F.when(~F.col("_wide"), F.col(c)).alias(c) for c in df.columns]
    rows = sized.select("_wide", *narrow).limit(limit + 1).toArrow()
    if rows.num_rows > limit or pc.any(rows.column("_wide")).as_py():
        return None
    rows = rows.drop_columns(["_wide"])
    return rows if rows.nbytes <= MAX_BROADCAST_BYTES else None


def _local(df: DataFrame, max_rows: int | None) -> DataFrame | None:
    rows = fetched_rows(df, max_rows)
    return None if rows is None else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def bounded_broadcast(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """A side to broadcast if it has few rows and bytes, else the side unchanged.

    The optimizer cannot know how few rows a filter or an aggregation leaves. It
    would shuffle the other side, which here is a table of comments with their
    texts, before the count is known at run time. So the side is fetched up to a bound
    of rows and bytes. Within both it is from then on a local table with a hint, and
    what made it is not computed again, whatever is built on it; beyond them the join is
    left to a shuffle, in which adaptive execution splits the keys that are frequent.

    Only for sides of a few key columns, and for rows that are the same whenever
    they are computed.
    """
    small = _local(df, max_rows)
    return df if small is None else small


def settled(df: DataFrame, purpose: str, max_rows: int | None = None) -> DataFrame:
    """As :func:`bounded_broadcast`, but a large side is written once and read from there.

    For sides that are used twice, or that other sides are made of.
    """
    small = _local(df, max_rows)
    return written(df, purpose) if small is None else small


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder; what made them is not computed again."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

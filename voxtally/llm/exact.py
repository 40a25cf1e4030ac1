"""Exact duplicates by distributed radix partitioning of the whole texts.

The key of a text is its length in bytes, eight bytes wide, and then its bytes.
Texts are split by successive digits of that key, most significant first: the
length with the first bytes, then ever wider runs of bytes. A group that has become
a single text is done, and so is a group whose texts have ended. Two texts are
equal when no digit ever separated them; no digest decides anything.

Each step counts by (group, digit), which Spark combines on the map side, and
joins the written counts back; adaptive execution may split that join, since nothing
above it needs a group together. Only texts that still share everything so far take part
in the next step, with what is left of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import (
    LOWER,
    MAX_BROADCAST_IDS,
    binary_array,
    keys_repeat,
    numbered_rows,
    only,
    text_bytes,
    written,
)

# Bytes of the first digit besides the length, and how much wider each later digit is.
HEAD_BYTES = 16
FIRST_DIGIT = 256
WIDER = 16


def _normalised(key: str, text: str):
    """Batches of (key, length, head, sha256) or, with the body, (key, body)."""

    def lower(batch: pa.RecordBatch) -> pa.Array:
        data, offsets = text_bytes(batch.column(text))
        return binary_array(LOWER[data], offsets)

    def heads(batches):
        for batch in batches:
            body = lower(batch)
            data, at = text_bytes(body)
            whole = memoryview(data)
            digests = [
                hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())
            ]
            head = pc.binary_slice(body, 0, HEAD_BYTES).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(np.diff(at)), head, pa.array(digests, pa.string())],
                ["doc_id", "bytes", "head", "text_sha256"],
            )

    def bodies(batches):
        for batch in batches:
            body = lower(batch).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(key), body], ["doc_id", "rest"])

    return heads, bodies


def _next_digit(state: DataFrame, skip: int, width: int, *more: str) -> DataFrame:
    """Cut the next digit off what is left of each text, ``skip`` bytes from its start."""
    return state.select(
        "doc_id",
        "g",
        *more,
        F.expr(f"substring(rest, {skip + 1}, {width})").alias("digit"),
        F.expr(f"substring(rest, {skip + width + 1})").alias("rest"),
    )


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one per document.

    Texts are equal when identical after lower-casing A-Z; NULL counts as empty, so
    all NULL and empty texts form one group. Of a group the row with the largest key stays;
    if that is the key of several equal rows, one of them. A NULL key is left out, since
    no row can be named by it. Rows that share a key are rows of their own: each is
    counted and comes out. The digest is reported and decides nothing. An empty table gives no rows. Other columns are
    not read.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    source = source.filter(F.col("doc_id").isNotNull())
    if not keys_repeat(source, "doc_id"):
        return _groups(source, "doc_id", "text")
    rows, number = numbered_rows(source, "doc_id", "text")
    found = _groups(rows, number, "text")
    names = rows.select(F.col(number).alias("_row"), F.col("doc_id").alias("_name"))
    own = found.withColumnRenamed("doc_id", "_row").join(names, "_row").withColumnRenamed("_name", "doc_id").drop("_row")
    kept = own.withColumnRenamed("keep_id", "_row").join(names, "_row").withColumnRenamed("_name", "keep_id")
    return kept.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_one_of_equal(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that :func:`exact_duplicates` keeps, with all their columns.

    Of rows that are equal in key and text one stays, so a row that was delivered twice
    goes on once.
    """
    rows, own = docs.filter(F.col(key).isNotNull()), key
    if keys_repeat(rows, key):
        rows, own = numbered_rows(rows, key, text)
    gone = written(exact_duplicates(rows, own, text).filter(~F.col("kept")).select("doc_id"), "exact-gone")
    if gone.count() <= MAX_BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = rows.join(gone.withColumnRenamed("doc_id", own), own, "left_anti")
    return kept.select(*docs.columns)


def _groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """:func:`exact_duplicates` for unique keys."""
    heads, bodies = _normalised(key, text)
    source = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    source = source.filter(F.col(key).isNotNull())
    read = written(
        source.mapInArrow(heads, "doc_id long, bytes long, head binary, text_sha256 string"), "exact-heads"
    )
    # Counts are written before they are joined: only then can the join of a hot group be split.
    groups = read.groupBy("bytes", "head").agg(F.max("doc_id").alias("g"), F.count("*").alias("n"))
    groups = written(groups.filter("n > 1"), "exact-groups")
    first = read.join(groups, ["bytes", "head"], "left").select(
        "doc_id", F.coalesce("g", "doc_id").alias("g"), F.coalesce("n", F.lit(1)).alias("n"), "bytes", "text_sha256"
    )
    first = written(first, "exact-first")
    ended = (F.col("n") == 1) | (F.col("bytes") <= HEAD_BYTES)
    done = [first.filter(ended).select("doc_id", "g", "n")]

    open_ids = first.filter(~ended)
    longest = open_ids.agg(F.max("bytes")).first()[0]
    if longest is not None:
        ids = open_ids.select("doc_id")
        rest = only(source, ids.withColumnRenamed("doc_id", key), key).mapInArrow(
            bodies, "doc_id long, rest binary"
        )
        at, width = HEAD_BYTES, FIRST_DIGIT
        state = rest.join(open_ids.select("doc_id", "g"), "doc_id")
        state = written(_next_digit(state, HEAD_BYTES, width), "exact-digit")
        while at < longest:
            parts = state.groupBy("g", "digit").agg(F.max("doc_id").alias("h"), F.count("*").alias("n"))
            parts = written(parts, "exact-counts")
            split = state.select("doc_id", "g", "digit", "rest").join(parts, ["g", "digit"]).select(
                "doc_id", F.col("h").alias("g"), "n", "rest"
            )
            at, width = at + width, width * WIDER
            split = written(_next_digit(split, 0, width, "n"), "exact-digit")
            ended = (F.col("n") == 1) | (F.octet_length("digit") == 0)
            done.append(split.filter(ended).select("doc_id", "g", "n"))
            state = split.filter(~ended)
    groups = done[0]
    for more in done[1:]:
        groups = groups.union(more)
    return groups.join(first.select("doc_id", "text_sha256"), "doc_id").select(
        "doc_id",
        F.col("g").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("doc_id") == F.col("g")).alias("kept"),
        "text_sha256",
    )

"""Shards of nearly equal bytes by longest-processing-time scheduling.

Groups of equal texts stay together. Groups are handed out in descending size, each
to the least loaded shard, which a heap gives. Groups of one size are alike to the
heap, so it is fed with how many groups there are of each size and not with the
groups: the driver sees one row per size class, never a document, and gives out all
rounds of a class at once. Classes are exact
below 2 ** 12 bytes and keep 12 leading bits above, so there are at most 4096 for each
doubling of the size, whatever the input. Which group of a class goes to which shard
follows from its rank in the class, counted in parts that are equally large.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtally.llm.common import text_bytes, written

CLASS_BITS = 12
ROW_OVERHEAD = 16
# Pairs of a class and a shard, 12 bytes each, that are sent to every task.
MAX_PLAN = 1_000_000
# Rows that one task ranks.
PART_ROWS = 50_000


def _taken(loads: np.ndarray, size: float, count: int) -> np.ndarray:
    """How many of ``count`` groups of one size each shard gets, each going to the least loaded.

    A shard takes its next group when its load is the least, so the groups go to the
    ``count`` smallest of all ``load + i * size``. All of these below some level are taken
    whatever the order; the level is found by bisection, and a heap gives out the last round.
    """
    behind = (loads - loads.min()) / size

    def below(level: int) -> np.ndarray:
        return np.maximum(np.ceil(level - behind), 0).astype(np.int64)

    low, high = 0, count + 1
    while high - low > 1:
        level = (low + high) // 2
        low, high = (level, high) if int(below(level).sum()) <= count else (low, level)
    taken = below(low)
    left = count - int(taken.sum())
    heap = list(zip((loads + taken * size).tolist(), range(len(loads))))
    heapq.heapify(heap)
    for _ in range(left):
        taken[heapq.heappop(heap)[1]] += 1
    return taken


def schedule(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """Longest-processing-time scheduling of (class, count, bytes) rows.

    Gives for every class the shards that take groups of it and, next to them, how
    many groups they and the shards before them take. Equal loads go to the lowest
    shard. A class costs about as many steps as there are shards, however many groups
    it has and however uneven the loads are.
    """
    loads = np.zeros(shards)
    out = []
    for name, count, total in sorted(classes, key=lambda c: -c[2] / c[1]):
        size = total / count
        taken = _taken(loads, size, count)
        loads = loads + taken * size
        users = np.flatnonzero(taken)
        out.append((name, users.tolist(), np.cumsum(taken[users]).tolist()))
    return out


def _measured(key: str, text: str):
    def measure(batches):
        import hashlib

        for batch in batches:
            data, at = text_bytes(batch.column(text))
            whole = memoryview(data)
            spans = list(zip(at[:-1].tolist(), at[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array(np.diff(at) + ROW_OVERHEAD),
                    pa.array([zlib.crc32(whole[a:b]) for a, b in spans], pa.int64()),
                    pa.array([hashlib.sha256(whole[a:b]).digest() for a, b in spans], pa.binary()),
                ],
                ["doc_id", "size", "text_crc32", "content"],
            )

    return measure


def _size_class(size):
    """The size with all but its leading bits cleared."""
    bits = F.floor(F.log2(size.cast("double"))).cast("int")
    drop = F.greatest(bits - F.lit(CLASS_BITS - 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop)


def _ranked(df: DataFrame, by: str, order: str, name: str, rows: int) -> DataFrame:
    """Number the rows of each ``by`` from 0 without gaps, in parts of about ``PART_ROWS`` rows."""
    parts = max(1, -(-rows // PART_ROWS))
    df = df.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(parts)))
    counts = df.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(by, "_part").orderBy(order))
    ranked = df.withColumn("_local", local).join(counts, [by, "_part"])
    return ranked.withColumn(name, F.col("_before") + F.col("_local") - 1).drop("_part", "_local", "_before")


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one per document.

    The law is ``bytes``: shard sizes are as equal as whole groups of equal texts let
    them be. ``slot`` numbers the rows of a shard from 0. ``grown_shard`` is NULL under
    this law. A NULL text has no bytes and is equal to an empty one. Keys are unique;
    rows without a key are left out. An empty table gives no rows.
    """
    source = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    source = source.filter(F.col(key).isNotNull())
    rows = written(
        source.mapInArrow(
            _measured(key, text), "doc_id long, size long, text_crc32 long, content binary"
        ),
        "shard-rows",
    )
    groups = rows.groupBy("content").agg(
        F.min("doc_id").alias("first"), F.sum("size").alias("bytes")
    )
    groups = written(
        groups.select("content", "first", "bytes", _size_class(F.col("bytes")).alias("class")), "shard-groups"
    )
    # One row per size class: the only thing that the driver sees.
    classes = groups.groupBy("class").agg(F.count("*"), F.sum("bytes")).toArrow()
    plan = schedule(list(zip(*(c.to_pylist() for c in classes.columns))), shards)
    plan_rows = docs.sparkSession.createDataFrame(
        pa.table(
            {
                "class": pa.array([p[0] for p in plan], pa.int64()),
                "users": pa.array([p[1] for p in plan], pa.list_(pa.int32())),
                "upto": pa.array([p[2] for p in plan], pa.list_(pa.int64())),
            }
        )
    )
    # A plan is a number or two for each shard and size class. A large one is joined by a
    # shuffle: it has one row for a class, so a frequent class can be split.
    if sum(len(users) for _, users, _ in plan) <= MAX_PLAN:
        plan_rows = F.broadcast(plan_rows)
    else:
        plan_rows = written(plan_rows, "shard-plan")
    total = groups.count()
    placed = _ranked(groups, "class", "first", "rank", total).join(plan_rows, "class")
    # The first user whose running count is above the rank.
    index = F.size(F.filter("upto", lambda n: n <= F.col("rank")))
    placed = placed.select("content", F.get("users", index).alias("shard"))
    out = written(
        rows.join(placed, "content").select("doc_id", "size", "text_crc32", "shard"), "shard-placed"
    )
    out = _ranked(out, "shard", "doc_id", "slot", out.count())
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

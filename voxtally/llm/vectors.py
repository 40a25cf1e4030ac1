"""Near-duplicate vectors by an epsilon grid order join.

For unit vectors a cosine of at least c is a distance of at most eps = sqrt(2 - 2c).
Vectors are rotated onto their leading principal directions (fitted on a bounded
sample; a rotation keeps distances, so a poor fit costs time and no result), sorted
by the cells of a grid of width eps in that order, and cut into intervals of the
sequence. Pairs of intervals are joined recursively: starting with the whole sequence
against itself, a pair is split into its parts unless the boxes around both prove
that nothing in them is within eps. The recursion is a join of interval numbers with
interval boxes, one level at a time; vectors only move for the pairs that are left at
the end, and inside a task the recursion goes on to small blocks. Every pair found is
decided by the cosine in double precision.

A task adds up how many links each vector has and returns, of the links, only a
forest that connects the same vectors, so a large group never becomes its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtally.llm.common import components, keys_repeat, merged_rows, numbered_rows, written

COSINE = 0.9
SAMPLE = 20_000
DIRECTIONS = 8
LEAF = 8192
FAN = 8
BLOCK = 512
# Rounding of boxes and distances; far below what separates two vectors of single precision.
SLACK = 1e-6


def _valid(vector: str) -> F.Column:
    """Not NULL, no NULL or non-finite component, not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _rows(column, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(-1, width)


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = x.astype(np.float64)
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _directions(sample: np.ndarray) -> np.ndarray:
    """Leading principal directions as columns."""
    centred = sample - sample.mean(axis=0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    return np.ascontiguousarray(vectors[:, ::-1][:, :DIRECTIONS])


def _located(key: str, vector: str, width: int, axes: np.ndarray, eps: float):
    def locate(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column(vector), width)
            cells = np.floor(_units(x) @ axes / eps).astype(np.int32)
            data = [row.tobytes() for row in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *(pa.array(c) for c in np.ascontiguousarray(cells.T)), pa.array(data, pa.binary())],
                ["vec_id", *(f"c{i}" for i in range(cells.shape[1])), "raw"],
            )

    return locate


def _intervals(width: int, axes: np.ndarray, kind: type, leaf: int):
    """Cut a sorted partition into intervals of ``leaf`` vectors, each with its box."""

    def cut(batches):
        part = TaskContext.get().partitionId()
        ids, raws, number = [], [], 0

        def interval(ids, raws):
            data = b"".join(raws)
            y = _units(np.frombuffer(data, kind).reshape(-1, width)) @ axes
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 24 | number], pa.int64()),
                    pa.array([y.min(0).tolist()], pa.list_(pa.float64())),
                    pa.array([y.max(0).tolist()], pa.list_(pa.float64())),
                    pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                    pa.array([data], pa.binary()),
                ],
                ["place", "lo", "hi", "ids", "raws"],
            )

        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            raws += batch.column("raw").to_pylist()
            while len(ids) >= leaf:
                yield interval(ids[:leaf], raws[:leaf])
                ids, raws, number = ids[leaf:], raws[leaf:], number + 1
        if ids:
            yield interval(ids, raws)

    return cut


def _apart(lo1, hi1, lo2, hi2) -> F.Column:
    """Squared distance of two boxes, from arrays of their corners."""
    gap = F.zip_with(lo1, hi2, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    pag = F.zip_with(lo2, hi1, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    return F.aggregate(
        F.zip_with(gap, pag, lambda a, b: F.greatest(a, b)), F.lit(0.0), lambda s, x: s + x * x
    )


def _surviving(leaves: DataFrame, eps: float) -> DataFrame:
    """Pairs (i, j) of leaf numbers, i <= j, whose boxes are not provably apart."""
    k = len(leaves.first()["lo"])
    levels = [leaves.select("leaf", "lo", "hi")]
    top = leaves.agg(F.max("leaf")).first()[0]
    while top:
        low = [F.min(F.col("lo")[d]).alias(f"l{d}") for d in range(k)]
        high = [F.max(F.col("hi")[d]).alias(f"h{d}") for d in range(k)]
        up = levels[-1].groupBy(F.floor(F.col("leaf") / FAN).cast("long").alias("leaf")).agg(*low, *high)
        levels.append(
            written(
                up.select(
                    "leaf",
                    F.array(*(f"l{d}" for d in range(k))).alias("lo"),
                    F.array(*(f"h{d}" for d in range(k))).alias("hi"),
                ),
                "grid-level",
            )
        )
        top //= FAN
    pairs = levels[-1].select(F.col("leaf").alias("i"), F.col("leaf").alias("j"))
    for level in reversed(levels[:-1]):
        part = F.sequence(F.lit(0), F.lit(FAN - 1))
        pairs = pairs.select((F.col("i") * FAN).alias("i"), (F.col("j") * FAN).alias("j"))
        pairs = pairs.select("i", "j", F.explode(part).alias("p")).select((F.col("i") + F.col("p")).alias("i"), "j")
        pairs = pairs.select("i", "j", F.explode(part).alias("p")).select("i", (F.col("j") + F.col("p")).alias("j"))
        pairs = pairs.filter("i <= j")
        a = level.select(F.col("leaf").alias("i"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
        b = level.select(F.col("leaf").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        near = pairs.join(a, "i").join(b, "j")
        near = near.filter(_apart("lo1", "hi1", "lo2", "hi2") <= (eps + SLACK) ** 2)
        pairs = written(near.select("i", "j"), "grid-pairs")
    return pairs


def _boxes(y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.arange(0, len(y), size)
    return np.minimum.reduceat(y, cuts), np.maximum.reduceat(y, cuts)


def _joiner(width: int, axes: np.ndarray, cosine: float, eps: float, kind: type, block: int):
    """Joins the two intervals of a pair; they come one after another, side 0 first."""

    def join(batches):
        first = None
        for batch in batches:
            for i, j, side, ids, raws in zip(*(batch.column(c) for c in ("i", "j", "side", "ids", "raws"))):
                here = (
                    np.frombuffer(ids.as_py(), np.int64),
                    _units(np.frombuffer(raws.as_py(), kind).reshape(-1, width)),
                )
                if side.as_py() == 0:
                    first = here
                if i.as_py() == j.as_py() or side.as_py() == 1:
                    yield joined(i.as_py() == j.as_py(), *first, *here)

    def joined(same, ida, a, idb, b):
        lo1, hi1 = _boxes(a @ axes, block)
        lo2, hi2 = _boxes(b @ axes, block)
        n, m = len(a), 0 if same else len(b)
        links = np.zeros(n + m, np.int64)
        up = np.arange(n + m)
        for p in range(len(lo1)):
            gap = np.maximum(np.maximum(lo1[p] - hi2, lo2 - hi1[p]), 0)
            near = np.flatnonzero((gap * gap).sum(axis=1) <= (eps + SLACK) ** 2)
            for q in near[near >= p] if same else near:
                s, t = p * block, q * block
                hit = a[s : s + block] @ b[t : t + block].T >= cosine
                if same and p == q:
                    hit &= np.tri(*hit.shape, -1, dtype=bool).T
                if not hit.any():
                    continue
                x, y = np.nonzero(hit)
                x, y = x + s, y + t + (0 if same else n)
                np.add.at(links, x, 1)
                np.add.at(links, y, 1)
                _merge(up, x, y)
        ids = np.concatenate([ida, idb[:m]])
        used = np.flatnonzero(links)
        root = _roots(up)
        child = used[root[used] != used]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[ids[used], ids[child]]),
                pa.array(np.r_[links[used], np.zeros(len(child), np.int64)]),
                pa.array(np.r_[ids[used], ids[root[child]]]),
            ],
            ["a", "n", "b"],
        )

    return join


def _roots(up: np.ndarray) -> np.ndarray:
    while True:
        higher = up[up]
        if (higher == up).all():
            return up
        up = higher


def _merge(up: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Connect x and y pairwise: smaller roots are handed on until nothing changes."""
    while True:
        up[:] = _roots(up)
        a, b = up[x], up[y]
        differ = a != b
        if not differ.any():
            return
        x, y, a, b = x[differ], y[differ], a[differ], b[differ]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))


def linked_vectors(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per vector.

    Vectors link at a cosine of at least ``cosine``. NULL vectors, zero vectors and those
    with a NULL or non-finite component link with nothing, and vectors of different
    lengths do not link. Rows without a key are left out. Rows that are equal in key and
    vector are one vector and come out alike, but at most one of them is kept; rows that
    share a key and differ are vectors of their own. An empty table gives no rows; other
    columns are not read.
    """
    if keys_repeat(table, key):
        merged = merged_rows(table.select(F.col(key).cast("long").alias("vec_id"), vector), "vec_id", vector)
        rows, number = numbered_rows(merged, "vec_id", vector)
        found = linked_vectors(rows.select(F.col(number).alias("vec_id"), vector), "vec_id", vector, cosine)
        names = rows.select(F.col(number).alias("_row"), F.col("vec_id").alias("_name"), "copies")
        own = found.withColumnRenamed("vec_id", "_row").join(names, "_row").drop("_row").withColumnRenamed("_name", "vec_id")
        roots = names.select(F.col("_row").alias("component_id"), F.col("_name").alias("_root"))
        each = own.join(roots, "component_id").withColumn("_copy", F.explode(F.expr("sequence(1L, copies)")))
        one = F.col("kept") & (F.col("_copy") == 1)
        return each.select("vec_id", "n_links", F.col("_root").alias("component_id"), one.alias("kept"))
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    single = table.schema[vector].dataType == T.ArrayType(T.FloatType(), True)
    kind = np.float32 if single else np.float64
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    source = table.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    source = source.filter(F.col("vec_id").isNotNull())
    usable = source.filter(_valid("v"))
    found = []
    # One join for each length of vectors; a table of embeddings has one.
    for (width,) in usable.select(F.size("v")).distinct().collect():
        same = usable.filter(F.size("v") == width)
        sample = same.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
        axes = _directions(_units(_rows(sample.column("v"), width)))
        cells = [f"c{d}" for d in range(axes.shape[1])]
        schema = ", ".join(["vec_id long", *(f"{c} int" for c in cells), "raw binary"])
        placed = written(same.mapInArrow(_located("vec_id", "v", width, axes, eps), schema), "grid-cells")
        parts = max(1, -(-placed.count() // (4 * LEAF)))
        ordered = placed.repartitionByRange(parts, *cells, "vec_id").sortWithinPartitions(*cells, "vec_id")
        leaves = written(
            ordered.mapInArrow(
                _intervals(width, axes, kind, LEAF),
                "place long, lo array<double>, hi array<double>, ids binary, raws binary",
            ),
            "grid-leaves",
        )
        # Dense numbers in the order of the sequence, from the counts of the tasks that cut it.
        task = F.shiftright("place", 24)
        counts = leaves.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
        before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        boxes = leaves.select("place", "lo", "hi", task.alias("task")).join(F.broadcast(counts), "task")
        leaf = F.col("before") + F.col("place").bitwiseAND((1 << 24) - 1)
        boxes = written(boxes.select("place", "lo", "hi", leaf.cast("long").alias("leaf")), "grid-boxes")
        pairs = _surviving(boxes.select("leaf", "lo", "hi"), eps)
        sides = pairs.select("i", "j", F.col("i").alias("leaf"), F.lit(0).alias("side")).union(
            pairs.filter("i < j").select("i", "j", F.col("j").alias("leaf"), F.lit(1).alias("side"))
        )
        # Few pairs per task, as each brings two intervals along.
        tasks = max(1, -(-pairs.count() // 2))
        sides = sides.join(boxes.select("leaf", "place"), "leaf")
        work = leaves.select("place", "ids", "raws").join(sides, "place")
        work = work.select("i", "j", "side", "ids", "raws").repartition(tasks, "i", "j")
        work = work.sortWithinPartitions("i", "j", "side")
        joined = work.mapInArrow(_joiner(width, axes, cosine, eps, kind, BLOCK), "a long, n long, b long")
        found.append(written(joined, "grid-links"))
    counts = source.select("vec_id")
    if not found:
        return counts.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    roots = components(links.filter("a <> b").select("a", "b"), "grid-forest")
    n = links.filter("a = b").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    out = counts.join(n, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )

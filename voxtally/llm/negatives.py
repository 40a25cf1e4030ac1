"""Hard negatives by inner product search with length buckets and coordinate pruning.

Vectors become whole numbers, are sorted by length and cut into buckets. A bucket keeps,
for every coordinate, the order of its vectors by the value of their direction there.
A search asks for the best rows of some vector, of the same or of another label, with
scores between two bounds:

* A bucket is skipped when the lower bound is above length times greatest length in it.
* Else the lower bound, divided by both lengths, bounds the cosine from below. For
  each focus coordinate of the vector (its largest ones) this leaves a range of values
  that a direction may have; two bisections of the sorted list give the rows in
  it. The rows of the shortest range that are in all other ranges are candidates.
* The scores of the candidates are computed exactly, in whole numbers.

The positives of all anchors are searched first in the bucket of the longest vectors
alone, which gives a lower bound for each, and then in all buckets. The negatives have
their bounds from the positives. A bucket meets the anchors in slabs, and returns at the
most k rows of it for every question, so no step gathers what grows with the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.llm.common import written

SCALE = 256
BUCKET = 8192
SLAB = 4096
LANE = 64
FOCUS = 3
# Components up to this size: sums of products of some thousand of them fit into 64 bits.
LARGEST = 1 << 25
# What rounding may do to a cosine or a direction, many times over.
SLACK = 1e-9


def _whole(table: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """Distinct rows (vec_id, label, width, size, v) of whole numbers; those that take no part are left out."""
    v = F.col(vector).cast("array<double>")
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST / scale)
    rows = table.select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("x")
    )
    rows = rows.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", fits)
    )
    rows = rows.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = rows.dropDuplicates(["vec_id", "label", "v"])
    return rows.select("vec_id", "label", F.size("v").alias("width"), F.sqrt(squares).alias("size"), "v")


def _vectors(column, width: int) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.int32)
    return flat.reshape(-1, width) if width else np.zeros((len(column), 0), np.int32)


def _cutter(bucket: int):
    """Cut a partition sorted by width and falling length into buckets."""

    def cut(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def made(rows: pa.Table):
            nonlocal number
            width = rows.column("width")[0].as_py()
            m = _vectors(rows.column("v").combine_chunks(), width)
            sizes = np.asarray(rows.column("size"))
            units = m / np.maximum(sizes, 1e-300)[:, None]
            orders = np.argsort(units, axis=0, kind="stable").astype(np.uint16).T
            number += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 24 | number], pa.int64()),
                    pa.array([width], pa.int32()),
                    pa.array([float(sizes.min())]),
                    pa.array([float(sizes.max())]),
                    pa.array([np.asarray(rows.column("vec_id")).tobytes()], pa.binary()),
                    pa.array([np.asarray(rows.column("label")).tobytes()], pa.binary()),
                    pa.array([m.tobytes()], pa.binary()),
                    pa.array([np.ascontiguousarray(orders).tobytes()], pa.binary()),
                ],
                ["place", "width", "shortest", "longest", "ids", "labels", "vectors", "orders"],
            )

        def full(last: bool):
            nonlocal held
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            widths = np.asarray(table.column("width"))
            cuts = np.r_[0, np.flatnonzero(np.diff(widths)) + 1, len(widths)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                ended = last or b < len(widths)
                while b - a >= bucket or (ended and b > a):
                    n = min(bucket, b - a)
                    yield made(table.slice(a, n))
                    a += n
                if not ended:
                    held = table.slice(a).to_batches()
                    return
            held = []

        waiting = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                waiting += batch.num_rows
            if waiting >= bucket:
                yield from full(False)
                waiting = sum(b.num_rows for b in held)
        yield from full(True)

    return cut


class _Bucket:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        n, width = len(self.ids), row["width"]
        self.m = np.frombuffer(row["vectors"], np.int32).reshape(n, width)
        self.orders = np.frombuffer(row["orders"], np.uint16).reshape(width, n)
        self.shortest, self.longest = row["shortest"], row["longest"]
        sizes = np.sqrt((self.m.astype(np.float64) ** 2).sum(axis=1))
        self.units = self.m / np.maximum(sizes, 1e-300)[:, None]
        self.sorted: dict[int, np.ndarray] = {}
        self.top = int(np.abs(self.m).max(initial=0))
        self.exact = self.m.astype(np.float64)

    def candidates(self, v: np.ndarray, size: float, low: float, focus: int) -> np.ndarray | None:
        """Rows that may reach the score ``low``; None for all of them."""
        if low == -np.inf or size == 0:
            return None if low <= 0 else np.zeros(0, np.int64)
        length = self.longest if low > 0 else self.shortest
        if length == 0:
            return None if low <= 0 else np.zeros(0, np.int64)
        cosine = low / (size * length) - SLACK
        if cosine > 1:
            return np.zeros(0, np.int64)
        if cosine <= -1:
            return None
        unit = v / size
        coordinates = np.argsort(-np.abs(unit), kind="stable")[:focus]
        # A direction within the angle b of one with value cos(a) has a value between cos(a + b) and cos(a - b).
        b = np.arccos(np.clip(cosine, -1, 1))
        a = np.arccos(np.clip(unit[coordinates], -1, 1))
        lower = np.where(a + b >= np.pi, -1.0, np.cos(np.minimum(a + b, np.pi))) - 2 * SLACK
        upper = np.where(a <= b, 1.0, np.cos(np.maximum(a - b, 0))) + 2 * SLACK
        spans = []
        for f, lo, hi in zip(coordinates.tolist(), lower.tolist(), upper.tolist()):
            if f not in self.sorted:
                self.sorted[f] = self.units[self.orders[f], f]
            spans.append((np.searchsorted(self.sorted[f], lo, "left"), np.searchsorted(self.sorted[f], hi, "right")))
        best = min(range(len(spans)), key=lambda k: spans[k][1] - spans[k][0])
        start, end = spans[best]
        rows = self.orders[coordinates[best], start:end].astype(np.int64)
        for k, f in enumerate(coordinates.tolist()):
            if k != best and spans[k][1] - spans[k][0] < len(self.ids):
                values = self.units[rows, f]
                rows = rows[(values >= lower[k]) & (values <= upper[k])]
        return rows

    def scores(self, rows: np.ndarray | None, v: np.ndarray) -> np.ndarray:
        small = self.top * int(np.abs(v).max(initial=0)) * max(len(v), 1) < 1 << 53
        m = self.exact if small else self.m.astype(np.int64)
        v = v.astype(m.dtype)
        return ((m if rows is None else m[rows]) @ v).astype(np.int64)


def _searcher(k: int, same: bool, focus: int):
    """Answers for a bucket (kind 0) and the questions behind it (kind 1)."""

    def search(batches):
        bucket: _Bucket | None = None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    bucket = _Bucket(row)
                    continue
                v = np.array(row["v"], np.int64)
                asks, lows, highs = row["asks"], row["lows"], row["highs"]
                low = min((-np.inf if x is None else x) for x in lows)
                rows = bucket.candidates(v, row["size"], low, focus)
                scores = bucket.scores(rows, v)
                ids = bucket.ids if rows is None else bucket.ids[rows]
                labels = bucket.labels if rows is None else bucket.labels[rows]
                fits = (labels == row["label"]) & (ids != row["anchor"]) if same else labels != row["label"]
                if low > -np.inf:
                    fits &= scores >= low
                scores, ids = scores[fits], ids[fits]
                order = np.lexsort((ids, -scores))
                scores, ids = scores[order], ids[order]
                for ask, lo, hi in zip(asks, lows, highs):
                    # Falling scores: those within the bounds are one stretch.
                    a = 0 if hi is None else int(np.searchsorted(-scores, -hi, "left"))
                    b = len(scores) if lo is None else int(np.searchsorted(-scores, -lo, "right"))
                    n = max(0, min(k, b - a))
                    out[0] += [row["anchor"]] * n
                    out[1] += [ask] * n
                    out[2] += ids[a : a + n].tolist()
                    out[3] += scores[a : a + n].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out], ["anchor", "ask", "found", "score"]
            )

    return search


def _best(answers: DataFrame, k: int) -> DataFrame:
    """The first ``k`` answers of every question; at most ``k`` of each bucket come together."""
    order = Window.partitionBy("anchor", "ask").orderBy(F.col("score").desc(), "found")
    ranked = answers.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def _per_cent(score: Column, part: int, up: bool) -> Column:
    """A share of a score in whole numbers, rounded up or down."""
    n = score * F.lit(part).cast("long")
    away = F.when(n >= 0, n + 99).otherwise(n) if up else F.when(n >= 0, n).otherwise(n - 99)
    # Whole division cuts towards zero.
    return F.call_function("div", away, F.lit(100).cast("long"))


def _search(asks: DataFrame, buckets: DataFrame, n_buckets: int, n_anchors: int, k: int, same: bool, focus: int) -> DataFrame:
    """The best ``k`` rows of every question (anchor, label, size, v, asks, lows, highs)."""
    slabs, lanes = -(-max(n_anchors, 1) // SLAB), -(-max(n_buckets, 1) // LANE)
    slab = F.pmod(F.xxhash64("anchor"), F.lit(slabs)).cast("long")
    lane = F.pmod(F.xxhash64("place"), F.lit(lanes)).cast("long")
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    asks = asks.withColumn("slab", slab)
    spread = asks.select("*", F.size("v").alias("width"), every(lanes, "lane"))
    sides = buckets.select("place", "width", "longest", lane.alias("lane"), every(slabs, "slab"))
    meet = spread.join(sides, ["width", "slab", "lane"])
    # The least lower bound of the questions against what a vector of the bucket can reach.
    least = F.when(F.exists("lows", lambda x: x.isNull()), F.lit(None)).otherwise(F.array_min("lows"))
    reach = F.col("size") * F.col("longest") * (1 + SLACK)
    meet = meet.filter(least.isNull() | (least <= reach))
    columns = ["place", "slab", "kind", "anchor", "label", "size", "v", "asks", "lows", "highs"]
    wide = ["width", "shortest", "longest", "ids", "labels", "vectors", "orders"]
    questions = meet.withColumn("kind", F.lit(1)).select(
        *columns, *(F.lit(None).cast(buckets.schema[c].dataType).alias(c) for c in wide)
    )
    here = buckets.select("*", every(slabs, "slab")).withColumn("kind", F.lit(0))
    nothing = [c for c in columns if c not in ("place", "slab", "kind")]
    here = here.select(
        "place", "slab", "kind", *(F.lit(None).cast(questions.schema[c].dataType).alias(c) for c in nothing), *wide
    )
    # One bucket and a slab of questions at a time; a partition holds several of them in turn.
    dealt = here.unionByName(questions).repartition(max(1, n_buckets * slabs), "place", "slab")
    dealt = dealt.sortWithinPartitions("place", "slab", "kind")
    answers = dealt.mapInArrow(_searcher(k, same, focus), "anchor long, ask long, found long, score long")
    return _best(written(answers, "negatives-answers"), k)


def hard_negatives(
    table: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = SCALE,
    bucket: int = BUCKET,
    focus: int = FOCUS,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components are ``floor(scale * x)`` and scores inner products of these. ``is_anchor`` is
    a condition on ``vec_id`` and ``label``. The positives of an anchor are the first
    ``positives`` rows of its label with another id; for each of them come the first
    ``negatives`` rows of other labels whose score is between ``low`` and ``high`` per cent
    of the positive's. Higher scores are first, ties go by the smaller id.

    Rows with a NULL key, label or vector take no part, nor do those with a component that
    is NULL, not finite, or above ``LARGEST / scale`` in size. Only vectors of one length
    are compared. A row that is repeated with all its values counts once. Rows that
    share a key and differ are vectors of one name: as an anchor it asks with each of them,
    and none is another's positive. Anchors without a positive or a negative give no rows, and so does an empty
    table. Other columns are not read.
    """
    if not 0 < bucket <= 1 << 16:
        raise ValueError("a bucket holds at most 65,536 vectors")
    rows = written(_whole(table, key, vector, label, scale), "negatives-rows")
    parts = max(1, -(-rows.count() // (4 * bucket)))
    ordered = rows.repartitionByRange(parts, "width", F.col("size").desc(), "vec_id")
    ordered = ordered.sortWithinPartitions("width", F.col("size").desc(), "vec_id")
    buckets = written(
        ordered.mapInArrow(
            _cutter(bucket),
            "place long, width int, shortest double, longest double, ids binary, labels binary, vectors binary, orders binary",
        ),
        "negatives-buckets",
    )
    n_buckets = buckets.count()
    anchors = written(
        rows.filter(is_anchor).select(F.col("vec_id").alias("anchor"), "label", "size", "v"), "negatives-anchors"
    )
    n_anchors = anchors.count()

    def question(lows: Column) -> DataFrame:
        return anchors_with.select(
            "anchor",
            "label",
            "size",
            "v",
            F.array(F.lit(0).cast("long")).alias("asks"),
            F.array(lows.cast("long")).alias("lows"),
            F.array(F.lit(None).cast("long")).alias("highs"),
        )

    # The longest vectors of each width give a first bound: the last of enough rows found there.
    seeds = buckets.groupBy("width").agg(F.max_by("place", F.struct("longest", "place")).alias("place"))
    seeds = buckets.join(seeds, ["width", "place"], "left_semi")
    anchors_with = anchors
    first = _search(question(F.lit(None)), seeds, 1, n_anchors, positives, True, focus)
    bounds = first.filter(F.col("rank") == positives).select("anchor", F.col("score").alias("bound"))
    anchors_with = anchors.join(bounds, "anchor", "left")
    best = _search(question(F.col("bound")), buckets, n_buckets, n_anchors, positives, True, focus)
    best = written(best.select("anchor", F.col("found").alias("positive"), "score"), "negatives-positives")

    # A positive is asked about by its place among those of its anchor.
    listed = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("positive", "score"))).alias("p"))
    asks = anchors.join(listed, "anchor").select(
        "anchor",
        "label",
        "size",
        "v",
        F.transform("p", lambda x: x["positive"]).alias("asks"),
        F.transform("p", lambda x: _per_cent(x["score"], low, True)).alias("lows"),
        F.transform("p", lambda x: _per_cent(x["score"], high, False)).alias("highs"),
    )
    found = _search(asks, buckets, n_buckets, n_anchors, negatives, False, focus)
    scored = found.join(
        best.select("anchor", F.col("positive").alias("ask"), F.col("score").alias("positive_score")), ["anchor", "ask"]
    )
    return scored.select(
        F.col("anchor").alias("anchor_id"),
        F.col("ask").alias("positive_id"),
        "rank",
        F.col("found").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )

"""What several operators of this subpackage share.

Nothing here keeps data on a machine: tables that cut lineage go to the folder in
``spark.checkpoint.dir``, so a lost executor costs a task and not the job.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.operators.groups import assign_ids_in_order

# Ids up to this number go to every task (8 bytes each); more are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run, below ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="voxtally-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder; what made them is cut off."""
    folder = scratch(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def only(df: DataFrame, ids: DataFrame, key: str, bound: int = MAX_BROADCAST_IDS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (one long column, distinct).

    Counted first: up to ``bound`` ids are sent to every task and the wide rows stay
    where they are; beyond it, both sides are shuffled on the key.
    """
    if ids.count() <= bound:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def keys_repeat(rows: DataFrame, key: str) -> bool:
    """Whether two rows share a key. Only the keys are read and shuffled."""
    counts = rows.select(key).filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.filter("n > 1").limit(1).count() > 0


def numbered_rows(rows: DataFrame, key: str, *content: str) -> tuple[DataFrame, str]:
    """The rows with a key, written once, and the name of a column that numbers them.

    Numbers follow the key; rows of one key go by a digest of ``content``, and rows that
    are equal in that as well are numbered in any order. Operators that need unique keys
    work on the numbers.
    """
    number, digest = "_row", "_digest"
    while number in rows.columns or digest in rows.columns:
        number, digest = number + "_", digest + "_"
    parts = (F.coalesce(F.sha2(F.col(c).cast("string").cast("binary"), 256), F.lit("-")) for c in content)
    keyed = rows.filter(F.col(key).isNotNull()).withColumn(digest, F.concat_ws(":", *parts))
    return assign_ids_in_order(keyed, [key], digest, number).drop(digest), number


def merged_rows(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Rows (key, content, copies): those that are equal in both are one."""
    digest = F.coalesce(F.sha2(F.col(content).cast("string").cast("binary"), 256), F.lit("-"))
    keyed = rows.filter(F.col(key).isNotNull()).select(key, content, digest.alias("_digest"))
    merged = keyed.groupBy(key, "_digest").agg(F.first(content).alias(content), F.count("*").alias("copies"))
    return merged.select(key, content, "copies")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, one after another, and where each text starts.

    The second array has one entry more than there are texts. NULL is an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The opposite of :func:`text_bytes`, as a binary column."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, regrouped so that a block holds about ``limit`` bytes of text.

    A single text longer than that is a block of its own.
    """
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        for i, length in enumerate(lengths.tolist()):
            if size and size + length > limit:
                waiting.append(batch.slice(at, i - at))
                yield _joined(waiting)
                waiting, size, at = [], 0, i
            size += length
        waiting.append(batch.slice(at))
    if waiting:
        yield _joined(waiting)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    return table.to_batches()[0] if table.num_rows else batches[0]


class Recent(dict):
    """What a Python worker remembers, in two generations bounded by bytes.

    A value that is not there is made by ``make``. When the young generation has grown
    to ``limit`` bytes it becomes the old one, and the old one is forgotten; what is
    asked for again moves back to the young one. So common keys stay, however many rare
    ones go by, and at most twice the limit and one more value are held.
    """

    # Two objects and their entry in the table, besides what they hold.
    ENTRY_BYTES = 200

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit
        self.old: dict = {}
        self.size = 0

    def __missing__(self, key: Hashable):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        return self.keep(key, value, len(key) + len(value))

    def recall(self, key: Hashable, size: Callable[[object], int]):
        """The value of a key if it is remembered, else None; nothing is made."""
        value = self.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.keep(key, value, len(key) + size(value))
        return value

    def keep(self, key: Hashable, value, size: int):
        self.size += size + self.ENTRY_BYTES
        if self.size > self.limit:
            self.old = dict(self)
            self.clear()
            self.size = size + self.ENTRY_BYTES
        self[key] = value
        return value


# ASCII white space as in [\x20\x09-\x0D]; no byte of a longer UTF-8 character is among them.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ``[^\\x20\\x09-\\x0D]+``, and the first word of each text."""
    inside = ~BLANK[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    # A text ends a word even if the next text begins without a blank.
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """``base ** i`` modulo 2 ** 64 for i below ``n``, or its inverses."""
    known = _POWERS.get((base, inverse))
    if known is None or len(known) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        known = np.full(max(n, 1), step, np.uint64)
        known[0] = 1
        known = _POWERS[base, inverse] = np.multiply.accumulate(known)
    return known[:n]


def span_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of ``values[first:last]`` for every pair, by differences of prefix sums."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=sums[1:])
    part = (sums[last] - sums[first]) * powers(base, n + 1, True)[first]
    return mixed(part + (last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """Connected components of the edges (a, b): rows (node, root), root the smallest node.

    Rounds of large-star and small-star steps: every node tells its neighbours the
    smallest neighbour it knows. Minima are combined on the map side and the join
    back on the node can be split by adaptive execution, so a node with very many
    neighbours does not gather them in a task. Every round is a written table, and the
    rounds end when all components are stars. Nodes without an edge are not in the
    result.
    """
    pairs = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    pairs = written(pairs.distinct(), purpose)
    while not _all_stars(pairs):
        # Large star: each larger neighbour points to the smallest of the neighbourhood.
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Written, so that both sides of the join are plain shuffles, which can be split.
        least = written(least, purpose)
        large = both.filter(F.col("b") > F.col("a")).join(least, "a")
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each smaller neighbour and the node itself do so.
        large = written(large, purpose)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), purpose)
        small = large.join(least, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
            F.col("m").alias("b"),
        )
        pairs = written(small.filter("a <> b").distinct(), purpose)
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _all_stars(pairs: DataFrame) -> bool:
    """Whether every larger node has one smaller neighbour, and that one has none.

    Steps never take a component apart and ``a > b`` holds in each pair, so the
    smaller node then is the root of all it is paired with.
    """
    ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        pairs.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.filter("up > 1 or (up = 1 and down = 1)").count() == 0

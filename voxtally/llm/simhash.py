"""Near-duplicates by SimHash, found through deletion-variant signatures.

Fingerprints of 64 bits link at 3 or fewer differing bits. Cut into two segments of
32 bits, one of the two differs in at most one bit. So every segment is indexed 32
times, each time with another bit left out: fingerprints that link share one of these
variants. Rows of one variant are brought together by one shuffle on (segment, bit
left out, other bits), and every pair in them is verified over all 64 bits.

Equal fingerprints are one node from the start, so copies cost nothing. A pair is
reported by the first variant it shares. A variant whose segment value is shared by
very many different fingerprints is split once more, by variants of the other half,
which keeps every link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import (
    LOWER,
    MAX_BROADCAST_IDS,
    blocks,
    components,
    keys_repeat,
    numbered_rows,
    text_bytes,
    written,
)

MAX_BITS = 3
SEED = 42
BLOCK_BYTES = 2 << 20
# Fingerprints sharing a segment value from which its variants are split once more.
HOT_SEGMENT = 50_000
# Such segment values whose variants, 32 each, are sent to every task.
MAX_HOT = 10_000
# Rows compared with each other at once.
COMPARED = 2048


def shingle_hashes(text: bytes, size: int) -> bytes:
    """XXH64 of every shingle of a lower-cased text, big-endian, one after another."""
    words = text.split()
    if not words:
        return b""
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[: -size] + 1].tolist()
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())])


def fingerprints(texts: list[bytes], size: int) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is in more than half of the shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        hashes = np.frombuffer(shingle_hashes(text, size), np.uint8).reshape(-1, 8)
        if not len(hashes):
            continue
        votes = np.zeros(64, np.int64)
        for k in range(0, len(hashes), 65_536):
            bits = np.unpackbits(hashes[k : k + 65_536], axis=1)
            # Columns of 255 rows at most are added as bytes first.
            votes += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(
                0, dtype=np.int64
            )
        out[i] = np.packbits(2 * votes > len(hashes)).view(">u8")[0]
    return out


def _fingerprinter(key: str, text: str, size: int):
    def run(batches):
        for block in blocks(batches, text, BLOCK_BYTES):
            data, at = text_bytes(block.column(text))
            lower = LOWER[data].tobytes()
            bounds = at.tolist()
            prints = fingerprints([lower[a:b] for a, b in zip(bounds, bounds[1:])], size)
            yield pa.RecordBatch.from_arrays(
                [block.column(key), pa.array(prints.view(np.int64))], ["doc_id", "fp"]
            )

    return run


def _first_variant(x: np.ndarray) -> np.ndarray:
    """The first variant that a pair shares, from the bits in which it differs; -1 for none."""
    high, low = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
    bit = lambda v: np.where(v == 0, 0, np.log2(np.maximum(v, np.uint64(1)).astype(np.float64))).astype(np.int64)
    out = np.where(np.bitwise_count(low) <= 1, 32 + bit(low), -1)
    return np.where(np.bitwise_count(high) <= 1, bit(high), out)


def _linked(fps: np.ndarray, i: np.ndarray, j: np.ndarray, variant: np.ndarray) -> np.ndarray:
    x = fps[i] ^ fps[j]
    near = np.bitwise_count(x) <= MAX_BITS
    near[near] = _first_variant(x[near]) == variant[near]
    return near


class _Forest:
    """Joins positions; keeps only links that connect something new."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist()):
            ra, rb = self.root(a), self.root(b)
            if ra != rb:
                self.up[max(ra, rb)] = min(ra, rb)
                self.edges.append((a, b))


def _compare(fps: np.ndarray, variant: int, forest: _Forest, at: np.ndarray) -> None:
    """Links among the rows ``at`` of one variant, block against block."""
    other = 0 if variant >= 32 else 32
    if len(at) > 2 * COMPARED:
        # The other half differs in at most 3 bits, so one of its halves in at most one.
        half = (fps[at] >> np.uint64(32 - other)) & np.uint64(0xFFFFFFFF)
        for side in (0, 16):
            part = (half >> np.uint64(side)) & np.uint64(0xFFFF)
            for b in range(16):
                masked = part & ~np.uint64(1 << b)
                order = np.argsort(masked, kind="stable")
                cuts = np.flatnonzero(np.diff(masked[order])) + 1
                for run in np.split(at[order], cuts):
                    if len(run) > 1:
                        _blockwise(fps, variant, forest, run)
    else:
        _blockwise(fps, variant, forest, at)


def _blockwise(fps: np.ndarray, variant: int, forest: _Forest, at: np.ndarray) -> None:
    for p in range(0, len(at), COMPARED):
        for q in range(p, len(at), COMPARED):
            a, b = at[p : p + COMPARED], at[q : q + COMPARED]
            i, j = np.nonzero(np.bitwise_count(fps[a][:, None] ^ fps[b][None, :]) <= MAX_BITS)
            i, j = a[i], b[j]
            i, j = np.minimum(i, j), np.maximum(i, j)
            keep = i != j
            i, j = i[keep], j[keep]
            first = _first_variant(fps[i] ^ fps[j]) == variant
            forest.join(i[first], j[first])


def _links(key: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between rows of equal key, whose variant is in its upper half. Keys are sorted."""
    variant = key >> np.int64(32)
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
    size = ends - starts
    a, b = [], []
    # Short runs: all lags at once, over all runs.
    run_of = np.repeat(np.arange(len(starts)), size)
    short = (size[run_of] <= 16) & (size[run_of] > 1)
    rows = np.flatnonzero(short)
    for lag in range(1, int(size[size <= 16].max(initial=1))):
        i = rows[rows + lag < ends[run_of[rows]]]
        near = _linked(fps, i, i + lag, variant[i])
        a.append(reps[i[near]])
        b.append(reps[i[near] + lag])
    for r in np.flatnonzero(size > 16):
        forest = _Forest(int(size[r]))
        part = fps[starts[r] : ends[r]]
        _compare(part, int(variant[starts[r]]), forest, np.arange(len(part)))
        if forest.edges:
            e = np.array(forest.edges) + starts[r]
            a.append(reps[e[:, 0]])
            b.append(reps[e[:, 1]])
    return (np.concatenate(a), np.concatenate(b)) if a else (reps[:0], reps[:0])


def _link_stream(batches):
    """Links of a stream sorted by (key, part); a run that spans batches is held together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part = np.asarray(batch.column("key")), np.asarray(batch.column("part"))
        inside = np.flatnonzero((key == key[-1]) & (part == part[-1]))[0]
        if inside == 0:
            last = held[-1] if held else None
            same = last is not None and last.column("key")[0].as_py() == key[0] and last.column("part")[0].as_py() == part[0]
            if held and not same:
                yield from _flush(held)
                held = []
            held.append(batch)
            continue
        held.append(batch.slice(0, inside))
        yield from _flush(held)
        held = [batch.slice(inside)]
    if held:
        yield from _flush(held)


def _flush(held: list[pa.RecordBatch]):
    table = pa.Table.from_batches(held)
    key, part = np.asarray(table.column("key")), np.asarray(table.column("part"))
    fps = np.asarray(table.column("fp")).view(np.uint64)
    reps = np.asarray(table.column("rep"))
    # Parts of a split key are told apart by making them runs of their own.
    for lo in np.unique(part) if (part != part[0]).any() else part[:1]:
        at = part == lo
        a, b = _links(key[at], fps[at], reps[at])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


VARIANT = (
    "(v << 32) | (if(v < 32, shiftrightunsigned(fp, 32), fp & 4294967295L)"
    " & ~shiftleft(1L, cast(v & 31 as int)))"
)


def simhash_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3
) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per document.

    Words are runs without ASCII white space, A-Z is lower-cased, shingles have ``size``
    words, and a text with fewer words is one shingle. A NULL, empty or blank text has
    the fingerprint zero, which links like any other. ``component_id`` is the smallest
    id reachable over links. Rows without a key are left out; rows that share one come out
    each with its own fingerprint. An empty table gives no rows; other columns are not read.
    """
    source = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    source = source.filter(F.col(key).isNotNull())
    prints = written(source.mapInArrow(_fingerprinter(key, text, size), "doc_id long, fp long"), "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")

    variants = nodes.select("fp", "rep", F.explode(F.expr("sequence(0L, 63L)")).alias("v"))
    variants = variants.select("fp", "rep", F.expr(VARIANT).alias("key"))
    # Segment values of very many fingerprints: at most 2 * nodes / HOT_SEGMENT of them.
    total = nodes.count()
    bound = HOT_SEGMENT
    halves = F.array(F.expr("shiftrightunsigned(fp, 32)"), F.expr("(fp & 4294967295L) | (1L << 32)"))
    hot = nodes.select(F.explode(halves).alias("half")).groupBy("half").count().filter(F.col("count") > bound)
    hot_keys = hot.select(
        F.col("half"), F.explode(F.expr("sequence(0L, 31L)")).alias("bit")
    ).select(
        F.expr(
            "((if(half >= (1L << 32), 32L, 0L) + bit) << 32) | (half & 4294967295L & ~shiftleft(1L, cast(bit as int)))"
        ).alias("key")
    )
    n_hot = hot.count() if total > bound else 0
    if n_hot:
        hot_keys = written(hot_keys.distinct().withColumn("hot", F.lit(True)), "simhash-hot")
        # Beyond the bound they are joined by a shuffle, in which a frequent key can be split.
        marked = variants.join(F.broadcast(hot_keys) if n_hot <= MAX_HOT else hot_keys, "key", "left")
        # Variants of the half that is not in the key: two quarters, one bit left out of one.
        rest = "if((key >> 32) < 32, fp & 4294967295L, shiftrightunsigned(fp, 32))"
        quarter = f"(if(w < 16, shiftright({rest}, 16), {rest} & 65535L) & 65535L & ~shiftleft(1L, cast(w & 15 as int)))"
        cut = F.when(F.col("hot"), F.expr("sequence(0L, 31L)")).otherwise(F.expr("array(-1L)"))
        variants = marked.select("fp", "rep", "key", F.explode(cut).alias("w")).select(
            "fp", "rep", "key", F.expr(f"if(w < 0, -1L, (w << 16) | {quarter})").alias("part")
        )
    else:
        variants = variants.withColumn("part", F.lit(-1).cast("long"))
    dealt = variants.repartition("key", "part").sortWithinPartitions("part", "key")
    edges = dealt.select("key", "part", "fp", "rep").mapInArrow(_link_stream, "a long, b long")
    roots = components(edges, "simhash-links")
    named = nodes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id")
    )
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """The documents with the smallest id of their component, with all their columns.

    Rows without a key are left out. Of rows that share the smallest key of a component one
    stays, that with the smaller digest of its text.
    """
    rows, own = docs.filter(F.col(key).isNotNull()), key
    if keys_repeat(rows, key):
        rows, own = numbered_rows(rows, key, text)
    found = written(simhash_components(rows, own, text, size), "simhash-kept")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(own))
    if gone.count() <= MAX_BROADCAST_IDS:
        gone = F.broadcast(gone)
    return rows.join(gone, own, "left_anti").select(*docs.columns)

"""Substring duplicates by seed and extend.

Seeds: of the word k-grams in a window of ``length`` consecutive words, the one with
the smallest hash is the window's anchor (winnowing: equal windows have equal anchors,
at the same place). Consecutive windows with the same anchor form a segment, so a text
is a sequence of segments, and a window belongs to exactly one of them.

Join: segments are joined on their content. A segment that also stands in a document
with a smaller id is a match over its full length, with nothing left to extend; these
are the inner parts of copies, which so cost one row per segment and are combined on
the map side. What remains is one representative per distinct segment.

Extend: where distinct segments share an anchor, a repeat may go on from the anchor to
both sides and end inside the segments. The windows of such segments - every way of
extending the anchor to the left and right by ``length`` words in all - are compared
with those of the other representatives.

Windows that were matched are put together to maximal runs per document; the words of
the runs are removed. Only documents with such segments or runs are read again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import (
    blocks,
    keys_repeat,
    merged_rows,
    numbered_rows,
    only,
    span_hashes,
    text_bytes,
    word_bounds,
    written,
)

GRAM = 20
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
BLOCK_BYTES = 2 << 20


def _words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    first, last, upto = word_bounds(data, offsets)
    return data, offsets, first, last, upto


def _codes(data, first, last) -> list[np.ndarray]:
    """Two independent 64-bit hashes of every word."""
    return [span_hashes(data, first, last, base) for base in BASES]


def _anchors(code: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` words the place of its anchor, and the k-gram hashes.

    Windows and k-grams run over the whole block; those across texts are left out later.
    """
    n = len(code)
    grams = span_hashes(code, np.arange(n - gram + 1), np.arange(gram, n + 1), BASES[0])
    # Upper bits of the hash with the place below them: the least is the leftmost of equal ones.
    value = (grams & ~np.uint64((1 << 22) - 1)) | np.arange(len(grams), dtype=np.uint64)
    width, step = length - gram + 1, 1
    while 2 * step <= width:
        value = np.minimum(value[:-step], value[step:])
        step *= 2
    if step < width:
        value = np.minimum(value[: len(value) - (width - step)], value[width - step :])
    return (value & np.uint64((1 << 22) - 1)).astype(np.int64), grams


def _segments(key: str, text: str, length: int, gram: int):
    """Batches of segments: content hashes, anchor, its place, windows, document, first word."""

    def cut(batches):
        for block in blocks(batches, text, BLOCK_BYTES):
            data, offsets, first, last, upto = _words(block.column(text))
            n = np.diff(upto)
            ids = np.asarray(block.column(key))
            # A text may be longer than a block; it is then taken in overlapping parts.
            for d0, d1, w0, w1 in _parts(n, upto, length):
                if w1 - w0 < length:
                    continue
                codes = _codes(data, first[w0:w1], last[w0:w1])
                place, grams = _anchors(codes[0], length, gram)
                doc = np.repeat(np.arange(d0, d1), np.minimum(upto[d0 + 1 : d1 + 1], w1) - np.maximum(upto[d0:d1], w0))
                at = np.arange(len(place))
                inside = doc[at] == doc[at + length - 1]
                at, place, of = at[inside], place[inside], doc[at[inside]]
                if not len(at):
                    continue
                new = np.r_[True, (place[1:] != place[:-1]) | (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)]
                start = np.flatnonzero(new)
                windows = np.diff(np.r_[start, len(at)])
                begin = at[start]
                end = begin + windows + length - 1
                hashes = [span_hashes(c, begin, end, b) for c, b in zip(codes, BASES[::-1])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[0].view(np.int64)),
                        pa.array(hashes[1].view(np.int64)),
                        pa.array(grams[place[start]].view(np.int64)),
                        pa.array((place[start] - begin).astype(np.int32)),
                        pa.array(windows.astype(np.int32)),
                        pa.array(ids[of[start]]),
                        pa.array(begin + w0 - upto[of[start]]),
                    ],
                    ["h1", "h2", "anchor", "lead", "windows", "doc_id", "first"],
                )

    return cut


def _parts(n: np.ndarray, upto: np.ndarray, length: int, most: int = 1 << 21):
    """Ranges of texts and words of at most ``most`` words; consecutive ranges of one text overlap."""
    d, total = 0, len(n)
    while d < total:
        if n[d] > most:
            for w in range(int(upto[d]), int(upto[d + 1]) - length + 1, most - length + 1):
                yield d, d + 1, w, min(w + most, int(upto[d + 1]))
            d += 1
            continue
        e = int(np.searchsorted(upto, upto[d] + most, side="right")) - 1
        e = max(d + 1, min(e, total))
        yield d, e, int(upto[d]), int(upto[e])
        d = e


def _window_hashes(length: int):
    """Windows of the asked segments of a document, with two hashes each."""

    def expand(batches):
        for block in blocks(batches, "text", BLOCK_BYTES):
            data, _, first, last, upto = _words(block.column("text"))
            codes = _codes(data, first, last)
            asked = block.column("asked")
            counts = np.asarray(asked.value_lengths()).astype(np.int64)
            of = np.repeat(np.arange(len(counts)), counts)
            begin, windows, h1, h2 = (np.asarray(asked.flatten().field(k)) for k in range(4))
            ids = np.asarray(block.column("doc_id"))
            # Some thousand segments at a time, which bounds what is held for one block.
            for k in range(0, len(of), 16_384):
                part = slice(k, k + 16_384)
                m = windows[part].astype(np.int64)
                seg = np.repeat(np.arange(len(m)), m)
                shift = np.arange(len(seg)) - np.repeat(np.cumsum(m) - m, m)
                at = (begin[part] + upto[of[part]])[seg] + shift
                hashes = [span_hashes(c, at, at + length, b).view(np.int64) for c, b in zip(codes, BASES)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(h) for h in hashes),
                        pa.array(h1[part][seg]),
                        pa.array(h2[part][seg]),
                        pa.array(shift.astype(np.int32)),
                        pa.array(ids[of[part]][seg]),
                    ],
                    ["w1", "w2", "h1", "h2", "shift", "doc_id"],
                )

    return expand


def _whole(key: str, text: str):
    """Word count and digest of the words of each text as they are."""

    def count(batches):
        for block in blocks(batches, text, BLOCK_BYTES):
            n, digests = [], []
            for value in block.column(text).cast(pa.binary()).to_pylist():
                words = (value or b"").split()
                n.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [block.column(key), pa.array(n, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "sha"],
            )

    return count


def _runs(ranges: np.ndarray, n: int, length: int) -> np.ndarray:
    """Mask of the words covered by windows that begin in the (first, windows) ranges."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, ranges[:, 0], 1)
    np.add.at(steps, np.minimum(ranges[:, 0] + ranges[:, 1] + length - 1, n), -1)
    return np.cumsum(steps[:n]) > 0


def _remover(length: int, with_text: bool):
    def remove(batches):
        for block in blocks(batches, "text", BLOCK_BYTES):
            out: dict[str, list] = {"doc_id": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
            for doc, value, ranges in zip(*(block.column(c).to_pylist() for c in ("doc_id", "text", "ranges"))):
                words = (value or "").encode().split()
                at = np.array([(r["first"], r["windows"]) for r in ranges], np.int64)
                gone = _runs(at, len(words), length)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                out["doc_id"].append(doc)
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept_text"].append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["doc_id"], pa.int64()),
                    pa.array(out["n_removed"], pa.int64()),
                    pa.array(out["kept_sha256"], pa.string()),
                    pa.array(out["kept_text"], pa.string()),
                ],
                list(out),
            )

    return remove


def repeated_ranges(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, gram: int = GRAM
) -> DataFrame:
    """Rows (doc_id, ranges): per document with repeats, the (first, windows) ranges of
    windows whose words also begin in a document with a smaller id."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    source = source.filter(F.col("doc_id").isNotNull())
    segments = written(
        source.mapInArrow(
            _segments("doc_id", "text", length, gram),
            "h1 long, h2 long, anchor long, lead int, windows int, doc_id long, first long",
        ),
        "substring-segments",
    )
    # Equal segments agree in anchor, lead and windows as well.
    distinct = written(
        segments.groupBy("h1", "h2", "anchor", "lead", "windows").agg(
            F.min(F.struct("doc_id", "first")).alias("home"), F.count("*").alias("n")
        ),
        "substring-distinct",
    )
    shared = distinct.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1").select("anchor")
    asked = distinct.join(shared, "anchor", "left_semi").select("h1", "h2", "windows", "home.doc_id", "home.first")
    asked = written(
        asked.groupBy("doc_id").agg(F.collect_list(F.struct("first", "windows", "h1", "h2")).alias("asked")),
        "substring-asked",
    )
    texts = only(source, asked.select("doc_id"), "doc_id")
    windows = texts.join(asked, "doc_id").mapInArrow(
        _window_hashes(length), "w1 long, w2 long, h1 long, h2 long, shift int, doc_id long"
    )
    windows = written(windows, "substring-windows")
    earliest = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("d0"), F.count("*").alias("n")).filter("n > 1")
    # Tables that hot keys are joined to are written, so that these joins can be split.
    earliest = written(earliest, "substring-earliest")
    partial = windows.join(earliest, ["w1", "w2"]).filter("d0 < doc_id")
    partial = partial.groupBy("h1", "h2").agg(F.collect_set("shift").alias("shifts"))
    # Copies of a segment in later documents are covered whole, the first one where windows matched.
    classes = distinct.select("h1", "h2", F.col("home.doc_id").alias("home"), "n").join(partial, ["h1", "h2"], "left")
    classes = classes.filter(F.col("shifts").isNotNull() | (F.col("n") > 1)).drop("n")
    classes = written(classes, "substring-classes")
    hit = segments.select("h1", "h2", "windows", "doc_id", "first").join(classes, ["h1", "h2"])
    own = F.col("doc_id") == F.col("home")
    one = F.transform("shifts", lambda k: F.struct((F.col("first") + k).alias("first"), F.lit(1).alias("windows")))
    found = F.when(own, one).otherwise(F.array(F.struct("first", "windows")))
    hit = hit.filter((F.col("doc_id") > F.col("home")) | F.col("shifts").isNotNull())
    # As many entries as the document has windows, at the most.
    ranges = hit.select("doc_id", found.alias("r")).groupBy("doc_id")
    return written(ranges.agg(F.flatten(F.collect_list("r")).alias("ranges")), "substring-ranges")


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = 50,
    gram: int = GRAM,
    with_text: bool = True,
) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256, kept_text), one per document.

    Words are runs without ASCII white space. A word goes if a window of ``length``
    words that covers it also begins in a document with a smaller id; repeats inside
    one document stay. Windows are judged on the input. ``kept_text`` is NULL for
    documents that lose nothing, and always without ``with_text``. A NULL text has no
    words. Rows without a key are left out. Rows that are equal in key and text are one
    document and come out alike, each of them; rows that share a key and differ are
    documents one after another, by a digest of the text. An empty table gives no
    rows; other columns are not read.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    source = source.filter(F.col("doc_id").isNotNull())
    if keys_repeat(source, "doc_id"):
        rows, number = numbered_rows(merged_rows(source, "doc_id", "text"), "doc_id", "text")
        found = remove_repeats(rows.drop("doc_id"), number, "text", length, gram, with_text)
        names = rows.select(F.col(number).alias("_row"), F.col("doc_id").alias("_name"), "copies")
        each = found.withColumnRenamed("doc_id", "_row").join(names, "_row")
        each = each.withColumn("_copy", F.explode(F.expr("sequence(1L, copies)")))
        return each.select(F.col("_name").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text")
    ranges = repeated_ranges(docs, key, text, length, gram)
    touched = only(source, ranges.select("doc_id"), "doc_id").join(ranges, "doc_id")
    removed = touched.mapInArrow(
        _remover(length, with_text), "doc_id long, n_removed long, kept_sha256 string, kept_text string"
    )
    all_docs = source.mapInArrow(_whole("doc_id", "text"), "doc_id long, n_words long, sha string")
    return all_docs.join(removed, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        "kept_text",
    )

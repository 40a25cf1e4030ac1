"""Quality classification by importance resampling.

Two generative models over hashed n-grams, one of the target (documents labelled as
good) and one of all raw text, give every document a log importance weight: the sum
over its n-grams of log p_target - log p_raw. Adding Gumbel noise to the weights and
keeping the k largest sums draws k documents without replacement in proportion to
their weights.

n-grams are words, pairs of words, and triples of word shapes. A shape holds the
letter case, the length, the kind of mark and whether the word repeats a recent one, so that
shouting, rows of marks and repetition are seen in words that were never counted.

The raw model counts every document. The target model is fitted on a bounded sample
of labelled rows. The number k is the number of documents whose weight is above a
cutoff, and the cutoff is set on labelled rows that the target model has not seen.
Everything is a map over the documents and sums per bucket; weights are whole numbers,
so a task that runs again gives the same ones.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import BLANK, LOWER, blocks, mixed, span_hashes, text_bytes, written

BUCKETS = 1 << 17
SAMPLE = 20_000
# Weights are kept in units of 2 ** -20.
UNIT = 1 << 20
BASE = 0x9E3779B97F4A7C15
BLOCK_BYTES = 1 << 20
# Keeping a good document counts as much as rejecting this many bad ones.
KEEP_WEIGHT = 20

# Kinds of bytes: 0 blank, 1 mark, 2 digit, 3 small letter, 4 capital; others are letters.
_KIND = np.ones(256, np.uint8)
_KIND[BLANK] = 0
_KIND[0x30:0x3A] = 2
_KIND[0x61:0x7B] = 3
_KIND[0x41:0x5B] = 4
_KIND[0x80:] = 3


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of each text, and how many there are up to each text.

    Words are runs of letters and digits, or of marks; n-grams do not cross texts.
    """
    texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)
    kind = _KIND[data]
    group = np.minimum(kind, 2)
    change = np.r_[True, group[1:] != group[:-1]]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    change[edges] = True
    first = np.flatnonzero(change)
    last = np.r_[first[1:], len(data)]
    word = group[first] > 0
    first, last = first[word], last[word]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)
    doc = np.searchsorted(offsets, first, side="right") - 1
    code = span_hashes(LOWER[data], first, last, BASE)

    capitals = np.r_[0, np.cumsum(kind == 4)]
    digits = np.r_[0, np.cumsum(kind == 2)]
    length = last - first
    upper = capitals[last] - capitals[first]
    shape = np.where(upper == 0, 0, np.where(upper == length, 1, np.where(upper == 1, 2, 3)))
    shape = shape * 4 + np.minimum(digits[last] - digits[first], 3)
    shape = shape * 8 + np.minimum(length // 3, 7)
    shape = np.where(group[first] == 1, 4096 + data[first].astype(np.int64) * 4 + np.minimum(length, 3), shape)
    # Does the word stand among the last few of its text as well?
    again = np.zeros(len(code), np.int64)
    for lag in (1, 2, 3, 4):
        same = np.zeros(len(code), bool)
        same[lag:] = (code[lag:] == code[:-lag]) & (doc[lag:] == doc[:-lag])
        again += same
    shape = (shape * 8 + again).astype(np.uint64)

    one = mixed(code + np.uint64(1))
    pair = mixed(code[:-1] * np.uint64(3) + code[1:])[doc[1:] == doc[:-1]]
    three = mixed(shape[:-2] + shape[1:-1] * np.uint64(1 << 20) + shape[2:] * np.uint64(1 << 40) + np.uint64(7))
    three = three[doc[2:] == doc[:-2]]
    of = np.concatenate([doc, doc[1:][doc[1:] == doc[:-1]], doc[2:][doc[2:] == doc[:-2]]])
    bucket = np.concatenate([one, pair, three]) >> np.uint64(64 - (BUCKETS.bit_length() - 1))
    order = np.argsort(of, kind="stable")
    upto = np.r_[0, np.cumsum(np.bincount(of, minlength=texts))]
    return bucket[order].astype(np.int64), upto


class Model(NamedTuple):
    """Weights of the buckets in units of ``1 / UNIT``, the cutoff, and what is selected.

    A document is kept if its noisy key is above ``key``, or equal to it and its id is
    at most ``last_id``.
    """

    weights: np.ndarray
    cutoff: int
    key: int = -(1 << 63)
    last_id: int = (1 << 63) - 1


def _text_and_key(docs: DataFrame, key: str, text: str) -> DataFrame:
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.filter(F.col("doc_id").isNotNull())


def _counter(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for block in blocks(batches, "text", BLOCK_BYTES):
        bucket, upto = grams(*text_bytes(block.column("text")))
        raw += np.bincount(bucket, minlength=BUCKETS)
        for i in np.flatnonzero(np.asarray(block.column("good").fill_null(False))):
            target += np.bincount(bucket[upto[i] : upto[i + 1]], minlength=BUCKETS)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"]
    )


def _summed(weights: np.ndarray, bucket: np.ndarray, upto: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(weights[bucket])]
    return sums[upto[1:]] - sums[upto[:-1]]


def noisy_keys(ids: np.ndarray, weights: np.ndarray, seed: int) -> np.ndarray:
    """Weight plus Gumbel noise, as whole numbers in the same units.

    The noise is a function of the id and the seed.
    """
    bits = mixed(mixed(ids.astype(np.uint64) + np.uint64(seed)) + np.uint64(BASE))
    u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return weights + np.rint(-np.log(-np.log(u)) * UNIT).astype(np.int64)


def _scored(weights: np.ndarray, seed: int):
    def score(batches):
        for block in blocks(batches, "text", BLOCK_BYTES):
            weight = _summed(weights, *grams(*text_bytes(block.column("text"))))
            key = noisy_keys(np.asarray(block.column("doc_id")), weight, seed)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(weight), pa.array(key)], ["doc_id", "weight", "key"]
            )

    return score


def cutoff(weights: np.ndarray, good: np.ndarray) -> int:
    """The weight that best separates good from bad, losing a good one counting ``KEEP_WEIGHT`` times.

    It lies half way between the two weights it separates. With one kind of label
    only, nothing is rejected.
    """
    if not len(good) or good.all() or not good.any():
        return -(1 << 62)
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    # Cost of rejecting the first i rows; equal weights are never separated.
    lost = np.r_[0, np.cumsum(g)] * KEEP_WEIGHT + np.r_[0, np.cumsum(~g)][-1] - np.r_[0, np.cumsum(~g)]
    allowed = np.r_[True, w[1:] != w[:-1], True]
    lost = np.where(allowed, lost, lost.max() + 1)
    best = np.flatnonzero(lost == lost.min())
    i = int(best[len(best) // 2])
    if i == 0:
        return -(1 << 62)
    return int(w[i - 1] + 1) if i == len(w) else int((w[i - 1] + w[i]) // 2 + 1)


def kth_key(table: DataFrame, k: int) -> tuple[int, int]:
    """Key and largest id of the k rows with the largest keys, equal keys by smallest id.

    Digits of 16 bits are counted, at most 65,536 counts at a time, and only rows that
    agree with the digits so far are counted again. No rows are sorted or collected.
    """

    def descend(rows: DataFrame, column: str, left: int, largest: bool) -> tuple[int, int, bool]:
        # The sign bit is turned so that digits are in the order of the numbers.
        digit = F.lit(0)
        low, value = rows, 0
        for shift in (48, 32, 16, 0):
            digit = F.call_function("shiftright", F.col(column), F.lit(shift))
            if shift < 48:
                digit = digit.bitwiseAND(F.lit(0xFFFF))
            counts = low.groupBy(digit.cast("long").alias("d")).count().toArrow().sort_by(
                [("d", "descending" if largest else "ascending")]
            )
            for d, n in zip(counts.column("d").to_pylist(), counts.column("count").to_pylist()):
                if left <= n:
                    break
                left -= n
            value |= d << shift
            low = low.filter(digit == F.lit(d))
            if left == n:
                # All rows of this digit are taken; the bound is the last number with it.
                return (value if largest else value | ((1 << shift) - 1)), left, True
        return value, left, False

    key, left, all_of_it = descend(table, "key", k, True)
    if all_of_it:
        return key, (1 << 63) - 1
    return key, descend(table.filter(F.col("key") == F.lit(key)), "doc_id", left, False)[0]


def fit_resampler(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sample: int = SAMPLE,
    seed: int = 11,
) -> tuple[Model, DataFrame]:
    """The model, and a written table (doc_id, weight, key) with a row per document.

    ``labels`` has the columns ``key`` and ``quality`` (1 is good); of its rows the
    ``sample`` first in a seeded order are used, two thirds for the target model and
    one third for the cutoff. A document is good if any of its labels says so.
    """
    source = _text_and_key(docs, key, text)
    chosen = (
        labels.select(F.col(key).cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"))
        .filter(F.col("doc_id").isNotNull() & F.col("good").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("good").alias("good"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .limit(sample)
    )
    held = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.lit(3)) == 0
    chosen = written(chosen.withColumn("held", held), "resample-labels")
    # At most ``sample`` rows on both occasions.
    fit = F.broadcast(chosen.filter("good and not held").select("doc_id", "good"))
    counted = source.join(fit, "doc_id", "left").select("text", "good").mapInArrow(
        _counter, "bucket int, raw long, target long"
    )
    # At most ``BUCKETS`` rows.
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = np.asarray(sums.column("bucket"))
    raw[at], target[at] = np.asarray(sums.column("raw")), np.asarray(sums.column("target"))
    if target.any():
        ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    else:
        ratio = np.zeros(BUCKETS)
    weights = np.rint(ratio * UNIT).astype(np.int64)

    table = written(source.mapInArrow(_scored(weights, seed), "doc_id long, weight long, key long"), "resample-keys")
    known = table.join(F.broadcast(chosen.filter("held").select("doc_id", "good")), "doc_id")
    # One row for each label, also where rows share an id.
    known = known.groupBy("doc_id").agg(F.max("weight").alias("weight"), F.max("good").alias("good")).toArrow()
    model = Model(weights, cutoff(np.asarray(known.column("weight")), np.asarray(known.column("good"))))
    k = table.filter(F.col("weight") >= F.lit(model.cutoff)).count()
    if not k:
        return model._replace(key=(1 << 63) - 1, last_id=-(1 << 63)), table
    bound, last = kth_key(table, k)
    return model._replace(key=bound, last_id=last), table


def _selected(model: Model) -> F.Column:
    return (F.col("key") > F.lit(model.key)) | ((F.col("key") == F.lit(model.key)) & (F.col("doc_id") <= F.lit(model.last_id)))


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows (doc_id, log_weight, gumbel_key, kept) of the documents that are drawn.

    A NULL or empty text has weight 0. Rows without a key are left out; rows that share one
    come out each by its own weight. Without labels of both kinds every document is kept. An empty table gives no
    rows; other columns are not read.
    """
    model, table = fit_resampler(docs, labels, key, text, **options)
    return table.filter(_selected(model)).select(
        "doc_id",
        (F.col("weight") / UNIT).alias("log_weight"),
        (F.col("key") / UNIT).alias("gumbel_key"),
        F.lit(True).alias("kept"),
    )


def keep_resampled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 11, **options) -> DataFrame:
    """The drawn documents with all their columns.

    Weights are computed again while the documents are read, so nothing is joined.
    """
    model, _ = fit_resampler(docs, labels, key, text, seed=seed, **options)

    def keep(batches):
        for block in blocks(batches, text, BLOCK_BYTES):
            weight = _summed(model.weights, *grams(*text_bytes(block.column(text))))
            ids = np.asarray(block.column(key))
            noisy = noisy_keys(ids, weight, seed)
            kept = (noisy > model.key) | ((noisy == model.key) & (ids <= model.last_id))
            yield block.filter(pa.array(kept))

    return docs.filter(F.col(key).isNotNull()).mapInArrow(keep, docs.schema)

"""Label ids, row weights, vocabularies and fixed-length encodings."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtally.functions.labels import CLASS_WEIGHTS, lookup
from voxtally.functions.text import tokenize
from voxtally.operators.frequent import CAPACITY, most_frequent
from voxtally.operators.sides import bounded_broadcast, fetched_rows, written

# Fixed values -----------------------------------------------------------------
PAD_ID = 0
UNKNOWN_ID = 1
FIRST_WORD_ID = 2
MAX_LENGTH = 128
VOCABULARY_SIZE = 30_000
# ------------------------------------------------------------------------------


def label_index(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels in alphabetical order, numbered from 0.

    The window sees one row per class, and classes are what a model has a
    weight vector for: their number does not grow with the data.
    """
    classes = df.select(label).filter(F.col(label).isNotNull()).distinct()
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(label)) - 1
    return classes.select(label, rank.alias("label_id"))


def index_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``label_id``. The few classes are sent to every task, so rows stay where they are."""
    return df.join(bounded_broadcast(label_index(df, label)), label)


def class_weights(
    df: DataFrame, weights: Mapping[str, float] = CLASS_WEIGHTS, label: str = "label"
) -> DataFrame:
    """Weight of every row by its class; classes without one weigh 1."""
    return df.withColumn("weight", lookup(label, weights, F.lit(1.0)))


def vocabulary(df: DataFrame, text: str = "text", size: int = VOCABULARY_SIZE) -> DataFrame:
    """The ``size`` most frequent words with ids from 2 up; equal counts go by word.

    ``size`` bounds the result, so numbering it takes one task of known weight.
    """
    words = df.select(F.explode(tokenize(text)).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    frequent = counts.orderBy(F.col("n").desc(), "word").limit(size)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "word"))
    return frequent.select("word", (rank + (FIRST_WORD_ID - 1)).alias("word_id"))


def vocabulary_by_summaries(
    df: DataFrame, text: str = "text", size: int = VOCABULARY_SIZE, capacity: int = CAPACITY
) -> DataFrame:
    """The rows of :func:`vocabulary` for texts with very many different words.

    Only summaries of ``capacity`` words per map task and the counts of candidates are shuffled.
    """
    words = df.select(F.explode(tokenize(text)).alias("word"))
    frequent = most_frequent(words, "word", size, capacity)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "word"))
    return frequent.select("word", (rank + (FIRST_WORD_ID - 1)).alias("word_id"))


def encode_fixed_length(
    df: DataFrame,
    vocab: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    max_length: int = MAX_LENGTH,
) -> DataFrame:
    """Word ids of every text, cut and padded to ``max_length``, with the mask.

    A vocabulary within the bounds of a broadcast is sent to every task and the words
    of a text are looked up where the text is, in Arrow batches: no row is shuffled.
    A larger one is joined by a shuffle. A NULL text is all padding. Words of the
    vocabulary are unique.
    """
    tokens = F.slice(F.coalesce(tokenize(text), F.array().cast("array<string>")), 1, max_length)
    cut = df.select(key, tokens.alias("_words"))
    vocab = vocab.select("word", "word_id")
    known = fetched_rows(vocab)
    if known is None:
        return _encoded_by_join(cut, written(vocab, "vocabulary"), key, max_length)
    whole = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([df.schema[key], T.StructField("input_ids", whole), T.StructField("attention_mask", whole)])
    return cut.mapInArrow(_encoder(known, key, max_length), schema)


def _encoder(known: pa.Table, key: str, max_length: int):
    known = known.filter(pc.is_valid(known.column("word"))).combine_chunks()
    words = pa.array(known.column("word").to_pylist(), pa.string())
    ids = np.asarray(known.column("word_id"), np.int32)
    pad, unknown = PAD_ID, UNKNOWN_ID

    def encode(batches):
        for batch in batches:
            column = batch.column("_words")
            counts = np.asarray(column.value_lengths()).astype(np.int64)
            # Places in the vocabulary, the one after its end for words it does not have.
            place = np.asarray(pc.fill_null(pc.index_in(column.flatten(), value_set=words), len(words)))
            row = np.repeat(np.arange(len(counts)), counts)
            at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            out = np.full((len(counts), max_length), pad, np.int32)
            mask = np.zeros((len(counts), max_length), np.int32)
            out[row, at] = np.append(ids, np.int32(unknown))[place]
            mask[row, at] = 1
            ends = pa.array(np.arange(len(counts) + 1) * max_length, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *(pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (out, mask))],
                [key, "input_ids", "attention_mask"],
            )

    return encode


def _encoded_by_join(cut: DataFrame, vocab: DataFrame, key: str, max_length: int) -> DataFrame:
    """The same through a shuffle on the word and one on the key, which has to be unique."""
    words = cut.select(key, F.posexplode_outer("_words").alias("_at", "word"))
    found = words.join(vocab, "word", "left")
    # Position and id share one number: the lists that are shuffled, one per text,
    # then hold eight bytes per word, and sorting them restores the order.
    word_id = F.coalesce("word_id", F.lit(UNKNOWN_ID))
    entry = F.shiftleft(F.col("_at").cast("long"), 32) + word_id
    entry = F.when(F.col("word").isNotNull(), entry)
    grouped = found.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
    ids = F.transform("_entries", lambda e: (e % (1 << 32)).cast("int"))
    missing = F.lit(max_length) - F.size("_entries")
    return grouped.select(
        key,
        F.concat(ids, F.array_repeat(F.lit(PAD_ID), missing)).alias("input_ids"),
        F.concat(
            F.array_repeat(F.lit(1), F.size("_entries")), F.array_repeat(F.lit(0), missing)
        ).alias("attention_mask"),
    )

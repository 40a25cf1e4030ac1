"""Applying a model: linear scores in the JVM, or any batch model as a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.labels import label_name
from voxtally.functions.scores import argmax, linear_logits, softmax

# A loader gives a function from a list of texts to an (n, classes) array of
# probabilities. It runs once per Python worker.
BatchModel = Callable[[Sequence[str]], np.ndarray]

BATCH_RESULT = "class_id int, confidence double, probabilities array<double>"


def score_linear(
    df: DataFrame,
    features: str | Column,
    weights: Sequence[Sequence[float]],
    bias: Sequence[float] | None = None,
    id2label: Mapping[int, str] | None = None,
) -> DataFrame:
    """Add ``probabilities``, ``class_id``, ``label`` and ``confidence``.

    Equal probabilities go to the lowest class id. The weights travel as
    literals of the plan, so their size is that of the model and not of the data.
    """
    features = F.col(features) if isinstance(features, str) else features
    scored = df.withColumn("_logits", linear_logits(features, weights, bias))
    scored = scored.withColumn("probabilities", softmax(F.col("_logits")))
    scored = scored.withColumn("class_id", argmax(F.col("probabilities")))
    return scored.select(
        *df.columns,
        "probabilities",
        "class_id",
        label_name("class_id", id2label).alias("label"),
        F.array_max("probabilities").alias("confidence"),
    )


def batch_model_udf(loader: Callable[[], BatchModel]) -> Callable[[Column], Column]:
    """A plug-in model as a column function over a text column.

    Texts arrive in Arrow batches; the model is loaded when a worker sees its
    first batch and kept for the following ones.
    """

    @F.pandas_udf(BATCH_RESULT)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = loader()
        for texts in batches:
            p = np.asarray(model(texts.fillna("").tolist()), dtype=float)
            yield pd.DataFrame(
                {
                    "class_id": p.argmax(axis=1).astype("int32"),
                    "confidence": p.max(axis=1),
                    "probabilities": list(p),
                }
            )

    return score


def score_batches(
    df: DataFrame,
    text: str,
    loader: Callable[[], BatchModel],
    id2label: Mapping[int, str] | None = None,
) -> DataFrame:
    """Like :func:`score_linear`, with a plug-in model that reads the text."""
    scored = df.withColumn("_s", batch_model_udf(loader)(F.col(text)))
    return scored.select(
        *df.columns,
        F.col("_s.probabilities").alias("probabilities"),
        F.col("_s.class_id").alias("class_id"),
        label_name(F.col("_s.class_id"), id2label).alias("label"),
        F.col("_s.confidence").alias("confidence"),
    )


def attach_predictions(
    labelled: DataFrame, predictions: DataFrame, key: str, truth: str = "label"
) -> DataFrame:
    """Text, prediction, confidence, truth and whether they agree.

    Rows find each other by key. A row that was not predicted is not in the
    result and moves none of the others.
    """
    scores = predictions.select(key, F.col("label").alias("predicted"), "confidence")
    joined = labelled.join(scores, key)
    return joined.select(
        key,
        "text",
        "predicted",
        "confidence",
        F.col(truth).alias("truth"),
        F.col(truth).eqNullSafe(F.col("predicted")).alias("correct"),
    )
